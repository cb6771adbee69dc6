"""Token-id output in Re-Pair grammar files.

Texts are encoded in ascending doc_id order and written as blocks of bounded size. In each block frequent pairs of ids
are replaced by nonterminals until no pair stands ``LEAST`` times; a block stores its rules and their expansion lengths, so
any range of ids can be decoded without expanding the rest. Rules never span documents. A file row is one block:

part, block      order of the blocks (by range partition, then within it)
doc_ids, lengths documents of the block and their id counts
base             ids below it are terminals; nonterminal k is base + k
rules            two little-endian symbols for each nonterminal, of ``width`` bytes each
sizes            the nonterminals' expansion lengths, of 4 bytes each
symbols          the block's symbols, of ``width`` bytes each
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress as taken
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces
from .textnp import column_bytes, mix, row_chunks, trim

BLOCK_IDS = 1 << 18
MOST_BOUNDS = 512  # a row looks at every bound; more partitions are dealt by Spark's own range partitioning
LEAST = 8  # a pair that stands less often in a block gets no rule
BARS = (400, 100, 32, 12)  # counts of the first rounds
BIN_BITS = 17
BINS = 1 << BIN_BITS


@dataclass
class Grammar:
    """A block of ids as a grammar: symbols below ``base`` are ids, others index ``rules``; ``sizes`` are the rules' expansion lengths."""

    base: int
    rules: np.ndarray  # (n, 2)
    sizes: np.ndarray  # (n,)
    symbols: np.ndarray

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Expansion length of each symbol."""
        out = np.ones(len(symbols), np.int64)
        ruled = symbols >= self.base
        out[ruled] = self.sizes[symbols[ruled] - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of the symbols end to end: nonterminals are replaced by their two sides until none is left."""
        out = symbols.astype(np.uint32)
        while len(at := np.flatnonzero(out >= self.base)):
            many = np.ones(len(out), np.int64)
            many[at] = 2
            side = self.rules[out[at] - self.base]
            place = at + np.arange(len(at))
            out = np.repeat(out, many)
            out[place], out[place + 1] = side[:, 0], side[:, 1]
        return out

    def decode(self) -> np.ndarray:
        """All ids of the block; each rule is expanded once."""
        flat = np.append(np.arange(self.base, dtype=np.uint32), self.expand(self.base + np.arange(len(self.rules))))
        lens = self.lengths(self.symbols)
        begin = np.append(np.arange(self.base), self.base + np.cumsum(self.sizes) - self.sizes)[self.symbols]
        to = np.cumsum(lens)
        return flat[np.repeat(begin - (to - lens), lens) + np.arange(int(to[-1]) if len(to) else 0)]

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the block: the stored lengths tell which symbols cover them, and only those are expanded."""
        end = np.cumsum(self.lengths(self.symbols))
        if not len(end) or stop <= start:
            return np.zeros(0, np.uint32)
        i, j = np.searchsorted(end, start, "right"), np.searchsorted(end, stop, "left")
        before = int(end[i - 1]) if i else 0
        return self.expand(self.symbols[i : j + 1])[start - before : stop - before]


def _choose(which: np.ndarray, count: np.ndarray, beside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the places, in order, are replaced; which pairs get a rule). Of places that overlap the next (``beside``) the one of
    the more frequent pair is taken, of equally frequent ones every other from the left."""
    weight = count[which]
    keep = np.ones(len(which), bool)
    keep[1:] &= ~(beside & (weight[1:] < weight[:-1]))
    keep[:-1] &= ~(beside & (weight[:-1] < weight[1:]))
    tied = np.zeros(len(which), bool)
    tied[1:] = beside & keep[1:] & keep[:-1]
    run = np.arange(len(which))
    keep &= (run - np.maximum.accumulate(np.where(tied, 0, run))) % 2 == 0
    used = np.bincount(which[keep], minlength=len(count)) >= max(2, least // 2)
    return keep & used[which], used


class _Rules:
    def __init__(self, base: int):
        self.base, self.sides, self.sizes = base, [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> int:
        """The first of the new symbols."""
        known = lambda x: np.where(x < self.base, 1, np.append(self.sizes, 0)[np.maximum(x.astype(np.int64) - self.base, 0)])
        first = self.base + len(self.sizes)
        self.sides.append(np.stack([left, right], axis=1).astype(np.uint32))
        self.sizes = np.append(self.sizes, known(left) + known(right))
        return first


def _round(s: np.ndarray, last: np.ndarray, rules: _Rules, bar: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace the pairs that stand ``bar`` times or more, as far as a hashed count finds them."""
    # a pair as one number: 16 bits a symbol while there are so few of them
    kind, bits = (np.uint32, 16) if rules.base + len(rules.sizes) <= 1 << 16 else (np.uint64, 32)
    spread, down = (0x9E3779B1, 32 - BIN_BITS) if bits == 16 else (0x9E3779B97F4A7C15, 64 - BIN_BITS)
    pair = s[:-1].astype(kind)
    pair |= s[1:].astype(kind) << kind(bits)
    bins = ((pair * kind(spread + 2 * turn)) >> kind(down)).astype(np.intp)
    bins[last[:-1]] = BINS
    hot = np.bincount(bins, minlength=BINS + 1) >= bar
    hot[BINS] = False
    at = np.flatnonzero(hot[bins])
    # one pair stands for each bin, nearly always its only frequent one; its exact count decides
    key, where = pair[at], bins[at]
    first = np.zeros(BINS + 1, kind)
    first[where] = key
    hit = first[where] == key
    at, where = at[hit], where[hit]
    count = np.bincount(where, minlength=BINS + 1)
    take = count >= bar
    hit = take[where]
    at, which, found, count = at[hit], (np.cumsum(take) - 1)[where[hit]], first[take], count[take]
    if not len(at):
        return s, last
    keep, used = _choose(which, count, at[1:] == at[:-1] + 1, bar)
    at, which = at[keep], which[keep]
    new = rules.add(found[used] & kind((1 << bits) - 1), found[used] >> kind(bits))
    s[at] = new + (np.cumsum(used) - 1)[which]
    last[at] = last[at + 1]
    stay = np.ones(len(s), bool)
    stay[at + 1] = False
    return s[stay], last[stay]


def _finish(s: np.ndarray, last: np.ndarray, rules: _Rules, least: int) -> np.ndarray:
    """Replace pairs until none stands ``least`` times. After the first count only places of frequent pairs and those beside a replaced one
    are looked at: any other pair stands as often as before or less."""
    n = len(s)
    code = s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]
    bins = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.intp)
    at = np.flatnonzero((np.bincount(bins, minlength=BINS) >= least)[bins] & ~last[:-1])
    after, before, live = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    while len(at):
        found, which, count = np.unique(s[at].astype(np.uint64) << np.uint64(32) | s[after[at]], return_inverse=True, return_counts=True)
        ok = (count >= least)[which]
        if not ok.any():
            break
        at, which = at[ok], which[ok]
        keep, used = _choose(which, count, after[at[:-1]] == at[1:], least)
        if not keep.any():  # what is left overlaps itself
            break
        hit, which = at[keep], which[keep]
        new = rules.add(found[used] >> np.uint64(32), found[used] & np.uint64(0xFFFFFFFF))
        s[hit] = new + (np.cumsum(used) - 1)[which]
        gone = after[hit]
        last[hit], live[gone], after[hit] = last[gone], False, after[gone]
        beyond = after[hit] < n
        before[after[hit[beyond]]] = hit[beyond]
        at = np.unique(np.concatenate([at, hit, before[hit]]))
        at = at[at >= 0]
        at = at[live[at] & ~last[at]]
    return s[live]


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> Grammar:
    """Re-Pair over the documents of a block, until no pair stands ``least`` times.

    Rounds replace all pairs above a count that falls from round to round; pairs that overlap give way to more frequent ones. Pairs never span
    documents.
    """
    s = ids.astype(np.uint32)
    rules = _Rules(max(int(s.max()) + 1 if len(s) else 1, 1))
    last = np.zeros(len(s), bool)  # the document ends after this symbol
    ends = np.cumsum(lengths) - 1
    last[ends[lengths > 0]] = True
    for turn, bar in enumerate(BARS):
        if bar > least and len(s) > 1:
            s, last = _round(s, last, rules, bar, turn)
    if len(s) > 1:
        s = _finish(s, last, rules, least)
    return Grammar(rules.base, np.concatenate(rules.sides), rules.sizes, s)


# --- encoding ---------------------------------------------------------------------------

# Byte classes: 0 ASCII white space, 1 ASCII letter, 2 digit, 3 other ASCII mark, 4 apostrophe, 5 beyond ASCII, 6 control.
_KIND = np.full(256, 3, np.uint8)
_KIND[:32] = _KIND[127] = 6
_KIND[[32, *range(9, 14)]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_KIND[128:] = 5
# Pairs of classes between which the byte-level pattern always cuts, whatever stands around.
_CUT = np.zeros(64, bool)
for _a, _b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), *((k, 0) for k in range(1, 7))):
    _CUT[8 * _a + _b] = True


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, each of which the pattern cuts off from its neighbours, and each row's number of pieces.

    White space goes with what follows, as the pattern looks ahead; only a single character other than a space stands alone.
    """
    n = len(data)
    kind = _KIND[data]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = _CUT[8 * kind[:-1] + kind[1:]]
    white = kind == 0
    lone = white & (data != 32)
    lone[1:] &= ~white[:-1]
    lone[:-1] &= ~white[1:]
    cut[1:][lone] = True
    cut[offs[offs < n]] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.diff(np.searchsorted(starts, offs))


def _odd_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold white space beyond ASCII, or separators that not all patterns count as white space."""
    at = np.flatnonzero((data >= 28) & (data <= 31))
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        one, two = data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        first = data[lead]
        space = ((first == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((first == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((first == 0xE3) & (one == 0x80) & (two == 0x80))
        space |= (first == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
        at = np.append(at, lead[space])
    return np.unique(np.searchsorted(offs, at, "right") - 1)


def _visible() -> np.ndarray:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
    The line end, which separates pieces here, is left as it is."""
    out = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    out[hidden] = 256 + np.arange(len(hidden))
    out[10] = 10
    return out


_VISIBLE = _visible()


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SHORT = 15  # bytes that a piece's two words can hold beside its length


def _byte_level(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts by the byte-level pattern and nothing else, so that pieces can be encoded apart."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    whole = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    lines = not any(t["content"].split() != [t["content"]] for t in spec.get("added_tokens") or [])
    return bool(plain and whole and lines and model.get("type") == "BPE" and not (spec.get("normalizer") or spec.get("truncation") or spec.get("padding")))


class Encoder:
    """Whole-text encoding, as the library's ``encode(text, add_special_tokens=False)`` gives it.

    The byte-level pattern makes pieces independent of each other, so each piece is encoded once and kept in a table by its very bytes:
    up to ``SHORT`` as two words with the length, longer ones in a dictionary. Texts with rare white space or with the string of an
    added token are encoded in one go, and so is everything where the tokenizer isn't of that kind.
    """

    SLOT_BITS, COUNT_BITS = 20, 21
    LONG_BYTES, LONG_KEPT = 256, 50_000  # of counted pieces beyond SHORT those up to so long are kept, and so many of them

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = _byte_level(spec)
        self.strings = [t["content"].encode() for t in spec.get("added_tokens") or []]
        del spec
        self.keep = keep
        if self.plain:
            (self.newline,) = self._raw(["\n"])[0].tolist()
        self._forget()
        self.counted = np.zeros((1 << self.COUNT_BITS, 2), np.uint64)  # pieces whose ids were counted, and how many those are: at most one a byte
        self.many = np.zeros(1 << self.COUNT_BITS, np.uint8)
        self.long_many: dict[bytes, int] = {}

    def _forget(self) -> None:
        n = 1 << self.SLOT_BITS
        self.words = np.zeros((2, n), np.uint64)  # the piece of each slot; no piece is all zeros, as its length is one byte
        self.slot = np.zeros(n, np.int32)  # its number in the store
        self.long: dict[bytes, int] = {}
        self.count = 1
        self.begin = np.zeros(self.keep // 4 + 2, np.int64)  # begin[k] .. begin[k + 1]: piece k's ids
        self.ids = np.zeros(self.keep, np.uint32)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order in which the pieces are encoded, their ids in it end to end, number of ids of each).

        A piece of letters alone, or of digits, goes to the tokenizer's model in one go, as the pattern leaves it whole. Other pieces
        without white space but one space before are encoded as lines of one text; a line end is an id of its own there.
        """
        plain, rest, ids, lens = [], [], [], []
        lined = [k for k, p in enumerate(pieces) if b"\n" not in p]
        joined = b"\n".join([pieces[k] for k in lined])
        seen = _VISIBLE[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split("\n")
        tokenize = self.tok.model.tokenize
        for k, t, v in zip(lined, joined.decode().split("\n"), seen, strict=False):  # no piece: one empty string
            core = t[1:] if t[:1] == " " else t
            if core.isalpha() or (core.isdigit() and core.isascii()):
                got = [x.id for x in tokenize(v)]
                plain.append(k)
                ids += got
                lens.append(len(got))
            else:
                rest.append((k, t, core))
        ids, lens = [np.array(ids, np.uint32)], [np.array(lens, np.int64)]
        lines, odd = [], [(k, pieces[k].decode()) for k, p in enumerate(pieces) if b"\n" in p]
        for k, t, core in rest:
            (lines if core.split() == [core] else odd).append((k, t))
        for i in range(0, len(lines), 2000):
            x = self._raw(["".join([t + "\n" for _, t in lines[i : i + 2000]])])[0]
            end = x == self.newline
            lens.append(np.diff(np.append(-1, np.flatnonzero(end))) - 1)
            ids.append(x[~end])
        for x in self._raw([t for _, t in odd]):
            lens.append(np.array([len(x)]))
            ids.append(x)
        return plain + [k for k, _ in lines + odd], np.concatenate(ids), np.concatenate(lens)

    def _lengths(self, pieces: list[bytes]) -> np.ndarray:
        """Number of ids of each piece, as :meth:`_encode_pieces` encodes it; no ids are gathered."""
        out, rest = np.zeros(len(pieces), np.int64), [k for k, p in enumerate(pieces) if b"\n" in p]
        lined = [k for k, p in enumerate(pieces) if b"\n" not in p] if rest else range(len(pieces))
        joined = b"\n".join([pieces[k] for k in lined] if rest else pieces)
        seen = _VISIBLE[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split("\n")
        cores = [t[1:] if t[:1] == " " else t for t in joined.decode().split("\n")]
        plain = [c.isalpha() or (c.isdigit() and c.isascii()) for c in cores]
        tokenize = self.tok.model.tokenize
        out[list(taken(lined, plain))] = [len(tokenize(v)) for v in taken(seen, plain)]
        rest += [k for k, p in zip(lined, plain, strict=False) if not p]  # no piece: one empty string
        if rest:
            order, _, lens = self._encode_pieces([pieces[k] for k in rest])
            out[np.array(rest)[order]] = lens
        return out

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces that the table lacks, all different."""
        order, ids, lens = self._encode_pieces(pieces)
        many = self.count + len(pieces)
        if many + 2 > len(self.begin):
            self.begin = np.append(self.begin, np.zeros(max(many, len(self.begin)), np.int64))
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(self.count, many)
        to = self.begin[self.count] + np.cumsum(lens)
        self.begin[self.count + 1 : many + 1] = to
        if to[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(int(to[-1]), len(self.ids)), np.uint32))
        self.ids[self.begin[self.count] : to[-1]] = ids
        self.count = many
        return numbers

    @staticmethod
    def _keys(data: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(the bytes, each piece's start, size, two words that hold it if it is short, and hash; each row's number of pieces)."""
        starts, many = _pieces(data, offs)
        size = np.diff(np.append(starts, len(data)))
        raw = data.tobytes() + bytes(16)
        at = np.ndarray(len(data) + 9, "<u8", raw, 0, (1,))  # the 8 bytes from each place on
        one = at[starts] & _MASK[np.minimum(size, 8)]
        two = at[starts + np.minimum(size, 8)] & _MASK[np.clip(size - 8, 0, 7)] | (size.astype(np.uint64) << np.uint64(56))
        return raw, starts, size, one, two, mix(one * np.uint64(0x9E3779B97F4A7C15) + two), many

    @staticmethod
    def _heads(miss: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of missed pieces with equal ones side by side, the first of each, which of these each place equals)."""
        miss = miss[np.lexsort((one[miss], two[miss]))]
        new = np.append(True, (one[miss[1:]] != one[miss[:-1]]) | (two[miss[1:]] != two[miss[:-1]]))
        return miss, miss[new], np.cumsum(new) - 1

    def _numbers(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece in the table, each row's number of pieces)."""
        if self.count > self.keep:
            self._forget()
        raw, starts, size, one, two, hashed, many = self._keys(data, offs)
        place = (hashed >> np.uint64(64 - self.SLOT_BITS)).astype(np.intp)
        number = self.slot[place].astype(np.int64)
        short = size <= SHORT
        miss = np.flatnonzero(short & ((self.words[0, place] != one) | (self.words[1, place] != two)))
        cut = lambda k: [raw[x : x + n] for x, n in zip(starts[k].tolist(), size[k].tolist(), strict=True)]
        if len(miss):
            miss, head, which = self._heads(miss, one, two)
            numbers = self._learn(cut(head))
            number[miss] = numbers[which]
            self.words[:, place[head]], self.slot[place[head]] = (one[head], two[head]), numbers
        long = np.flatnonzero(~short)
        if len(long):
            found = cut(long)
            new = list(dict.fromkeys(p for p in found if p not in self.long))
            if new:
                self.long.update(zip(new, self._learn(new).tolist(), strict=True))
            number[long] = [self.long[p] for p in found]
        return number, many

    def _counts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of every piece, each row's number of pieces); what was counted stays in a table of its own, where a piece takes the place of another with its slot."""
        raw, starts, size, one, two, hashed, many = self._keys(data, offs)
        place = (hashed >> np.uint64(64 - self.COUNT_BITS)).astype(np.intp)
        number = self.many[place].astype(np.int64)
        short = size <= SHORT
        known = self.counted[place]
        miss = np.flatnonzero(short & ((known[:, 0] != one) | (known[:, 1] != two)))
        cut = lambda k: [raw[x : x + n] for x, n in zip(starts[k].tolist(), size[k].tolist(), strict=True)]
        if len(miss):
            miss, head, which = self._heads(miss, one, two)
            got = self._lengths(cut(head))
            number[miss] = got[which]
            _, alone = np.unique(place[head], return_index=True)  # of pieces with one slot the first is kept
            head, got = head[alone], got[alone]
            self.counted[place[head]], self.many[place[head]] = np.stack([one[head], two[head]], axis=1), got
        long = np.flatnonzero(~short)
        if len(long):
            found = cut(long)
            new = list(dict.fromkeys(p for p in found if p not in self.long_many))
            got = dict(zip(new, self._lengths(new).tolist(), strict=True)) if new else {}
            number[long] = [got[p] if p in got else self.long_many[p] for p in found]
            if len(self.long_many) + len(got) > self.LONG_KEPT:
                self.long_many.clear()
            self.long_many.update((p, n) for p, n in islice(got.items(), self.LONG_KEPT) if len(p) <= self.LONG_BYTES)
        return number, many

    def _odd(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows that are encoded in one go."""
        rows = [_odd_rows(data, offs)]
        raw = data.tobytes()
        for t in self.strings:
            at, hits = raw.find(t), []
            while at >= 0:
                hits.append(at)
                at = raw.find(t, at + 1)
            rows.append(np.searchsorted(offs, np.array(hits, np.int64), "right") - 1)
        return np.unique(np.concatenate(rows))

    def _whole(self, data: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        return self._raw([data[offs[k] : offs[k + 1]].tobytes().decode() for k in rows.tolist()])

    def count_ids(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of ids of each row as :meth:`encode` gives them, the end id included."""
        if not len(data):
            return np.ones(len(offs) - 1, np.int64)
        if not self.plain:
            return np.array([len(x) + 1 for x in self._whole(data, offs, np.arange(len(offs) - 1))], np.int64)
        number, many = self._counts(data, offs)
        total = np.append(0, np.cumsum(number))[np.append(0, np.cumsum(many))]
        lengths = np.diff(total) + 1
        odd = self._odd(data, offs)
        if len(odd):
            lengths[odd] = [len(x) + 1 for x in self._whole(data, offs, odd)]
        return lengths

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each followed by ``end_id``; number of ids of each row)."""
        n = len(offs) - 1
        if not len(data):
            return np.full(n, end_id, np.uint32), np.ones(n, np.int64)
        if not self.plain:
            parts = [np.append(x, np.uint32(end_id)) for x in self._whole(data, offs, np.arange(n))]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        number, many = self._numbers(data, offs)
        lens = self.begin[number + 1] - self.begin[number]
        to = np.cumsum(lens)
        total = np.append(0, to)[np.append(0, np.cumsum(many))]
        place = np.arange(int(to[-1]))
        source = self.ids[np.repeat(self.begin[number] - (to - lens), lens) + place]
        ids = np.full(int(to[-1]) + n, end_id, np.uint32)
        ids[place + np.repeat(np.arange(n), np.diff(total))] = source  # every earlier row has one end id
        lengths = np.diff(total) + 1
        odd = self._odd(data, offs)
        if len(odd):
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for k, x in zip(odd.tolist(), self._whole(data, offs, odd), strict=True):
                parts[k] = np.append(x, np.uint32(end_id))
                lengths[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, lengths


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def n_ids(text: Column | str, tokenizer: str) -> Column:
    """Number of ids that :func:`write_ids` writes for a text, its end id included; null counts as empty."""

    def run(col: pa.Array) -> pa.Array:
        data, offs = column_bytes(col)
        enc = _encoder(tokenizer)
        parts = [enc.count_ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in row_chunks(offs, 1 << 18)]
        trim()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(run, "long")(text)


_FILE = "part int, block int, n_ids long, doc_ids array<long>, lengths array<int>, base int, width int, rules binary, sizes binary, symbols binary"


def _bytes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u2" if width == 2 else "<u4").tobytes()


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        part = TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = block = 0

        def flush() -> pa.RecordBatch:
            docs = pa.chunked_array([x[0] for x in held]).combine_chunks()
            ids, lengths = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            g = compress(ids, lengths)
            width = 2 if g.base + len(g.rules) <= 1 << 16 else 4
            whole = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
            cols = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)]), whole(docs, pa.int64()), whole(lengths.astype(np.int32), pa.int32()), pa.array([g.base], pa.int32()), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([_bytes(g.rules, width)]), pa.array([_bytes(g.sizes, 4)]), pa.array([_bytes(g.symbols, width)])], ["part", "block", "n_ids", "doc_ids", "lengths", "base", "width", "rules", "sizes", "symbols"])

        for b in batches:
            data, offs = column_bytes(b["text"])
            for i, j in row_chunks(offs, 1 << 18):
                ids, lengths = enc.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
                # a slice of the column would keep the whole batch in memory
                held.append((pa.array(b["doc_id"].slice(i, j - i).to_pylist(), pa.int64()), ids, lengths))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    held, size, block = [], 0, block + 1
            trim()
        if held:
            yield flush()
        held = []
        trim()

    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` to each document, and write grammar blocks to ``out`` in ascending doc_id order.

    Null texts have the end id alone. Null ids come first; rows with one id stay together, in any order.
    Columns besides doc_id and text aren't read. ``tokenizer`` is a tokenizer file that every executor has.
    """
    n = parts or pieces(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n > MOST_BOUNDS:
        rows = rows.repartitionByRange(n, "doc_id")
    else:
        # bounds from the ids alone: a range partitioning of whole rows would read the texts once more for its sample
        cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
        bounds = sorted(set(cuts or []))
        below = F.array(*map(F.lit, bounds)).cast("array<long>")
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(below, lambda x: x < F.col("doc_id"))))
        rows = rows.repartitionById(len(bounds) + 1, part.cast("int"))
    rows = rows.sortWithinPartitions("doc_id")
    rows.mapInArrow(_write(tokenizer, end_id), _FILE).write.option("compression", "none").parquet(out)


def load(row: dict) -> Grammar:
    """The grammar of one file row."""
    kind = "<u2" if row["width"] == 2 else "<u4"
    return Grammar(row["base"], np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.uint32), np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["symbols"], kind).astype(np.uint32))


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                row = {c: b[c][k].as_py() for c in ("base", "width", "rules", "sizes", "symbols", "before")}
                raw = memoryview(load(row).decode().astype("<u4")).cast("B")
                lengths = b["lengths"][k].values.to_numpy().astype(np.int64)
                to = np.cumsum(lengths)
                each = [raw[4 * (e - n) : 4 * e] for e, n in zip(to.tolist(), lengths.tolist(), strict=True)]
                cols = [b["doc_ids"][k].values, pa.array(row["before"] + to - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in each], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)
            trim()

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit) of every document."""
    blocks = spark.read.schema(_FILE).parquet(path)
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_ids")
    # one row for each part: their number is that of the write's partitions
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "part_start")
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("in_part")).alias("before"))
    rows = blocks.join(starts, ["part", "block"]).select("doc_ids", "lengths", "base", "width", "rules", "sizes", "symbols", "before")
    return rows.mapInArrow(_read(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
