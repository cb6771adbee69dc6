"""Removal of repeated passages by suffix arrays.

Every byte covered by a ``length``-byte string that also starts elsewhere in the corpus
(same document included) is removed. The work is laid out so that no suffix array ever
spans the corpus:

1. *Dealing.* Each start of a ``length``-byte string takes as key the least hash among the
   grams inside the string. Equal strings have equal keys, so a key's strings can be settled
   apart from all others. Neighbouring starts of one key form a run (on average about
   ``length / 2`` starts) and only runs are shuffled, never strings. Runs of the same text, told by a 128-bit cryptographic digest of
   its bytes, form a class with a multiplicity, which settles exact copies before any sorting: a key with one text needs no suffix array.
2. *Shards.* The distinct texts of keys that have two or more classes are dealt into shards
   of bounded size. In a shard the suffix array is built by Larsson-Sadakane refinement and
   common prefixes by Kasai's algorithm, run in step over the shard's texts.
3. *Merging.* A key too large for one shard is spread over several; the suffixes of one are
   then sought in the suffix array of the other by binary search.
4. Settled starts go back to their documents, and the union of their strings is cut out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, join_hot, pieces, written
from .textnp import column_bytes, mix, powers, prefix_hash, row_chunks, trim

GRAM = 24
RUN = 512  # starts in one run at most


# --- numpy: suffix arrays ---------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; zeros beyond the end."""
    n = len(data)
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out[: n - k] |= data[k:]
    return out


def suffix_array(data: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson-Sadakane refinement: ranks by 8 bytes, then doubling among unsorted groups only."""
    n = len(data)
    words = words8(data) if words is None else words
    sa = np.argsort(words)
    key = words[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    rank = np.empty(n + 1, np.int64)  # position of the group's head in the array, plus 1; 0 stands for the end
    rank[sa] = np.repeat(head, size) + 1
    rank[n] = 0
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(slots) and h < n + 8:
        at = sa[slots]
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + h, n)].astype(np.uint64)
        order = np.argsort(pair)
        at, pair = at[order], pair[order]
        sa[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(slots)))
        rank[at] = np.repeat(slots[head], size) + 1
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank[:n] - 1


def _extend(words: np.ndarray, i: np.ndarray, j: np.ndarray, l: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths (``most`` at most) of suffixes i and j that share l bytes already."""
    n = len(words)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + l[live], j[live] + l[live]
        ok = (a < n) & (b < n) & (l[live] < most)
        live, a, b = live[ok], a[ok], b[ok]
        x = words[a] ^ words[b]
        same = x == 0
        part = ~same
        if part.any():
            # bytes before the first that differs; the top bit of a float's exponent is safe, as the top byte decides
            y = x[part]
            lead = np.zeros(len(y), np.int64)
            for k in range(7, 0, -1):
                lead = np.where(y < np.uint64(1) << np.uint64(8 * (8 - k)), np.maximum(lead, k), lead)
            l[live[part]] += lead
        l[live[same]] += 8
        live = live[same]
    return np.minimum(l, most)


def kasai(words: np.ndarray, sa: np.ndarray, rank: np.ndarray, first: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each wanted suffix and its predecessor, by Kasai's rule, in step over texts.

    Text t wants the suffixes ``first[t] .. first[t] + count[t] - 1``; others get 0. Lengths are cut to ``most``.
    """
    lcp = np.zeros(len(sa), np.int32)
    order = np.argsort(-count)
    first, count = first[order], count[order]
    l = np.zeros(len(first), np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        lanes = int(np.searchsorted(-count, -t, "left"))  # texts with more than t wanted suffixes
        i = first[:lanes] + t
        r = rank[i]
        has = r > 0
        j = sa[np.maximum(r - 1, 0)]
        got = np.maximum(l[:lanes] - 1, 0)
        got[~has] = 0
        if has.all():
            got = _extend(words, i, j, got, most)
        else:
            got[has] = _extend(words, i[has], j[has], got[has], most)
        l[:lanes] = got
        lcp[i] = got
    return lcp


def search(words: np.ndarray, sa: np.ndarray, other: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Whether the ``most`` bytes from each start of another shard (its ``words8`` given) stand in this one: binary search."""
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(sa), np.int64)
    found = np.zeros(len(starts), bool)
    n = len(words)
    live = np.arange(len(starts))
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        a, b = sa[mid], starts[live]
        below = np.zeros(len(live), bool)
        equal = np.zeros(len(live), bool)
        cmp = np.arange(len(live))
        l = 0
        while len(cmp):
            x = np.where(a[cmp] + l < n, words[np.minimum(a[cmp] + l, n - 1)], 0)
            y = np.where(b[cmp] + l < len(other), other[np.minimum(b[cmp] + l, len(other) - 1)], 0)
            if most - l < 8:
                drop = np.uint64(8 * (8 - (most - l)))
                x, y = x >> drop, y >> drop
            below[cmp[x < y]] = True
            cmp = cmp[x == y]
            l += 8
            if l >= most:
                equal[cmp] = True
                break
        found[live[equal]] = True
        lo[live[below]] = mid[below] + 1
        up = ~below & ~equal
        hi[live[up]] = mid[up]
        live = live[~equal]
        live = live[lo[live] < hi[live]]
    return found


class Shard:
    """Texts of one shard, joined with separators of bytes 0xF8 to 0xFF, which never occur in UTF-8: a string of text matches text alone.
    Each separator spells its text's number, so suffixes part there."""

    def __init__(self, texts: pa.Array, length: int):
        data, offs = column_bytes(texts)
        n = len(offs) - 1
        size = np.diff(offs)
        self.first = offs[:-1] + 8 * np.arange(n)
        joined = np.zeros(len(data) + 8 * n, np.uint8)
        where = np.repeat(8 * np.arange(n), size)
        joined[np.arange(len(data)) + where] = data
        sep = self.first + size
        for k in range(8):
            joined[sep + k] = 0xF8 | ((np.arange(n) >> (3 * (7 - k))) & 7)
        self.count = np.maximum(size - length + 1, 0)
        self.length = length
        self.words = words8(joined)
        self.sa, self.rank = suffix_array(joined, self.words)

    def repeated(self) -> np.ndarray:
        """Flags of the starts whose string stands twice or more in this shard."""
        lcp = kasai(self.words, self.sa, self.rank, self.first, self.count, self.length)
        flag = np.zeros(len(self.sa), bool)
        hit = np.flatnonzero(lcp >= self.length)
        flag[hit] = True
        flag[self.sa[self.rank[hit] - 1]] = True
        return flag

    def starts(self) -> np.ndarray:
        return np.repeat(self.first - np.cumsum(self.count) + self.count, self.count) + np.arange(int(self.count.sum()))

    def found(self, other: Shard) -> np.ndarray:
        """Flags of this shard's starts whose string stands in the other shard."""
        flag = np.zeros(len(self.sa), bool)
        s = self.starts()
        flag[s[search(other.words, other.sa, self.words, s, self.length)]] = True
        return flag

    def intervals(self, flag: np.ndarray) -> list[list[dict]]:
        """For each text, the maximal intervals [a, b] of flagged starts."""
        out = []
        for f, c in zip(self.first.tolist(), self.count.tolist(), strict=True):
            edge = np.diff(np.concatenate(([0], flag[f : f + c].astype(np.int8), [0])))
            out.append([{"a": a, "b": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True)])
        return out


# --- dealing --------------------------------------------------------------------------


def _runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, key, first start, last start, inner) of the runs of all rows; starts relative to their row.

    inner: the run may hold one string twice. Such strings overlap with a period that the key's gram repeats,
    so that gram leaves the window at a start that isn't the run's last and the least hash stays the same.
    """
    z = np.zeros(0, np.int64)
    width = length - GRAM + 1
    if len(data) < length:
        return z, z, z, z, z.astype(bool)
    prefix = prefix_hash(data)
    _, inv = powers(len(prefix))
    least = mix((prefix[GRAM:] - prefix[:-GRAM]) * inv[: len(prefix) - GRAM])
    grams = least
    w = 1
    while w * 2 <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if w < width:
        least = np.minimum(least[: w - width], least[width - w :])
    size = np.diff(offs)
    count = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    if not len(row):
        return z, z, z, z, z.astype(bool)
    at = np.repeat(offs[:-1] - np.cumsum(count) + count, count) + np.arange(len(row))
    key = least[at]
    cut = np.ones(len(row), bool)
    cut[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(cut)
    span = np.diff(np.append(begin, len(row)))
    leaves = grams[at] == key
    leaves[np.append(begin[1:], len(row)) - 1] = False
    inner = np.logical_or.reduceat(leaves, begin) | (span > width)
    parts = -(-span // RUN)
    inner = np.repeat(inner, parts)
    begin = np.repeat(begin, parts) + RUN * (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts))
    last = np.append(begin[1:], len(row)) - 1
    lo, hi = at[begin], at[last]
    r = row[begin]
    return r, key[begin].view(np.int64), lo - offs[r], hi - offs[r], inner


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A 128-bit cryptographic digest of each range: equal texts, and no others, are told by it."""
    raw = memoryview(np.ascontiguousarray(data))
    return [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist(), strict=True)]


def _run_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b["text"])
            for i, j in row_chunks(offs, 1 << 20):
                r, key, lo, hi, inner = _runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
                same = _digests(data, offs[r + i] + lo, offs[r + i] + hi + length)
                take = pa.array(r + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(same, pa.binary()), b["did"].take(take), b["dth"].take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(inner)],
                    ["key", "same", "did", "dth", "lo", "hi", "inner"],
                )
            trim()

    return run


def _slices(length: int):
    """Cut the wanted texts out of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b["text"])
            want = b["want"]
            flat, at = want.flatten(), np.repeat(np.arange(len(b)), want.value_lengths().to_numpy(zero_copy_only=False))
            lo = offs[at] + flat.field("lo").to_numpy(zero_copy_only=False)
            hi = offs[at] + flat.field("hi").to_numpy(zero_copy_only=False) + length
            raw = data.tobytes()
            texts = [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
            for i in range(0, max(len(texts), 1), 5000):
                part = flat.slice(i, 5000)
                yield pa.RecordBatch.from_arrays([*(part.field(k) for k in ("shard", "part", "parts", "key", "same", "times")), pa.array(texts[i : i + 5000], pa.binary())], ["shard", "part", "parts", "key", "same", "times", "text"])

    return run


_HITS = "key long, same binary, times long, hits array<struct<a:int,b:int>>"


def _hit_table(t: pa.Table, hits: list) -> pa.Table:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    return pa.table({"key": t["key"], "same": t["same"], "times": t["times"], "hits": pa.array(hits, kind)})


def _settle(length: int):
    def run(t: pa.Table) -> pa.Table:
        shard = Shard(t["text"].combine_chunks(), length)
        flag = shard.repeated()
        many = np.flatnonzero(t["times"].to_numpy() > 1)
        for k in many.tolist():
            flag[shard.first[k] : shard.first[k] + shard.count[k]] = True
        return _hit_table(t, shard.intervals(flag))

    return run


def _merge(length: int):
    """One pair of shards of a large key: suffixes of the second are sought in the first and the other way round."""

    def run(t: pa.Table) -> pa.Table:
        left = pa.compute.equal(t["part"], t["one"])
        a, b = t.filter(left), t.filter(pa.compute.invert(left))
        if not len(a) or not len(b):
            return _hit_table(t.slice(0, 0), [])
        x, y = Shard(a["text"].combine_chunks(), length), Shard(b["text"].combine_chunks(), length)
        return pa.concat_tables([_hit_table(a, x.intervals(x.found(y))), _hit_table(b, y.intervals(y.found(x)))])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = column_bytes(b["text"])
            hits = b["hits"]
            size = hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = hits.flatten()
            a = flat.field("a").to_numpy(zero_copy_only=False).astype(np.int64)
            e = flat.field("b").to_numpy(zero_copy_only=False).astype(np.int64) + length
            to = np.append(0, np.cumsum(size))
            raw = data.tobytes()
            removed, spans, digest, kept = [], [], [], []
            for k in range(len(b)):
                text = raw[offs[k] : offs[k + 1]]
                cuts = []
                if size[k]:
                    x, y = a[to[k] : to[k + 1]], e[to[k] : to[k + 1]]
                    o = np.argsort(x, kind="stable")
                    x, y = x[o], np.maximum.accumulate(y[o])
                    new = np.append(True, x[1:] > y[:-1])
                    cuts = list(zip(x[new].tolist(), y[np.append(np.flatnonzero(new)[1:] - 1, len(y) - 1)].tolist(), strict=True))
                rest, at, gone = [], 0, 0
                for s, t in cuts:
                    rest.append(text[at:s])
                    gone += t - s
                    at = t
                rest.append(text[at:])
                left = b"".join(rest)
                removed.append(gone)
                spans.append([{"start": s, "end": t} for s, t in cuts])
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"],
                    pa.array(np.diff(offs)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(digest, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"],
            )

    return run


def repeated_starts(docs: DataFrame, length: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(runs, hits): every run of starts, and once for each class of runs with repeats how many runs it has (times) and the intervals of starts that are repeated."""
    spark = docs.sparkSession
    runs = written(docs.select(*doc_key(), "text").mapInArrow(_run_rows(length), "key long, same binary, did long, dth long, lo int, hi int, inner boolean"), "runs")
    classes = runs.groupBy("key", "same").agg(F.count("*").alias("times"), F.min(F.struct("did", "dth", "lo", "hi")).alias("rep"), F.max("inner").alias("inner"))
    keys = classes.groupBy("key").agg(F.count("*").alias("texts"), F.sum("times").alias("all"), F.sum(F.col("rep.hi") - F.col("rep.lo") + length + 8).alias("bytes"), F.max("inner").alias("twice")).filter("all > 1 or twice")
    classes = written(classes.drop("inner").join(keys, "key").drop("all"), "classes")
    whole = classes.filter("texts = 1 and not twice").select("key", "same", "times", F.array(F.struct(F.lit(0).alias("a"), (F.col("rep.hi") - F.col("rep.lo")).alias("b"))).alias("hits"))
    several = classes.filter("texts > 1 or twice")
    total = several.agg(F.sum(F.col("rep.hi") - F.col("rep.lo") + length + 8)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes * 1.3))
    parts = F.ceil(F.col("bytes") / shard_bytes).cast("int")
    place = several.select(
        F.when(parts > 1, F.xxhash64("key").bitwiseOR(F.lit(-(1 << 63)))).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).alias("shard"),
        F.pmod(F.xxhash64("same", F.lit(1)), parts).cast("int").alias("part"),
        parts.alias("parts"),
        *("key", "same", "times"),
        *(F.col(f"rep.{k}").alias(k) for k in ("did", "dth", "lo", "hi")),
    )
    want = place.groupBy("did", "dth").agg(F.collect_list(F.struct("shard", "part", "parts", "key", "same", "times", "lo", "hi")).alias("want"))
    texts = docs.select(*doc_key(), "text")
    cut = texts.join(want, ["did", "dth"]).select("text", "want").mapInArrow(_slices(length), "shard long, part int, parts int, key long, same binary, times long, text binary")
    cut = written(cut, "texts")
    settled = cut.repartition(min(shards, 8 * pieces(spark)), "shard", "part").groupBy("shard", "part").applyInArrow(_settle(length), _HITS)
    big = cut.filter("parts > 1")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = big.select("*", other.alias("other")).filter("part <> other").select("*", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"))
    merged = pairs.groupBy("shard", "one", "two").applyInArrow(_merge(length), _HITS)
    found = settled.unionByName(merged).groupBy("key", "same", "times").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return runs, written(whole.unionByName(found).filter(F.size("hits") > 0), "hits")


def remove_repeats(docs: DataFrame, length: int = 400, shard_bytes: int = 3 << 20) -> DataFrame:
    """Cut out all bytes covered by a ``length``-byte string that starts anywhere else too.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, half open), kept_sha256 and kept
    (remaining bytes; they may cut a character in two). One row for each input row.

    Null texts count as empty and, like texts shorter than ``length``, lose nothing. A repeated row is
    another document: its text is then repeated. Rows with a null doc_id take part like any other.
    Columns besides doc_id and text are not read. An empty table gives an empty result. A text must fit a task, with some 60 times
    its bytes of working memory. A key too large for a shard costs the square of its number of shards.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    docs = docs.select("doc_id", "text")
    runs, hits = repeated_starts(docs, length, shard_bytes)
    spans = join_hot(runs, hits, ["key", "same"], "times", runs.count(), "did").select("did", "dth", F.explode("hits").alias("h"), "lo").select("did", "dth", F.struct((F.col("lo") + F.col("h.a")).alias("a"), (F.col("lo") + F.col("h.b")).alias("b")).alias("h"))
    spans = spans.groupBy("did", "dth").agg(F.collect_list("h").alias("hits"))
    keyed = docs.select("doc_id", "text", *doc_key())
    return (
        keyed.join(spans, ["did", "dth"], "left")
        .select("doc_id", "text", "hits")
        .mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    )
