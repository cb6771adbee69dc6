"""Fill-in-the-middle transformation: whole batches of texts are cut and put together again on their Arrow buffers.

A batch is one array of UTF-8 bytes with row offsets. Bytes are looked up in a table of classes, and a table of pairs of classes says at which adjacent bytes a
unit begins (code points: at every byte that doesn't continue one). The first byte of a document always begins a unit, so running sums of the
beginnings, less the sum before the document, count units from 0 in each document, and one binary search in the sums turns the cuts of all rows into bytes.
Segments are gathered by index; nothing loops over rows, units or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free
from .textnp import column_bytes, row_chunks, trim

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that are worked on in one go; a longer text is worked on alone.
AT_ONCE = 4 << 20

_CONTINUES, _SPACE, _OTHER = 0, 1, 2
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[0x80:0xC0] = _CONTINUES
CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: For each kind of unit, whether one begins between a byte of the first class and a byte of the second.
BEGINS = {
    "code point": np.array([[False, True, True]] * 3),
    "word": np.array([[False, True, False], [False, False, False], [False, True, False]]),  # a word with the white space before it
}


def unit_sums(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Beginnings of units up to and including each byte, over all rows; each row's first byte begins one."""
    kind = CLASS[data]
    mask = np.empty(len(data), bool)
    mask[1:] = BEGINS[unit][kind[:-1], kind[1:]]
    mask[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.cumsum(mask, dtype=np.int64 if len(data) >> 31 else np.int32)


def cut_bytes(sums: np.ndarray, offsets: np.ndarray, units: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The byte at which unit ``units[r]`` (from 0) of row r begins, or the end of the row where it has no more units."""
    return np.minimum(np.searchsorted(sums, before + units + 1), offsets[1:])


def marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which a marker begins, their rows): markers are found within rows only."""
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2])) if len(data) > 2 else np.zeros(0, np.int64)
    at = at[np.isin(data[at + 1], np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8))]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[row + 1]
    return at[inside], row[inside]


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ranges [start, end) of each row set end to end, row offsets); starts and ends are matrices of rows by ranges."""
    size = ends - starts
    flat = size.ravel()
    done = np.cumsum(flat)
    at = np.repeat(starts.ravel() - (done - flat), flat) + np.arange(int(done[-1]) if len(done) else 0)
    return data[at], np.append(0, np.cumsum(size.sum(1)))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def cut(data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray], unit: str, plain_from: int, spm_below: int):
    """(n units, form as 0 plain, 1 psm, 2 spm, prefix units, middle units, output bytes, output offsets) of all rows; ``draws`` are four whole numbers a row."""
    rows = len(offsets) - 1
    sums = unit_sums(data, offsets, unit)
    upto = np.append(0, sums)[offsets].astype(np.int64)
    n = np.diff(upto)
    h1, h2, h3, h4 = draws
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    holds = np.zeros(rows, bool)
    holds[marked(data, offsets)[1]] = True
    plain = (n == 0) | holds | (h3 % 100 >= plain_from)
    form = np.where(plain, 0, np.where(h4 % 100 < spm_below, 2, 1))
    x, y = cut_bytes(sums, offsets, first, upto[:-1]), cut_bytes(sums, offsets, second, upto[:-1])
    low, high, end = offsets[:-1], offsets[1:], len(data)
    marks = np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)
    mark = lambda k: (np.where(plain, end, end + 3 * k), np.where(plain, end, end + 3 * k + 3))
    swap = form == 2
    p, s, m = mark(0), mark(1), mark(2)
    pre, suf = (low, np.where(plain, high, x)), (np.where(plain, high, y), high)  # a plain text is all prefix
    one, two = [np.where(swap, t, u) for t, u in zip(s, p, strict=True)], [np.where(swap, t, u) for t, u in zip(suf, pre, strict=True)]
    three, four = [np.where(swap, t, u) for t, u in zip(p, s, strict=True)], [np.where(swap, t, u) for t, u in zip(pre, suf, strict=True)]
    five = (np.where(plain, high, x), np.where(plain, high, y))
    ranges = (one, two, three, four, m, five)
    out, to = gather(np.concatenate([data, marks]), np.stack([r[0] for r in ranges], 1), np.stack([r[1] for r in ranges], 1))
    return n, form, first, second - first, out, to


def uncut(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose outputs and forms these are."""
    at, row = marked(data, offsets)
    on = form[row] > 0
    at, row = at[on], row[on]
    turned = np.flatnonzero(form > 0)
    if not np.array_equal(row, np.repeat(turned, 3)):
        raise ValueError("an output that isn't plain must hold three markers")
    low, high = offsets[:-1].copy(), offsets[1:].copy()
    spots = at.reshape(-1, 3)
    starts, ends = np.stack([low, high, high], 1), np.stack([high, high, high], 1)
    swap = form[turned] == 2
    a, b = spots[:, 0] + 3, spots[:, 1] + 3
    ea, eb = spots[:, 1], spots[:, 2]
    starts[turned] = np.stack([np.where(swap, b, a), spots[:, 2] + 3, np.where(swap, a, b)], 1)
    ends[turned] = np.stack([np.where(swap, eb, ea), high[turned], np.where(swap, ea, eb)], 1)
    return gather(data, starts, ends)


FORMS = pa.array(["plain", "psm", "spm"])


def transform(docs: DataFrame, seed: str = "1", unit: str = "code point", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All input columns but the text, then fim_units (long), fim_form, fim_prefix, fim_middle (units; null if plain) and fim_text.

    Draws h1 to h4 of a row are the first four groups of eight digits of the hex SHA-256 of ``seed:id``. Prefix and middle end at the smaller and larger of
    h1 and h2 modulo n + 1 units. A row is plain if its text is empty or holds a marker, or if h3 % 100 >= ``plain_from``; of others it is spm if h4 % 100 <
    ``spm_below``, else psm. Null text counts as empty, a null id as no digits; repeated ids are cut alike. Units are code points or words, each with the white space before it.
    A batch of rows needs its bytes once and some 30 times the bytes of ``AT_ONCE``, or of its longest text if that is longer. Input columns named like results are replaced.
    """
    if unit not in BEGINS:
        raise ValueError(f"unit must be one of {', '.join(BEGINS)}")
    results = ("fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_text")
    own = [c for c in docs.columns if c.lower() not in (*results, text.lower())]
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    apart = {c: f"own{k}" for k, c in enumerate(own)}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in apart.items()), F.col(text).alias("t"), sha.alias("s"))
    draws = [F.conv(F.substring("s", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = rows.select(*apart.values(), "t", *draws)
    schema = T.StructType(rows.schema.fields[: len(apart)])
    for name, kind in zip(results, ("long", "string", "long", "long", "string"), strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("t"))
            for i, j in row_chunks(offsets, AT_ONCE):
                to = offsets[i : j + 1]
                h = [batch.column(f"h{k}").to_numpy()[i:j] for k in (1, 2, 3, 4)]
                n, form, prefix, middle, out, at = cut(data[to[0] : to[-1]], to - to[0], h, unit, plain_from, spm_below)
                none = form == 0
                cols = [batch.column(a).slice(i, j - i) for a in apart.values()]
                cols += [pa.array(n), FORMS.take(pa.array(form)), pa.array(prefix, mask=none), pa.array(middle, mask=none), _strings(out, at)]
                yield pa.RecordBatch.from_arrays(cols, [*apart.values(), *results])
            trim()

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(a).alias(c) for c, a in apart.items()), *results)


def restore(df: DataFrame, name: str = "restored") -> DataFrame:
    """``df`` with the texts rebuilt from fim_text and fim_form alone, as ``name`` (with underscores before it where that is taken); null output gives empty text."""
    name = free(df.columns, name)[0]
    apart = {c: f"own{k}" for k, c in enumerate(df.columns)}
    text, form = (apart[next(c for c in df.columns if c.lower() == x)] for x in ("fim_text", "fim_form"))
    rows = df.toDF(*apart.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(text))
            for i, j in row_chunks(offsets, AT_ONCE):
                to = offsets[i : j + 1]
                kinds = pc.index_in(batch.column(form).slice(i, j - i), FORMS).to_numpy(zero_copy_only=False)
                out, at = uncut(data[to[0] : to[-1]], to - to[0], kinds)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), _strings(out, at)], [*batch.schema.names, "restored"])
            trim()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields]).add("restored", "string")).toDF(*df.columns, name)
