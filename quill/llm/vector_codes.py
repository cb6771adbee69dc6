"""Product codes of integer vectors: exact nearest entries, found by float32 screening with proven rounding bounds.

A vector is cut into equal parts, and each part is replaced by the index of its nearest entry in that part's codebook. For a block of
parts x and entries c, one float32 matrix product gives s = |c|^2 - 2 x.c, which orders entries as the squared distance does. Rounding moves s by at most
``gamma * (2 |x| |c| + |c|^2)``, whatever the order of summation, so every s is an interval. Only entries whose interval overlaps that of the best one are
evaluated again, in int64, and of equal distances the lower index wins: no result depends on floating-point rounding.

Codebooks are refined in rounds. Tasks send one row of sums for each entry that they used; the codebooks themselves, ``entries`` vectors in all, are the only
thing that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, join_hot, written

#: Numbers of one float32 block of the product; blocks of rows are cut to it.
BLOCK = 1 << 20


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of ``c``, squared distance) for each row of ``x``; ties to the lower index. Both are int64 matrices.

    Exact as long as (2 m)^2 times the width fits in 63 bits, where m is the largest absolute component.
    """
    if not c.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    entries, first = np.unique(c, axis=0, return_index=True)  # of equal entries only the lowest index can win
    order = np.argsort(first)
    entries, first = entries[order], first[order]
    out, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    width = c.shape[1]
    unit = (width + 8) * 2.0**-24  # covers the rounding of the inputs, of the products and their sum, and of the last two operations
    gamma = unit / (1 - unit)
    square = (entries.astype(np.float64) ** 2).sum(1)
    low, norm = square.astype(np.float32), np.sqrt(square)
    flipped = entries.T.astype(np.float32)
    step = max(1, BLOCK // (len(entries) * max(1, width)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        s = (low - 2 * (part.astype(np.float32) @ flipped)).astype(np.float64)
        size = np.sqrt((part.astype(np.float64) ** 2).sum(1))
        slack = gamma * 1.01 * (2 * size[:, None] * norm + square)  # 1.01: for the float64 rounding of the bound itself
        row, entry = np.nonzero(s - slack <= (s + slack).min(1)[:, None])
        exact = ((part[row] - entries[entry]) ** 2).sum(1)
        begins = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(exact, begins)
        hit = np.flatnonzero(exact == best[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(part)))]  # the first hit of each row: entries stand by index
        out[a : a + step], error[a : a + step] = first[entry[hit]], best
    return out, error


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(col), width)


def _sums(books: np.ndarray):
    """Of each task's vectors: (part, entry, n, total), one row for each entry that is the nearest of some part."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column("w"), parts * wide)
            for p in range(parts):
                part = x[:, p * wide : (p + 1) * wide]
                at, _ = nearest(part, books[p])
                np.add.at(total[p], at, part)
                many[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(many)
        rows = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(many[part, entry]), rows], ["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    parts, _, wide = books.shape
    kind = np.dtype("u1") if books.shape[1] <= 256 else np.dtype("<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("w"), parts * wide)
            code, error = np.empty((len(x), parts), kind), np.zeros(len(x), np.int64)
            for p in range(parts):
                at, far = nearest(x[:, p * wide : (p + 1) * wide], books[p])
                code[:, p] = at
                error += far
            data = pa.py_buffer(code.tobytes())
            packed = pa.Array.from_buffers(pa.binary(parts * kind.itemsize), len(x), [None, data]).cast(pa.binary())
            kept = b.drop_columns(["w"])
            yield pa.RecordBatch.from_arrays([*kept.columns, packed, pa.array(error)], [*kept.schema.names, "code", "error"])

    return run


@dataclass
class Codes:
    """Codes of vectors: ``rows`` (the kept input columns, code as binary with one byte a part, or two, little-endian, beyond 256 entries, and error) and
    ``books`` (part, entry, place in the part)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """Hex SHA-256 of all entries' components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, weights: Column, keep: list[str], id_col: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codes:
    """Codes of all vectors by codebooks that ``rounds`` rounds fit to all of them.

    ``weights`` is an array of whole numbers, null where the row takes no part. All vectors must have one length, a multiple of ``parts``, and no component so large
    that a squared distance passes 62 bits; otherwise ValueError, before any work. Codebooks start with the parts of the ``entries`` vectors of smallest id (null ids last, equal ids by
    vector), fewer if there are fewer. A round replaces each entry by the floor of the mean of the parts nearest to it; entries without parts stay.
    Rows with null or repeated ids are coded like others. The columns ``keep`` are carried along. An empty table has no codes and empty codebooks.
    """
    if min(parts, entries) < 1 or entries > 1 << 16:
        raise ValueError("parts must be 1 or more, entries 1 to 65,536")
    spark = vectors.sparkSession
    renamed = {c: f"own{k}" for k, c in enumerate(keep)}
    rows = vectors.select(F.col(id_col).alias("id"), weights.cast("array<long>").alias("w"), *(F.col(f"`{c}`").alias(a) for c, a in renamed.items())).filter("w is not null")
    reach = F.greatest(F.abs(F.coalesce(F.array_max("w"), F.lit(0))), F.abs(F.coalesce(F.array_min("w"), F.lit(0))))
    n, short, long, far = rows.agg(F.count("*"), F.min(F.size("w")), F.max(F.size("w")), F.max(reach.cast("decimal(20,0)"))).first()
    if n and (short != long or long % parts):
        raise ValueError(f"vectors must have one length that {parts} divides, not {short} to {long}")
    wide = (long or 0) // parts
    if n and (max(1, long) * (2 * int(far)) ** 2 >= 1 << 62 or n * int(far) >= 1 << 62):
        raise ValueError(f"components up to {far} are too large for exact sums of {n} vectors in 64 bits")
    start = [r.w for r in rows.orderBy(F.col("id").asc_nulls_last(), "w").limit(entries).select("w").collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, wide).transpose(1, 0, 2).copy()
    for _ in range(rounds if n and wide else 0):
        sums = rows.select("w").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        place = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        got = place.toArrow()  # as many rows as the codebooks have numbers
        p, e, i, x, m = (got[c].to_numpy() for c in ("part", "entry", "place", "x", "n"))
        books[p, e, i] = x // m  # numpy's division of whole numbers goes down
    kinds = ", ".join(f"{a} {vectors.select(F.col(f'`{c}`')).schema[0].dataType.simpleString()}" for c, a in renamed.items())
    if len(start):
        coded = rows.select(*renamed.values(), "w").mapInArrow(_codes(books), f"{kinds}{', ' if kinds else ''}code binary, error long")
    else:
        coded = rows.select(*renamed.values(), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    names = free(keep, "code", "error")
    return Codes(coded.select(*(F.col(a).alias(c) for c, a in renamed.items()), *(F.col(c).alias(m) for c, m in zip(("code", "error"), names, strict=True))), books)


def restore(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with the vectors that they stand for as ``vector`` (array of long; with underscores before the name where it is taken)."""
    parts, entries, wide = books.shape
    kind = np.dtype("u1") if entries <= 256 else np.dtype("<u2")
    apart = [f"own{k}" for k in range(len(codes.columns))]
    spot = codes.columns.index(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(b"".join(b.column(spot).to_pylist()), kind).reshape(-1, parts)
            full = books[np.arange(parts), at].reshape(len(at), parts * wide)
            offsets = pa.array(np.arange(len(at) + 1) * parts * wide, pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(full.ravel()))], [*apart, "vector"])

    rows = codes.toDF(*apart)
    schema = T.StructType([*rows.schema.fields]).add("vector", T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, schema).toDF(*codes.columns, *free(codes.columns, "vector"))


def with_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` over rows of equal ``key`` (nulls together).

    Sums are combined before they are shuffled, and rows of frequent keys and of the null key stay where they are.
    ``rows`` is read several times and should be a table.
    """
    sums = written(rows.groupBy(key).agg(F.sum(value).alias(name), F.count("*").alias("n_of_key")), "totals")
    many = sums.agg(F.sum("n_of_key")).first()[0] or 0
    none = sums.filter(F.col(key).isNull()).select(name).first()
    named = join_hot(rows.filter(F.col(key).isNotNull()), sums.filter(F.col(key).isNotNull()), [key], "n_of_key", many, value).drop("n_of_key")
    return named.select(*rows.columns, name).unionByName(rows.filter(F.col(key).isNull()).withColumn(name, F.lit(none[0] if none else None).cast("long")))
