"""Packing into length buckets with least padding.

Documents are cut into pieces of at most ``max_len`` tokens. The histogram of all pieces' lengths (``max_len`` counts at most) goes to the
driver, where dynamic programming finds the bucket boundaries that minimise padding. Inside a bucket, pieces form batches
of a token budget; :func:`emit` gives their ids. Places in a bucket are numbered in parallel: within hashed strips first, then strips are set end to end.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .mixing import n_tokens


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets over ascending ``lengths`` with least total padding. Ties go to the smaller earlier end."""
    n = len(lengths)
    if not n:
        return []
    many, mass = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    cost = lengths * many[1:] - mass[1:]  # one bucket for the first i + 1 lengths
    back = []
    for _ in range(1, min(buckets, n)):
        new, arg = cost.copy(), np.full(n, -1)
        for j in range(1, n):
            c = cost[:j] + lengths[j] * (many[j + 1] - many[1 : j + 1]) - (mass[j + 1] - mass[1 : j + 1])
            i = int(c.argmin())
            if c[i] < new[j]:
                new[j], arg[j] = c[i], i
        cost = new
        back.append(arg)
    ends, j = [n - 1], n - 1
    for arg in reversed(back):
        if arg[j] >= 0:
            j = int(arg[j])
            ends.append(j)
    return [int(lengths[k]) for k in reversed(ends)]


def pack(docs: DataFrame, max_len: int = 2048, buckets: int = 8, budget: int = 65_536, tokens: Column | None = None, strip: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, bucket, batch, slot: one row for each piece of each document.

    ``tokens`` is a document's number of tokens, by default its words and one for its end; null or less than 1 counts as 1. Piece k
    covers tokens start .. start + length - 1 with start = k * max_len. bucket is the padded length; a batch (numbered from 0 in its
    bucket) has max(1, budget // bucket) slots, so all batches of a bucket but the last are full. Order in a bucket is by a hash, then doc_id,
    text and piece: repeated rows and null ids are packed like others.
    """
    if min(max_len, buckets, budget) < 1:
        raise ValueError("max_len, buckets and budget must be 1 or more")
    count = F.greatest(F.coalesce((n_tokens(F.col("text")) if tokens is None else tokens).cast("long"), F.lit(1)), F.lit(1))
    rows = written(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), count.alias("n")), "lengths")
    rest = F.pmod(F.col("n") - 1, F.lit(max_len)) + 1  # the last piece's length
    sizes = rows.groupBy(rest.alias("length")).agg(F.count("*").alias("c"), F.sum(F.floor((F.col("n") - 1) / max_len)).alias("full")).toPandas()
    hist = np.zeros(max_len + 1, np.int64)
    hist[sizes["length"].to_numpy(np.int64)] += sizes["c"].to_numpy(np.int64)
    hist[max_len] += int(sizes["full"].sum())
    lengths = np.flatnonzero(hist)
    ends = boundaries(lengths, hist[lengths], buckets) or [max_len]
    strips = max(1, math.ceil(int(hist.sum()) / strip))

    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len).cast("long")))
    pieces = rows.select("doc_id", "th", "n", piece.alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * max_len).withColumn("length", F.least(F.lit(max_len).cast("long"), F.col("n") - F.col("start")))
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("length") <= end, F.lit(end)).otherwise(bucket)
    pieces = pieces.withColumn("bucket", bucket.cast("long")).withColumn("strip", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(strips)))
    sums = pieces.groupBy("bucket", "strip").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("bucket").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", "strip", F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket", "strip").orderBy("doc_id", "th", "piece")
    place = F.col("offset") + F.row_number().over(within) - 1
    slots = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))).cast("long")
    out = pieces.join(offsets, ["bucket", "strip"]).withColumn("place", place).withColumn("slots", slots)
    return out.select("doc_id", "piece", "start", "length", "bucket", F.floor(F.col("place") / F.col("slots")).alias("batch"), F.pmod("place", "slots").alias("slot"))


def emit(packed: DataFrame, ids: DataFrame, pad_id: int = 0) -> DataFrame:
    """bucket, batch, slot, doc_id, length, ids: each packed piece with its token ids, filled up to its bucket with ``pad_id``.

    ``ids`` has doc_id and ids (little-endian unsigned 32-bit numbers end to end), as ``token_output.read_ids`` gives them; ids come out in that form
    too. Each doc_id must be there once, and pieces must have been measured by the same ids; pieces of ids that are missing have null.
    """
    part = F.substring(F.col("ids"), (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    filled = F.rpad(part, (4 * F.col("bucket")).cast("int"), F.lit(pad_id.to_bytes(4, "little")))
    return packed.join(ids.select("doc_id", "ids"), "doc_id", "left").select("bucket", "batch", "slot", "doc_id", "length", filled.alias("ids"))
