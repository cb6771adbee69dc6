"""Exact deduplication with an extendible-hash index, in DataFrame functions only.

A text's key is the 64-bit hash of its normalised form. The directory addresses buckets by the leading bits of keys: while a bucket holds more bytes of text
than its capacity it is split on the next bit, and the directory doubles to the depth of its deepest bucket. Buckets are key ranges; each is owned by one task, to which its rows
are routed once. There the texts of a key stand side by side in the order of their bytes, each is compared with its neighbour, and different ones are chained. Rows of frequent keys are
combined where they are read, so a text with a third of all rows reaches its owner as a few entries. The index (bucket, key, chain place, digest, smallest doc_id, size) and the directory are
tables in the shared folder. A document looks its verdict up by bucket and key, and by its text's SHA-256 where the key's chain has several.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, pieces, written


#: Bytes of different texts in a bucket, unless that took more than MOST_BUCKETS buckets.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 18
#: Keys of more than one in so many rows are combined before they are routed.
FREQUENT = 1000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Runs of ASCII white space that aren't one space already.
UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN, " ")


@dataclass
class Index:
    """``directory``: cell, bucket and depth at a global ``depth``; ``entries``: bucket, key, place (from 1) in a chain of ``chain`` texts, digest, keep_id and group_size."""

    directory: DataFrame
    depth: int
    entries: DataFrame

    def cell(self, key: str = "key") -> Column:
        return prefix(F.col(key), self.depth)

    def routed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (key, ...) with the buckets that the directory gives; those whose cell holds no bucket have no copies in the index and go."""
        cells = self.directory.select(F.col("cell").alias("__cell"), F.col("bucket"))  # at most 4 * MOST_BUCKETS rows by construction
        return rows.withColumn("__cell", self.cell()).join(F.broadcast(cells), "__cell").drop("__cell")


def prefix(key: Column, depth: int | Column, of: int = 64) -> Column:
    """The first ``depth`` bits of a key of ``of`` bits, as a long."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(key, of - depth) if depth else F.lit(0).cast("long")
    return F.call_function("shiftrightunsigned", key, F.lit(of) - depth)


def build_directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(cell, bucket, depth, n_bytes as a table; the directory's global depth) over ``keys`` (key, n_bytes), one row for each key.

    A bucket is a run of cells with the leading ``depth`` bits of its keys in common, named by its first cell. Each cell's bucket is the first one on the way from the root, which holds all keys, that
    isn't overfull. Evenly spread keys need the depth at which buckets are full on average and one more; below two more nothing is split, so keys that share
    more bits than that, and texts longer than a bucket, stay together. So there are at most four cells for each bucket's worth of bytes. Cells without keys are left out.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    capacity = max(bucket_bytes, math.ceil(total / MOST_BUCKETS))
    deepest = max(0, math.ceil(math.log2(max(1.0, total / capacity)))) + 2
    cells = written(keys.groupBy(prefix(F.col("key"), deepest).alias("leaf")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
    depth = F.col("depth")
    ways = cells.select("leaf", "n_bytes", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth")).withColumn("p", F.call_function("shiftright", F.col("leaf"), F.lit(deepest) - depth))
    nodes = ways.groupBy("depth", "p").agg(F.sum("n_bytes").alias("n_bytes"))
    full = (nodes["n_bytes"] > capacity) & (nodes["depth"] < deepest)
    settled = ways.drop("n_bytes").join(nodes.filter(~full), ["depth", "p"]).groupBy("leaf").agg(F.min_by(F.struct("depth", "p", "n_bytes"), "depth").alias("b"))
    buckets = written(settled.select("leaf", "b.*"), "buckets")
    top = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    cell = F.shiftright("leaf", deepest - top)
    first = F.call_function("shiftleft", F.col("p"), F.lit(top) - depth)
    return written(buckets.select(cell.alias("cell"), first.alias("bucket"), "depth", "n_bytes").distinct(), "directory"), top


def build_index(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Index:
    """The index of rows (doc_id, key, norm)."""
    keys = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("norm")).cast("long").alias("n_bytes")), "keys")
    directory, depth = build_directory(keys, bucket_bytes)
    index = Index(directory, depth, rows)
    total = keys.agg(F.sum("n")).first()[0] or 0
    frequent = written(keys.filter(F.col("n") * FREQUENT > total).select("key"), "frequent")  # fewer than FREQUENT of them
    one = rows.select("key", "norm", F.col("doc_id").alias("least"), F.lit(1).cast("long").alias("n"))
    entries = one.join(F.broadcast(frequent), "key", "left_anti")
    if not frequent.isEmpty():
        entries = entries.unionByName(one.join(F.broadcast(frequent), "key", "left_semi").groupBy("key", "norm").agg(F.min("least").alias("least"), F.sum("n").alias("n")))
    owned = index.routed(entries).repartition(max(1, pieces(rows.sparkSession)), "bucket")
    side_by_side = Window.partitionBy("bucket", "key").orderBy("norm", "least")
    owned = owned.withColumn("fresh", F.coalesce(F.col("norm") != F.lag("norm").over(side_by_side), F.lit(True)))
    placed = owned.withColumn("place", F.sum(F.col("fresh").cast("int")).over(side_by_side.rowsBetween(Window.unboundedPreceding, 0)))
    digest = F.max(F.when(F.col("fresh"), F.sha2(F.encode("norm", "utf-8"), 256))).alias("digest")
    chains = placed.groupBy("bucket", "key", "place").agg(digest, F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    index.entries = written(chains.withColumn("chain", F.max("place").over(Window.partitionBy("bucket", "key"))), "index")
    return index


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All input columns plus keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when they are byte for byte the same after each run of ASCII white space
    became one space; null counts as empty. Of equal texts the row with the smallest doc_id stays; doc_id may be of any type with an order.
    Rows repeated with one doc_id and text share that id's verdict; null doc_ids count in group_size
    and stay only where the whole class has none. Input columns with the names of results are replaced, others are left as they are.
    ``bucket_bytes`` shapes the index, never the result. An owner task sorts its rows and spills; it holds a few texts at a time.
    """
    return _verdicts(docs, bucket_bytes, F.xxhash64)


def _verdicts(docs: DataFrame, bucket_bytes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    apart = {c: f"own{k}" for k, c in enumerate(own)}  # no input column clashes with one of the index
    norm = normalised(F.col("text"))
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in apart.items()), F.col("doc_id"), norm.alias("norm"), hashed(norm).alias("key"))
    index = build_index(rows.select("doc_id", "key", "norm"), bucket_bytes)
    routed = index.routed(rows)
    verdict = ["keep_id", "group_size", "digest"]
    total = index.entries.agg(F.sum("group_size")).first()[0] or 0
    out = join_hot(routed.drop("norm"), index.entries.filter("chain = 1").select("bucket", "key", *verdict), ["bucket", "key"], "group_size", total, "doc_id")
    chained = index.entries.filter("chain > 1")
    if not chained.isEmpty():  # different texts under one key: these are told apart by the texts themselves
        keys = chained.select("bucket", "key").distinct()
        several = routed.join(keys, ["bucket", "key"], "left_semi").withColumn("digest", F.sha2(F.encode("norm", "utf-8"), 256)).drop("norm")
        out = out.unionByName(join_hot(several, chained.select("bucket", "key", *verdict), ["bucket", "key", "digest"], "group_size", total, "doc_id"))
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    return out.select(*(F.col(a).alias(c) for c, a in apart.items()), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
