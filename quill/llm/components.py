"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with v < u."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """In tasks of about 50,000 rows, where the session's shuffles would make more."""
    return df.coalesce(max(1, math.ceil(rows / 50_000)))


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """Edges with the least neighbour of their u; the edges of a centre of many are spread over all tasks."""
    return join_hot(edges, least, ["u"], "n", total, "v").drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(_sized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), 2 * total), "least")
    return _with_least(both, least, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = written(_sized(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), total), "least")
    near = _with_least(edges, least, total)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's smallest node.

    Each round is two aggregations and two joins by node, written to the shared folder; no neighbourhood is ever gathered in one
    place; edges of a node that has more than a thousandth of all meet its least neighbour by a broadcast of such nodes. Rounds grow with the logarithm of the largest component's size.
    Edges with a null end are dropped; loops leave their node out.
    """
    now = written(_canonical(edges.filter("u is not null and v is not null")), "edges")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    seen = now.agg(mark).first()[0]
    while seen[0]:
        star = written(_sized(_canonical(_large_star(now, seen[0])), seen[0]), "edges")
        now = written(_sized(_canonical(_small_star(star, seen[0])), seen[0]), "edges")
        done, seen = seen, now.agg(mark).first()[0]
        if done == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
