"""Best-first choice of spans that don't overlap, in rounds instead of one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written


def best_first(spans: DataFrame, key: str, order: list[Column], places: str, width: str) -> DataFrame:
    """The rows of ``spans`` that a greedy choice takes, key by key: from the best on, each whose first place overlaps no place of one that was taken before.

    ``places`` holds the starts of a row's spans in ascending order, ``width`` their length. ``order`` makes smaller better and must tell a key's rows apart. A row is blocked by those
    better rows of its key that stand where it first stands; these pairs are found by the cells that both cover. In each round the rows that nothing live blocks are taken, what they block goes, and
    the rest stays for the next, so the outcome is that of the choice one by one, in as many rounds as blocks build on each other.
    """
    rows = written(spans.withColumn("__rank", F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))), "spans")
    at = F.col(places)
    covered = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + F.col(width) - 1))))
    first = F.sequence(F.element_at(at, 1), F.element_at(at, 1) + F.col(width) - 1)
    better = rows.select(key, F.col("__rank").alias("b"), F.explode(covered).alias("cell"))
    worse = rows.select(key, F.col("__rank").alias("w"), F.explode(first).alias("cell"))
    blocks = written(worse.join(better, [key, "cell"]).filter("b < w").select(key, "b", "w").distinct(), "blocks")
    live = rows.select(key, F.col("__rank").alias("r"))
    taken = None
    while not live.isEmpty():
        free = written(live.join(blocks.select(key, F.col("w").alias("r")).distinct(), [key, "r"], "left_anti"), "taken")
        taken = free if taken is None else taken.unionByName(free)
        gone = free.unionByName(blocks.join(free.withColumnRenamed("r", "b"), [key, "b"], "left_semi").select(key, F.col("w").alias("r")))
        live = written(live.join(gone, [key, "r"], "left_anti"), "live")
        on = blocks.join(live.withColumnRenamed("r", "b"), [key, "b"], "left_semi")
        blocks = written(on.join(live.withColumnRenamed("r", "w"), [key, "w"], "left_semi").select(key, "b", "w"), "blocks")
    if taken is None:
        return rows.drop("__rank")
    return rows.join(taken.withColumnRenamed("r", "__rank"), [key, "__rank"], "left_semi").select(*spans.columns)
