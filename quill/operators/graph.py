"""Breadth-first reachability over a link table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import numbered, written


def _checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="quill-"))
    return df.checkpoint()


def reachable(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(key, depth): nodes reached from ``seeds`` (key) over ``edges`` (src, dst) and their least depth.

    Each level is one join and one left-anti join against the nodes already visited; a node is visited when it is first
    found. Levels are checkpointed, so lineage stays short and lost executors cost one level. Cycles and repeated edges are
    harmless; nulls are dropped.
    """
    edges = edges.filter("src is not null and dst is not null").select("src", "dst").distinct()
    frontier = _checkpointed(seeds.select("key").filter("key is not null").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        found = frontier.join(edges, F.col("key") == F.col("src")).select(F.col("dst").alias("key")).distinct()
        frontier = _checkpointed(found.join(visited.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        visited = _checkpointed(visited.unionByName(frontier)) if depth % 8 == 0 else visited.unionByName(frontier)
    return visited


def visit_order(seeds: DataFrame, links: DataFrame, max_pages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(key, depth, place): the order in which a queue visits pages, from ``seeds`` (key, ord) over ``links`` (src, ord, dst).

    A page is marked when it is first put into the queue: seeds in their order, then the links of each page visited, in the order of visits and of the links on the page. So the places of a
    level follow from the places of its parents, and a level is one join, one minimum for each new page, one anti-join against the pages marked before and one numbering; nothing is walked one by
    one. Pages deeper than ``max_depth`` aren't queued; visits end with ``max_pages``, whose later levels can't change what comes before. Repeated links count where they first stand; nulls are dropped.
    """
    links = links.filter("src is not null and dst is not null").groupBy("src", F.col("dst").alias("key")).agg(F.min("ord").alias("ord"))
    new = seeds.filter("key is not null").groupBy("key").agg(F.struct(F.lit(0).cast("long").alias("parent"), F.min("ord").cast("long").alias("ord")).alias("spot"))
    depth, many, visited = 0, 0, None
    while True:
        level = numbered(new, [F.col("spot"), F.col("key")], "level").select("key", F.lit(depth).alias("depth"), (F.col("place") + many).alias("place"))
        if max_pages is not None:
            level = level.filter(F.col("place") < max_pages)
        level = written(level, "visits")
        count = level.count()
        visited = level if visited is None else visited.unionByName(level)
        many, depth = many + count, depth + 1
        if not count or (max_depth is not None and depth > max_depth) or (max_pages is not None and many >= max_pages):
            return visited
        found = level.select(F.col("key").alias("src"), F.col("place").alias("parent")).join(links, "src")
        firsts = found.groupBy("key").agg(F.min(F.struct("parent", F.col("ord").cast("long").alias("ord"))).alias("spot"))
        new = firsts.join(visited.select("key"), "key", "left_anti")
