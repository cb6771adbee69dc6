"""Content hashes of a table as a tree over prefixes of its hashed keys, and the difference of two trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import written

#: Hexadecimal digits of a hash that are summed as one number; four of them cover 240 of its 256 bits.
LANE = 15


@dataclass
class Tree:
    """``levels[d]``: (prefix, n, hash) with prefixes of d hexadecimal digits; ``levels[0]`` is the root. ``entries``: (path, key, row, n), the different rows of each key."""

    levels: list[DataFrame]
    entries: DataFrame

    def nodes(self) -> DataFrame:
        """(level, prefix, n, hash) of all nodes."""
        out = [t.select(F.lit(d).alias("level"), "prefix", "n", "hash") for d, t in enumerate(self.levels)]
        first, *rest = out
        for t in rest:
            first = first.unionByName(t)
        return first


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as text with their lengths, so neighbouring values, nulls and empty texts can't be taken for each other."""
    text = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    return F.sha2(F.concat(*(text(c) for c in columns)), 256)


def tree(rows: DataFrame, key: str, values: list[str], depth: int | None = None, leaf: int = 16) -> Tree:
    """The tree of a table's rows: two tables have the same root if they have the same rows, in any order and any partitioning, and but for chance only then.

    A key's place is the SHA-256 of its text; a node covers the keys whose place begins with its prefix. Bottom nodes sum the hashes of their entries, which combines before the shuffle and takes
    repeated rows as one entry with a count, so no key or prefix is one task's list; each node above hashes its up to 16 children in order. ``depth``: digits of a bottom prefix, by default the
    fewest that give ``leaf`` entries or fewer to a node on average. Trees are compared at one depth. Nulls are values like others, null keys one key. An empty table has no nodes.
    """
    path = F.sha2(F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")), 256)
    entries = rows.select(path.alias("path"), F.col(key).alias("key"), row_hash(*(F.col(v) for v in values)).alias("row")).groupBy("path", "key", "row").agg(F.count("*").alias("n"))
    entries = written(entries, "entries")
    if depth is None:
        many, depth = entries.count(), 0
        while 16**depth * leaf < many:
            depth += 1
    each = entries.withColumn("h", F.sha2(F.concat_ws(":", "path", "row", F.col("n").cast("string")), 256))
    lanes = [F.conv(F.substring("h", 1 + LANE * i, LANE), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = each.groupBy(F.substring("path", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)))
    bottom = sums.select("prefix", "n", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("hash"))
    levels = [written(bottom, "nodes")]
    for d in range(depth - 1, -1, -1):
        up = levels[0].groupBy(F.substring("prefix", 1, d).alias("up")).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("prefix", "hash"))).alias("c"))
        levels.insert(0, written(up.select(F.col("up").alias("prefix"), "n", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["prefix"], x["hash"])), ""), 256).alias("hash")), "nodes"))
    return Tree(levels, entries)


def differences(old: Tree, new: Tree) -> tuple[DataFrame, int]:
    """((key, change), nodes): the keys whose rows aren't the same in both, ``added``, ``removed`` or ``changed``, and how many nodes were compared.

    Nodes are compared from the root down, below those that differ only, so few changes compare few nodes: at most 16 for each change and level. Entries are compared under bottom nodes that differ.
    """
    if len(old.levels) != len(new.levels):
        raise ValueError("trees of one depth are compared; give tree() the depth")
    compared, frontier = 0, None
    for d, (a, b) in enumerate(zip(old.levels, new.levels, strict=True)):
        if frontier is not None:
            under = F.substring("prefix", 1, d - 1)
            a, b = (t.withColumn("up", under).join(frontier.select(F.col("prefix").alias("up")), "up", "left_semi").drop("up") for t in (a, b))
        both = a.select("prefix", F.col("hash").alias("was")).join(b.select("prefix", F.col("hash").alias("now")), "prefix", "full")
        both = written(both, "compared")
        compared += both.count()
        frontier = both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("prefix")
    here = [t.entries.withColumn("prefix", F.substring("path", 1, len(old.levels) - 1)).join(frontier, "prefix", "left_semi") for t in (old, new)]
    rows = here[0].withColumn("side", F.lit(-1)).unionByName(here[1].withColumn("side", F.lit(1)))
    rows = rows.groupBy("path", "key", "row").agg(F.sum(F.col("n") * F.col("side")).alias("more"), F.max(F.col("side") == -1).alias("was"), F.max(F.col("side") == 1).alias("now"))
    keys = rows.groupBy("path", "key").agg(F.max(F.col("more") != 0).alias("differs"), F.max("was").alias("was"), F.max("now").alias("now")).filter("differs")
    return keys.select("key", F.when(~F.col("was"), "added").when(~F.col("now"), "removed").otherwise("changed").alias("change")), compared
