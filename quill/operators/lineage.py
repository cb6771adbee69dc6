"""Ancestry over parent links alone: roots, depths, values along the way and ancestor tests, by doubled pointers.

Each row points at its parent; in a round every pointer is replaced by that of the row it points at, so a pointer spans twice as far and a chain of n rows
takes the logarithm of n in rounds. Rows whose pointer has come to the root take no further part. A round is one lookup of rows by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import lookup, written


@dataclass
class Lineage:
    """``nodes``: (node, root, depth, on_cycle, verified, nearest, nearest_steps), once for each node. ``jumps[k]``: (node, to) for nodes with an ancestor 2^k steps up."""

    nodes: DataFrame
    jumps: list[DataFrame]

    def ancestors(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b and others) with is_ancestor: whether a lies on b's way to its root, b itself included.

        b climbs as many steps as it lies deeper than a, one lookup for each bit of that number. Nodes that don't exist or hang on a cycle are nobody's ancestors and have none (false); a null gives null.
        """
        other = [c for c in pairs.columns if c not in ("a", "b")]
        at = self.nodes.filter("not on_cycle").select("node", "depth")
        rows = written(pairs.select(*other, "a", "b"), "pairs")
        rows = written(lookup(rows, at.select(F.col("node").alias("a"), F.col("depth").alias("__upper")), "a"), "pairs")
        rows = lookup(rows, at.select(F.col("node").alias("b"), F.col("depth").alias("__lower")), "b")
        rows = rows.withColumns({"__steps": F.col("__lower") - F.col("__upper"), "__at": F.col("b")})
        for k, jump in enumerate(self.jumps):
            rows = lookup(written(rows, "pairs"), jump.select(F.col("node").alias("__at"), F.col("to").alias("__to")), "__at")
            climbs = (F.col("__steps") > 0) & (F.shiftright("__steps", k).bitwiseAND(F.lit(1)) == 1)
            rows = rows.withColumn("__at", F.when(climbs, F.col("__to")).otherwise(F.col("__at"))).drop("__to")
        met = F.coalesce((F.col("__steps") >= 0) & (F.col("__at") == F.col("a")), F.lit(False))
        return rows.select(*other, "a", "b", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), met).alias("is_ancestor"))


def lineage(links: DataFrame, verified: Column | None = None, marked: Column | None = None) -> Lineage:
    """Roots, depths and what lies on the way up, from ``links`` (node, parent and columns that the conditions read).

    A node without a parent, or with one that isn't in the table, is a root at depth 0. ``verified``: true where the condition holds for the node and all its ancestors (null counts as false).
    ``nearest`` is the closest node from the node itself upwards for which ``marked`` holds, ``nearest_steps`` how far up it is; null where there is none. Nodes on a cycle, or hanging on one, never
    come to a root: on_cycle, and the rest null. Of several rows of a node the one with the smallest parent counts (null last), conditions held against ``links`` as it is. Null nodes are left out.
    An empty table gives empty results.
    """
    good = F.coalesce(verified, F.lit(False)) if verified is not None else F.lit(True)
    hit = F.coalesce(marked, F.lit(False)) if marked is not None else F.lit(False)
    rows = links.filter("node is not null").select("node", "parent", good.alias("good"), hit.alias("hit"))
    rows = rows.groupBy("node").agg(F.min(F.struct(F.col("parent").isNull().alias("none"), "parent", "good", "hit")).alias("r"))
    rows = written(rows.select("node", "r.parent", "r.good", "r.hit"), "links")
    known = lookup(rows, rows.select(F.col("node").alias("parent"), F.lit(True).alias("there")), "parent")
    up = F.when(F.col("there"), F.col("parent"))
    state = written(
        known.select(
            "node",
            up.alias("to"),
            F.when(up.isNull(), F.col("node")).alias("root"),
            F.when(up.isNull(), 0).otherwise(1).cast("long").alias("steps"),
            F.col("good").alias("good"),
            F.when(F.col("hit"), F.col("node")).alias("nearest"),
            F.when(F.col("hit"), F.lit(0)).cast("long").alias("near"),
        ),
        "pointers",
    )
    limit, jumps, done = max(1, state.count()).bit_length(), [], state.filter("to is null")
    live = state.filter("to is not null")
    for _ in range(limit):
        if live.isEmpty():
            break
        jumps.append(live.select("node", "to"))
        ahead = done.unionByName(live).select(
            F.col("node").alias("to"),
            F.struct(F.col("to").alias("to"), F.col("root").alias("root"), F.col("steps").alias("steps"), F.col("good").alias("good"), F.col("nearest").alias("nearest"), F.col("near").alias("near")).alias("up"),
        )
        state = written(
            lookup(live, ahead, "to").select(
                "node",
                F.col("up.to").alias("to"),
                F.col("up.root").alias("root"),
                (F.col("steps") + F.col("up.steps")).alias("steps"),
                (F.col("good") & F.col("up.good")).alias("good"),
                F.coalesce("nearest", "up.nearest").alias("nearest"),
                F.coalesce(F.col("near"), F.col("steps") + F.col("up.near")).alias("near"),
            ),
            "pointers",
        )
        done, live = done.unionByName(state.filter("to is null")), state.filter("to is not null")
    lost = F.lit(None)
    ended = done.select("node", "root", F.col("steps").alias("depth"), F.lit(False).alias("on_cycle"), F.col("good").alias("verified"), "nearest", F.col("near").alias("nearest_steps"))
    kind = {f.name: f.dataType for f in ended.schema.fields}
    cycles = live.select("node", *((F.lit(True) if c == "on_cycle" else lost.cast(kind[c])).alias(c) for c in ended.columns[1:]))
    return Lineage(ended.unionByName(cycles), jumps)
