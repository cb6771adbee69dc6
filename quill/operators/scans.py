"""Scans along ordered rows whose groups may be larger than a task: running sums and maxima, states of automata, and chains of pointers.

A scan works in levels. Rows are cut into pieces by their place, each piece is scanned or summarised for itself, the summaries are scanned in the same
way, and what comes before a piece is then applied to it. So one document with half of all lines is many tasks like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: Rows of a piece of a running scan, and children of a node in the tree of an automaton's scan.
PIECE, FAN = 4096, 64


def running(rows: DataFrame, key: list[str], order: list[str], place: Column, of: dict[str, tuple[Callable, Column]], piece: int = PIECE, own: bool = True) -> DataFrame:
    """``rows`` with, for each name of ``of``, its function (F.sum or F.max) over all rows of the key up to and including the row, or without it if not ``own``.

    ``place`` is a whole number that never falls along ``order``; pieces hold the rows of ``piece`` neighbouring values of it. Rows are in a defined order where
    ``order`` has no ties. Sums and maxima of nothing are null; rows with a null key or place are left out.
    """
    rows = rows.withColumns({f"__v{k}": value for k, (_, value) in enumerate(of.values())}).withColumn("__piece", F.floor(place / piece))
    by = [*key, "__piece"]
    totals = rows.groupBy(*by).agg(*(f(f"__v{k}").alias(f"__t{k}") for k, (f, _) in enumerate(of.values())))
    ahead = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, *(f(f"__t{k}").over(ahead).alias(f"__c{k}") for k, (f, _) in enumerate(of.values())))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    local = rows.withColumns({f"__l{k}": f(f"__v{k}").over(inside) for k, (f, _) in enumerate(of.values())})
    both = local.join(carry, by)
    out = {}
    for k, (name, (f, _)) in enumerate(of.items()):
        a, b = F.col(f"__c{k}"), F.col(f"__l{k}")
        out[name] = F.greatest(a, b) if f is F.max else F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    kept = [c for c in rows.columns if not c.startswith("__")]
    return both.select(*kept, *(c.alias(n) for n, c in out.items()))


def automaton(rows: DataFrame, key: str, at: str, symbol: str, delta: list[list[int]], keep: tuple[str, ...] = (), start: int = 0, fan: int = FAN) -> DataFrame:
    """(key, at, symbol, keep..., before, after): the automaton's state before and after each row, from ``start`` before the first row of each key.

    ``at`` numbers the rows of a key from 0 without gaps, ``symbol`` is a row of ``delta``, which gives the next state of each state. A row is a map from states to
    states; maps compose, so the tree of a key's rows holds the map of each of its nodes, at most ``fan`` children to a node. States then come down the tree. Each level is
    written; there are as many as the logarithm of the longest key's rows to the base ``fan``.
    """
    states = range(len(delta[0]))
    table = F.array(*(F.array(*(F.lit(q) for q in row)) for row in delta))
    step = lambda q, s: F.element_at(F.element_at(table, s + 1), q + 1)
    keyed = F.col(key).alias("k")
    level = rows.select(keyed, F.floor(F.col(at) / fan).alias("node"), F.struct(F.col(at).cast("long").alias("i"), F.col(symbol).cast("int").alias("s"), *(F.col(c).alias(f"x{n}") for n, c in enumerate(keep))).alias("c"))
    nodes = [written(level.groupBy("k", "node").agg(F.sort_array(F.collect_list("c")).alias("c")), "states")]
    longest = nodes[0].agg(F.max("node")).first()[0]
    everything = F.array(*(F.lit(q) for q in states))
    maps = nodes[0].select("k", "node", F.aggregate("c", everything, lambda acc, x: F.transform(acc, lambda q: step(q, x["s"]))).alias("m"))
    while longest:  # more than one node in some key
        level = maps.select("k", F.floor(F.col("node") / fan).alias("node"), F.struct(F.col("node").alias("i"), F.col("m").alias("m")).alias("c"))
        nodes.append(written(level.groupBy("k", "node").agg(F.sort_array(F.collect_list("c")).alias("c")), "states"))
        maps = nodes[-1].select("k", "node", F.aggregate("c", everything, lambda acc, x: F.transform(acc, lambda q: F.element_at(x["m"], q + 1))).alias("m"))
        longest //= fan
    entry = nodes[-1].select("k", "node", F.lit(start).alias("q"))
    for k in reversed(range(len(nodes))):
        tree = nodes[k].join(entry, ["k", "node"])
        if k:
            seen = F.aggregate("c", F.array("q"), lambda acc, x: F.concat(acc, F.array(F.element_at(x["m"], F.element_at(acc, -1) + 1))))
        else:
            seen = F.aggregate("c", F.array("q"), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x["s"]))))
        children = tree.select("k", "c", seen.alias("q")).select("k", "q", F.posexplode("c").alias("p", "x"))
        if k:
            entry = written(children.select("k", F.col("x.i").alias("node"), F.element_at("q", F.col("p") + 1).alias("q")), "entries")
    before, then = F.element_at("q", F.col("p") + 1), F.element_at("q", F.col("p") + 2)
    return children.select(F.col("k").alias(key), F.col("x.i").alias(at), F.col("x.s").alias(symbol), *(F.col(f"x.x{n}").alias(c) for n, c in enumerate(keep)), before.alias("before"), then.alias("after"))


def chain(heads: DataFrame, pointers: DataFrame, key: str, at: str, to: str) -> DataFrame:
    """(key, at): the rows that are reached from ``heads`` (key, at) over ``pointers`` (key, at, to), heads included.

    Pointers are doubled: in each round every reached row reaches what its pointer leads to, and pointers are replaced by two steps of themselves. So a chain of n rows takes
    log n rounds, each two joins. Pointers must lead forward; those without a target end their chain. Each row has one pointer at most.
    """
    reached = heads.select(key, at).distinct()
    steps = written(pointers.filter(F.col(to).isNotNull()).select(key, at, to), "pointers")
    while not steps.isEmpty():
        new = reached.join(steps, [key, at]).select(key, F.col(to).alias(at))
        reached = written(reached.unionByName(new).distinct(), "reached")
        onward = steps.select(key, F.col(at).alias(to), F.col(to).alias("__on"))
        steps = written(steps.join(onward, [key, to]).select(key, at, F.col("__on").alias(to)), "pointers")
    return reached
