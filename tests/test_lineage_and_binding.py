"""Ancestry by doubled pointers and one-to-one bindings, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quill.operators.binding import bind_once
from quill.operators.lineage import lineage
from quill.staging import lookup, written


def climb(parent, n):
    """Nodes from n up to its root, or None where the way never ends."""
    way, seen = [n], {n}
    while parent.get(way[-1]) in parent:
        up = parent[way[-1]]
        if up in seen:
            return None
        way.append(up)
        seen.add(up)
    return way


def test_lineage(spark):
    rng = random.Random(4)
    parent = {0: None, 1: 0, 2: 1, 500: 501, 501: 502, 502: 500, 503: 501, 600: 600, 700: 9999}
    for i in range(3, 130):
        parent[i] = i - 1 if i < 70 else rng.choice([0, 0, 0, rng.randrange(i), 699 + rng.randrange(2)])
    good, hit = {n for n in parent if rng.random() < 0.97}, {n for n in parent if rng.random() < 0.2}
    df = spark.createDataFrame([(n, p, n in good, n in hit or None) for n, p in parent.items()] + [(None, 3, True, True)], "node long, parent long, good boolean, hit boolean").repartition(3)
    tree = lineage(df, F.col("good"), F.col("hit"))
    got = {r.node: r for r in tree.nodes.collect()}
    assert set(got) == set(parent)
    for n in parent:
        way, r = climb(parent, n), got[n]
        if way is None:
            assert r.on_cycle and (r.root, r.depth, r.verified, r.nearest) == (None,) * 4
            continue
        marks = [k for k, x in enumerate(way) if x in hit]
        assert (r.root, r.depth, r.on_cycle, r.verified) == (way[-1], len(way) - 1, False, all(x in good for x in way))
        assert (r.nearest, r.nearest_steps) == ((way[marks[0]], marks[0]) if marks else (None, None))
    pairs = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(300)] + [(0, b) for b in range(60, 75)] + [(5, 5), (None, 1), (1, None), (77777, 1), (600, 600)]
    out = tree.ancestors(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long")).collect()
    assert len(out) == len(pairs)
    for r in out:
        want = None if r.a is None or r.b is None else r.a in (climb(parent, r.b) or ()) if r.b in parent else False
        assert r.is_ancestor == want


def test_lineage_of_nothing_and_of_repeated_nodes(spark):
    none = spark.createDataFrame([], "node string, parent string")
    empty = lineage(none)
    assert empty.nodes.collect() == [] and empty.ancestors(spark.createDataFrame([("x", "y")], "a string, b string")).first().is_ancestor is False
    rows = spark.createDataFrame([("c", "b"), ("c", None), ("c", "a"), ("a", None), ("b", "a")], "node string, parent string")
    assert {r.node: (r.root, r.depth) for r in lineage(rows).nodes.collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 1)}


def test_lookup_of_frequent_and_null_keys(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, None, rng.randrange(2000), 5000])) for i in range(4000)]
    df = written(spark.createDataFrame(rows, "i int, k int"), "rows")
    entries = written(spark.range(2000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 7).alias("v")), "entries")
    got = {r.i: (r.k, r.v) for r in lookup(df, entries, "k").collect()}
    assert got == {i: (k, k * 7 if k is not None and k < 2000 else None) for i, k in rows}


def walk(events, latest):
    """(opener, closer) of one key's events [(at, opens)] by walking them."""
    free, out = [], []
    for at, opens in events:
        if opens:
            free.append(at)
        else:
            out.append((free.pop(-1 if latest else 0) if free else None, at))
    return sorted(out + [(at, None) for at in free], key=str)


@pytest.mark.parametrize("latest", [False, True])
def test_bind_once(spark, latest):
    rng = random.Random(6)
    events = {"hot": [(i, rng.random() < 0.5) for i in range(900)], "open": [(i, True) for i in range(5)], "shut": [(i, False) for i in range(5)], "mixed": [(i, rng.random() < 0.4) for i in range(60)]}
    rows = [(k, at, "o" if opens else "c") for k, e in events.items() for at, opens in e] + [("hot", 5, "x"), (None, 1, "o"), (None, 2, "c"), ("hot", 7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, at int, kind string").repartition(4)
    got = {}
    for r in bind_once(df, "u", ["at"], F.col("kind") == "o", F.col("kind") == "c", latest, piece=16).collect():
        got.setdefault(r.u, []).append((r.opener and r.opener.at, r.closer and r.closer.at))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: walk(e, latest) for k, e in events.items()}
    assert bind_once(df.filter("false"), "u", ["at"], F.col("kind") == "o", F.col("kind") == "c", latest).collect() == []
