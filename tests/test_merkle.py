"""Trees of hashes: equal tables, differences against a plain comparison, and how few nodes are compared."""

from quill.operators import merkle


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string").repartition(4)


def test_order_and_partitioning_do_not_matter(spark):
    rows = [(i, f"x{i}", None if i % 3 else "") for i in range(300)] + [(5, "x5", "twice")] * 2
    one = merkle.tree(table(spark, rows), "id", ["a", "b"], depth=2)
    two = merkle.tree(table(spark, rows[::-1]).repartition(7), "id", ["a", "b"], depth=2)
    assert sorted(map(tuple, one.nodes().collect())) == sorted(map(tuple, two.nodes().collect()))
    assert one.levels[0].first().n == 302
    keys, compared = merkle.differences(one, two)
    assert keys.collect() == [] and compared == 1 + 0 + 0


def test_differences(spark):
    rows = {i: [(f"x{i}", "b")] for i in range(2000)}
    rows[7] *= 2
    rows[None] = [("null key", None)]
    old = [(k, *v) for k, vs in rows.items() for v in vs]
    rows[7] = rows[7][:1]  # one copy fewer
    rows[8] = [("x", "8b")]  # the same characters in other columns
    rows[None] = [("null key", "")]
    del rows[9]
    rows[-1] = [(None, None)]
    new = [(k, *v) for k, vs in rows.items() for v in vs]
    a = merkle.tree(table(spark, old), "id", ["a", "b"])
    b = merkle.tree(table(spark, new), "id", ["a", "b"], depth=len(a.levels) - 1)
    keys, compared = merkle.differences(a, b)
    assert {(r.key, r.change) for r in keys.collect()} == {(7, "changed"), (8, "changed"), (None, "changed"), (9, "removed"), (-1, "added")}
    assert len(a.levels) == 3 and compared <= 1 + 5 * 16 + 16 and compared < a.nodes().count()


def test_nothing_and_all_new(spark):
    none, some = table(spark, []), table(spark, [(i, "t", "u") for i in range(20)])
    empty, full = (merkle.tree(t, "id", ["a", "b"], depth=1) for t in (none, some))
    assert empty.nodes().collect() == []
    assert {(r.key, r.change) for r in merkle.differences(empty, full)[0].collect()} == {(i, "added") for i in range(20)}
    assert merkle.differences(empty, empty)[0].collect() == []
