"""Shards along a Hilbert curve over metadata, in DataFrame functions only.

Each dimension is quantised to 2^bits bins of about equal numbers of rows that keep the order of its values: a value's bin is the share of rows with smaller
values. The bins of a row are a cell, the cell's place on the Hilbert curve is found by a fold over the bits through a table of states, and
rows are range-partitioned and sorted by it. Neighbours on the curve are neighbours in every dimension, so runs of it are boxes with short sides: the least and
greatest value of a shard tells in most cases that a filter on any of the dimensions needn't read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

RESULTS = ("curve", "shard", "slot")


def states(dims: int) -> tuple[list[int], list[int], int]:
    """(digit, next state) by state * 2^dims + cell corner, and the number of states, of the Hilbert curve in ``dims`` dimensions.

    A state is an entry corner and a main axis. In a state, the corner is reflected at the entry and rotated so that the axis is the lowest; the place of
    the outcome in the Gray code is the digit. The part of the curve in that corner enters and runs as the Gray code does from there.
    """
    full = (1 << dims) - 1
    gray = [k ^ (k >> 1) for k in range(full + 1)]
    place = {g: k for k, g in enumerate(gray)}
    turn = lambda x, k: ((x << (k % dims)) | (x >> ((dims - k) % dims))) & full  # noqa: E731  (to the left)
    entry = [0] + [gray[2 * ((k - 1) // 2)] for k in range(1, full + 1)]
    low_ones = lambda k: (~k & (k + 1)).bit_length() - 1  # noqa: E731  (ones that end k in binary)
    axis = [0] + [(low_ones(k - 1) if k % 2 == 0 else low_ones(k)) % dims for k in range(1, full + 1)]
    number = {(0, 0): 0}
    digits: list[int] = []
    after: list[int] = []
    for e, d in (todo := [(0, 0)]):
        for corner in range(full + 1):
            digit = place[turn(corner ^ e, dims - (d + 1) % dims)]
            new = (e ^ turn(entry[digit], d + 1), (d + axis[digit] + 1) % dims)
            if new not in number:
                number[new] = len(number)
                todo.append(new)
            digits.append(digit)
            after.append(number[new])
    return digits, after, len(number)


def curve_index(bins: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of the cell with these coordinates, each from 0 to 2^bits - 1; a long."""
    dims = len(bins)
    if dims * bits > 62:
        raise ValueError("the curve's index must fit in 62 bits")
    if dims == 1:
        return bins[0].cast("long")
    digits, after, _ = states(dims)
    table = F.array(*(F.lit(d + (s << dims)) for d, s in zip(digits, after, strict=True)))
    start = F.struct(F.lit(0).cast("long").alias("curve"), F.lit(0).alias("state"))

    def step(acc: Column, level: Column) -> Column:
        corner = F.element_at(level, 1)
        for k in range(1, dims):
            corner = corner + F.element_at(level, k + 1) * (1 << k)
        found = F.element_at(table, acc["state"] * (1 << dims) + corner + 1)
        return F.struct((acc["curve"] * (1 << dims) + found.bitwiseAND((1 << dims) - 1)).alias("curve"), F.shiftright(found, dims).alias("state"))

    levels = F.array(*(F.array(*(F.shiftright(b.cast("int"), k).bitwiseAND(1) for b in bins)) for k in reversed(range(bits))))
    return F.aggregate(levels, start, step, lambda acc: acc["curve"])


def _ranged(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows as a table in global order, with ``pid`` and ``at``: the place in partition ``pid``, all of which comes before later partitions.

    Spark samples the order for the ranges; rows are dealt by all of it, so no value of its first columns needs to fit one task.
    """
    laid = rows.repartitionByRange(max(1, pieces(rows.sparkSession)), *order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    return written(laid.withColumns({"pid": F.shiftright("number", 33), "at": F.col("number").bitwiseAND((1 << 33) - 1)}).drop("number"), name)


def _offsets(laid: DataFrame, size: Column) -> tuple[DataFrame, int]:
    """(pid -> sum of ``size`` in all partitions before it, the whole sum); as many rows as there are partitions."""
    ahead, total = [], 0
    for r in sorted(laid.groupBy("pid").agg(F.sum(size).alias("size")).collect()):
        ahead.append((r["pid"], total))
        total += r["size"]
    return laid.sparkSession.createDataFrame(ahead, "pid long, ahead long"), total


def cut_points(rows: DataFrame, value: Column, bins: int) -> list[tuple[int, object]]:
    """(bin, smallest value in it) ascending, at most ``bins`` of them: a value's bin is floor(bins * rows with smaller values / rows). Nulls are the smallest.

    Values are counted before they are sorted, so a value in a third of all rows is one row here.
    """
    counts = _ranged(rows.groupBy(value.alias("v")).agg(F.count("*").alias("n")), [F.col("v").asc_nulls_first()], "cuts")
    ahead, total = _offsets(counts, F.col("n"))
    here = F.sum("n").over(Window.partitionBy("pid").orderBy("at")) - F.col("n")
    ranked = counts.withColumn("here", here).join(F.broadcast(ahead), "pid").withColumn("bin", F.expr(f"((ahead + here) * {bins}L) div {max(1, total)}L"))
    found = ranked.groupBy("bin").agg(F.min_by("v", F.struct("pid", "at")).alias("v")).collect()
    return sorted(((r["bin"], r["v"]) for r in found), key=lambda x: x[0])


def bin_of(value: Column, points: list[tuple[int, object]]) -> Column:
    """The bin of a value by the points of :func:`cut_points`."""
    out = F.lit(0)
    for k, least in points:
        if k:  # only bin 0 can begin with null
            out = F.when(value >= F.lit(least), F.lit(int(k))).otherwise(out)
    return out


def shard(docs: DataFrame, dims: dict[str, Column], shards: int = 40, bits: int = 5, ties: list[Column] | None = None) -> DataFrame:
    """All input columns plus curve, shard and slot: runs of the Hilbert curve with numbers of rows at most one apart.

    ``dims`` names the dimensions and gives their values (any type with an order; null is a value of its own, before all others). Rows of one cell
    stand in the order of ``ties``, then of a hash of all columns. Row g of n goes to shard floor(g * shards / n); slot counts from 0 in each
    shard. With fewer rows than shards some are empty. Input columns called like results are replaced. ``docs`` is read once for each dimension, with its
    columns alone, and once in whole; its rows are sorted with all their columns, so give narrow rows where only the placing is wanted.
    """
    if shards < 1 or bits < 1 or not dims:
        raise ValueError("shards and bits must be 1 or more, and there must be a dimension")
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    apart = {c: f"own{k}" for k, c in enumerate(own)}
    cells = [bin_of(value, cut_points(docs, value, 1 << bits)) for value in dims.values()]
    order = {"curve": curve_index(cells, bits), **{f"tie{k}": t for k, t in enumerate(ties or [])}, "spread": F.xxhash64(*(F.col(f"`{c}`") for c in own))}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in apart.items()), *(c.alias(a) for a, c in order.items()))
    laid = _ranged(rows, [F.col(a).asc_nulls_first() for a in order], "curve")
    ahead, n = _offsets(laid, F.lit(1).cast("long"))
    out = laid.join(F.broadcast(ahead), "pid").withColumn("g", F.col("ahead") + F.col("at")).withColumn("shard", F.expr(f"cast((g * {shards}L) div {max(1, n)}L as int)"))
    out = out.withColumn("slot", F.col("g") - F.expr(f"(shard * {max(1, n)}L + {shards - 1}L) div {shards}L"))
    return out.select(*(F.col(a).alias(c) for c, a in apart.items()), "curve", "shard", "slot")


def write_shards(docs: DataFrame, dims: dict[str, Column], path: str, shards: int = 40, bits: int = 5, ties: list[Column] | None = None) -> DataFrame:
    """Write the rows as Parquet under ``path``, a folder shard=k for each shard with its rows in order, and return the manifest: shard, n_rows, and least_d and most_d for
    each dimension d. The manifest is written beside them, under ``path``/_manifest."""
    out = shard(docs, dims, shards, bits, ties)
    out.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/shards")
    got = docs.sparkSession.read.parquet(f"{path}/shards")
    ends = [f(dims[d]).alias(f"{name}_{d}") for d in dims for f, name in ((F.min, "least"), (F.max, "most"))]
    nulls = [F.count_if(dims[d].isNull()).alias(f"nulls_{d}") for d in dims]
    got.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends, *nulls).coalesce(1).write.parquet(f"{path}/_manifest")
    return docs.sparkSession.read.parquet(f"{path}/_manifest")


def read_box(spark, path: str, dims: dict[str, Column], box: dict[str, tuple[object, object]]) -> tuple[DataFrame, list[int]]:
    """(rows whose dimensions lie between the two bounds given, shards that were read): shards whose manifest excludes the box aren't opened."""
    manifest = spark.read.parquet(f"{path}/_manifest")
    overlap = F.lit(True)
    inside = F.lit(True)
    for d, (low, high) in box.items():
        overlap = overlap & (F.col(f"least_{d}") <= F.lit(high)) & (F.col(f"most_{d}") >= F.lit(low))
        inside = inside & dims[d].between(low, high)
    wanted = sorted(r["shard"] for r in manifest.filter(overlap).select("shard").collect())
    rows = spark.read.parquet(f"{path}/shards")
    return rows.filter(F.col("shard").isin(wanted)).filter(inside), wanted
