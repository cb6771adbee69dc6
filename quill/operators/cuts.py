"""Cuts of ordered items under caps: greedy parts by pointers into running sums, and blocks that no cut may split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import written
from . import scans


def greedy_parts(items: DataFrame, key: str, place: str, caps: dict[str, int]) -> DataFrame:
    """``items`` with ``part`` (from 0): items of a key in the order of ``place`` go on in the part of the one before while the part's sums stay under all ``caps``.

    ``place`` numbers a key's items from 0 without gaps. ``caps`` gives the cap of each weight column; weights aren't negative. An item over a cap is a part of its own. Where a
    part that began at an item ends is found by looking its running sum plus the cap up among all running sums; then pointers from part to part are followed by doubling. Items with null
    keys are left out.
    """
    kept = [c for c in items.columns if c != "part"]
    rows = items.select(*kept)
    sums = written(scans.running(rows, [key], [place], F.col(place), {f"__s{k}": (F.sum, F.col(w).cast("long")) for k, w in enumerate(caps)}), "sums")
    ends = None
    for k, (weight, cap) in enumerate(caps.items()):
        inside = sums.select(key, F.col(f"__s{k}").alias("v"), F.lit(0).alias("asks"), F.lit(1).cast("long").alias("one"), F.lit(None).cast("long").alias("at"))
        limit = F.col(f"__s{k}") - F.col(weight) + cap
        asked = sums.select(key, limit.alias("v"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("one"), F.col(place).cast("long").alias("at"))
        met = scans.running(inside.unionByName(asked), [key], ["v", "asks", "at"], F.col("v"), {"n": (F.sum, F.col("one"))}, piece=max(scans.PIECE, cap))
        found = met.filter("asks = 1").select(key, "at", F.col("n").alias(f"__n{k}"))
        ends = found if ends is None else ends.join(found, [key, "at"])
    onward = F.greatest(F.least(*(F.col(f"__n{k}") for k in range(len(caps)))) if len(caps) > 1 else F.col("__n0"), F.col("at") + 1)
    pointers = written(ends.select(key, "at", onward.alias("to")), "ends")
    last = pointers.groupBy(key).agg(F.max("at").alias("last"))
    pointers = pointers.join(last, key).select(key, "at", F.when(F.col("to") <= F.col("last"), F.col("to")).alias("to"))
    begins = scans.chain(pointers.filter("at = 0").select(key, "at"), pointers, key, "at", "to").select(key, F.col("at").alias(place), F.lit(1).alias("__begins"))
    out = scans.running(sums.join(begins, [key, place], "left"), [key], [place], F.col(place), {"part": (F.sum, F.coalesce("__begins", F.lit(0)))})
    return out.select(*kept, (F.col("part") - 1).cast("int").alias("part"))


def places(rows: DataFrame, key: str, order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place in their key, from 0, by a whole number ``order`` that is never twice in a key."""
    return scans.running(rows, [key], [order], F.col(order), {name: (F.sum, F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


def closed_blocks(units: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``units`` (key, sl, el, ...) with ``block`` (from 0): a cut between two units is allowed where no unit goes on beyond it and no span of ``pairs`` (key, lo, hi) holds it.

    Units have different first lines in a key. A cut lies behind the last line that any earlier unit reaches; a span holds it if it begins before and ends at it or later.
    """
    kept = units.columns
    reach = written(scans.running(units, [key], ["sl"], F.col("sl"), {"__cut": (F.max, F.col("el") + 1)}, own=False), "reach")
    asks = reach.filter("__cut is not null").select(key, F.col("__cut").cast("long").alias("v"), F.lit(0).alias("spans"), F.lit(None).cast("long").alias("hi"), F.col("sl").alias("sl"))
    spans = pairs.select(key, F.col("lo").cast("long").alias("v"), F.lit(1).alias("spans"), F.col("hi").cast("long").alias("hi"), F.lit(None).cast(dict(units.dtypes)["sl"]).alias("sl"))
    met = scans.running(asks.unionByName(spans), [key], ["v", "spans", "sl", "hi"], F.col("v"), {"far": (F.max, F.col("hi"))}).filter("spans = 0")
    held = met.select(key, "sl", (F.coalesce(F.col("far") >= F.col("v"), F.lit(False)) | (F.col("v") > F.col("sl"))).alias("__held"))
    marked = reach.join(held, [key, "sl"], "left")
    opens = F.when(F.coalesce("__held", F.lit(False)), 0).otherwise(1)  # nothing is asked of the first unit
    return scans.running(marked, [key], ["sl"], F.col("sl"), {"block": (F.sum, opens)}).select(*kept, (F.col("block") - 1).alias("block"))


def cut_files(units: DataFrame, pairs: DataFrame, key: str, caps: dict[str, int]) -> DataFrame:
    """(key, part, lo, hi, n_units, and the sum of each weight): ranges of a file's lines from the bottom up, under ``caps``, that split no unit and no span of pairs.

    Units (key, sl, el, weights) that a span ties together are one block; a block over a cap is a range of its own. Part 0 is the lowest. The lower of two ranges has the lines between their
    units, so a range's hi is its last unit's, and its lo the line behind the range above, or 1.
    """
    sums = [F.sum(w).alias(w) for w in caps]
    blocks = written(closed_blocks(units, pairs, key).groupBy(key, "block").agg(F.max("el").alias("hi"), F.count("*").alias("n_units"), *sums), "blocks")
    last = blocks.groupBy(key).agg(F.max("block").alias("last"))
    upward = blocks.join(last, key).withColumn("place", F.col("last") - F.col("block")).drop("last")
    ranges = written(greedy_parts(upward, key, "place", caps).groupBy(key, "part").agg(F.max("hi").alias("hi"), F.sum("n_units").alias("n_units"), *sums), "ranges")
    above = ranges.select(key, (F.col("part") - 1).alias("part"), (F.col("hi") + 1).alias("lo"))
    return ranges.join(above, [key, "part"], "left").select(key, "part", F.coalesce("lo", F.lit(1)).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "n_units", *caps)


def _upward(row: np.ndarray, weights: list[np.ndarray], caps: list[int]) -> np.ndarray:
    """The part of each block, from 0 at the last of its row upward: blocks go on in a part while its sums stay under all caps."""
    out, sums, part, own = [], [], 0, None
    for r, *w in zip(row[::-1].tolist(), *(x[::-1].tolist() for x in weights), strict=True):
        more = [a + b for a, b in zip(sums, w, strict=False)]
        if r != own:
            own, part, sums = r, 0, w
        elif any(a > cap for a, cap in zip(more, caps, strict=True)):
            part, sums = part + 1, w
        else:
            sums = more
        out.append(part)
    return np.array(out[::-1], np.int32)


def cut_rows(files: DataFrame, key: str, units: str, caps: dict[str, int]) -> DataFrame:
    """What :func:`cut_files` gives for files whose units stand in their row, and whose spans go from a unit to the last of its kind; each row is a file.

    ``units`` is an array of structs with the fields sl, kind and those of ``caps`` (whole numbers), a unit a line, in the order of sl. Nothing is shuffled. Rows with a null key, and those without
    units, are left out. A row takes as long as it has units, and some 20 times its size; longer files are for :func:`cut_files`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["u"].flatten()
            if not len(flat):
                continue
            sl, kind, *weights = flat.flatten()
            sl, weights = sl.to_numpy(), [w.to_numpy() for w in weights]
            row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(b["u"]), 0).to_numpy())
            place = np.arange(len(row))
            codes = kind.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
            _, which = np.unique(row * (codes.max() + 1) + codes, return_inverse=True)
            last = np.zeros(which.max() + 1, np.int64)
            np.maximum.at(last, which, place)
            far = np.maximum.accumulate(last[which])  # no unit of an earlier row reaches this one
            first = np.flatnonzero(np.append(True, far[:-1] < place[1:]))
            many, end = np.diff(np.append(first, len(row))), np.append(first[1:], len(row)) - 1
            sums = [np.add.reduceat(w, first) for w in weights]
            part = _upward(row[first], sums, list(caps.values()))
            head = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[first[1:]] != row[first[:-1]])))
            hi = sl[end[np.append(head[1:], len(part)) - 1]]
            same = np.append(False, row[first[head[1:]]] == row[first[head[:-1]]])
            lo = np.where(same, np.append(0, hi[:-1]) + 1, 1)
            cols = [pa.array(x) for x in (part[head], lo, hi, *(np.add.reduceat(x, head) for x in (many, *sums)))]
            yield pa.RecordBatch.from_arrays([b["k"].take(pa.array(row[first[head]])), *cols], ["k", "part", "lo", "hi", "n_units", *caps])

    fields = lambda u: F.struct(u["sl"].cast("long").alias("sl"), u["kind"].alias("kind"), *(u[w].cast("long").alias(w) for w in caps))
    rows = files.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.transform(units, fields).alias("u"))
    out = rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, part int, lo long, hi long, n_units long, {', '.join(f'`{w}` long' for w in caps)}")
    return out.withColumnRenamed("k", key)
