"""Integrity as queries that return problem rows: references, versions, intervals and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reference_problems(defs: DataFrame, refs: DataFrame, key: str, names: tuple[str, str, str]) -> DataFrame:
    """(key, problem): references without a definition, definitions never referred to, keys referred to more than once."""
    d, r = defs.select(key), refs.select(key)
    issue = lambda df, name: df.select(key, F.lit(name).alias("problem"))
    twice = r.groupBy(key).count().filter("count > 1")
    return issue(r.join(d, key, "left_anti"), names[0]).unionByName(issue(d.join(r, key, "left_anti"), names[1])).unionByName(issue(twice, names[2]))


def compare(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, problem): rows missing after, extra rows, and the fields that differ (nulls are equal). Keys are unique on both sides."""
    a = before.select(*keys, *(F.col(f).alias(f"__a_{f}") for f in fields), F.lit(True).alias("__a"))
    b = after.select(*keys, *(F.col(f).alias(f"__b_{f}") for f in fields), F.lit(True).alias("__b"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"__a_{f}").eqNullSafe(F.col(f"__b_{f}")), F.lit(f)) for f in fields)))
    problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.size(changed) > 0, F.concat(F.lit("differs: "), F.array_join(changed, ", ")))
    return a.join(b, keys, "full_outer").select(*keys, problem.alias("problem")).filter("problem is not null")


STRIP, MOST_STRIPS = 1024, 64


def _strips(lo: str, hi: str) -> Column:
    """The strips of lines that a range touches; a wide range has none and is met by its path alone."""
    first, last = F.floor(F.col(lo) / STRIP), F.floor(F.col(hi) / STRIP)
    return F.when(last - first < MOST_STRIPS, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """(path, a, b): pairs of ranges (path, ord, lo, hi) of one path that share a line; a null range is the whole file.

    Ranges meet in strips of lines, each pair in the strip where the later one begins; ranges over many strips meet the others of their path.
    """
    whole = ranges.select("path", "ord", F.coalesce("lo", F.lit(1)).alias("lo"), F.coalesce("hi", F.lit(2147483647)).alias("hi")).filter("lo <= hi")
    dealt = whole.withColumn("strip", F.explode_outer(_strips("lo", "hi")))
    a, b = dealt.alias("a"), dealt.alias("b")
    both = (F.col("a.path") == F.col("b.path")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))
    pair = [F.col("a.path").alias("path"), F.col("a.ord").alias("a"), F.col("b.ord").alias("b")]
    begins = F.floor(F.greatest("a.lo", "b.lo") / STRIP)
    narrow = a.join(b, both & (F.col("a.strip") == F.col("b.strip")) & (F.col("a.ord") < F.col("b.ord"))).filter(F.col("a.strip") == begins).select(*pair)
    wide = a.filter("strip is null").alias("a").join(whole.alias("b"), both & (F.col("a.ord") != F.col("b.ord"))).select(*pair)
    return narrow.unionByName(wide.select("path", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def outside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (path, line) that no interval (path, lo, hi) of their path holds; intervals are sought by strips of lines, wide ones by their path."""
    dealt = intervals.withColumn("strip", F.explode_outer(_strips("lo", "hi"))).alias("i")
    p = points.alias("p")
    inside = (F.col("p.path") == F.col("i.path")) & F.col("p.line").between(F.col("i.lo"), F.col("i.hi"))
    left = p.join(dealt.filter("strip is not null").alias("i"), inside & (F.floor(F.col("p.line") / STRIP) == F.col("i.strip")), "left_anti")
    return left.alias("p").join(dealt.filter("strip is null").alias("i"), inside, "left_anti")


def merge_intervals(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, kind): spans that overlap as one, with the first's kind; spans that only touch stay apart."""
    by = Window.partitionBy(key).orderBy("start", "end", "kind")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("__new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    df = df.withColumn("__island", F.sum("__new").over(by))
    return df.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind")).drop("__island")


def sequence_gaps(ids: DataFrame, group: str, number: str) -> DataFrame:
    """(group, missing): numbers that a group's sequence lacks between its least and its largest, found from neighbours."""
    by = Window.partitionBy(group).orderBy(number)
    steps = ids.select(group, number).distinct().withColumn("__next", F.lead(number).over(by)).filter(F.col("__next") > F.col(number) + 1)
    return steps.select(group, F.explode(F.sequence(F.col(number) + 1, F.col("__next") - 1)).alias("missing"))


def carry(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The new rows with judgement ``fields`` of the old: only where a key has as many rows as before, or all its old rows agree."""
    judged = F.struct(*fields)
    before = old.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_distinct(judged).alias("__kinds"), F.min(judged).alias("__j"))
    after = new.groupBy(*keys).agg(F.count("*").alias("__m"))
    ranked = lambda df: df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    same_place = ranked(old).select(*keys, "__r", judged.alias("__own"))
    out = ranked(new).join(after, keys).join(before, keys, "left").join(same_place, [*keys, "__r"], "left")
    pick = F.when(F.col("__kinds") == 1, F.col("__j")).when(F.col("__n") == F.col("__m"), F.col("__own"))
    return out.select(*new.columns, *(pick[f].alias(f) for f in fields))


def first_match(wanted: DataFrame, entries: DataFrame, ident: str) -> DataFrame:
    """``wanted`` (ident, id, fingerprint, ref) with the entry (ord, id, fingerprint, ref, applied) that answers each.

    An entry answers by id where one is asked for; otherwise by fingerprint where both have one, else by ref. Live entries come before
    closed ones, then the earliest. Each rule is an equi-join; what remains is ranked.
    """
    w, e = wanted.alias("w"), entries.alias("e")
    by_id = w.join(e, F.col("w.id") == F.col("e.id"))
    free = F.col("w.id").isNull()
    by_print = w.filter(free).join(e, F.col("w.fingerprint") == F.col("e.fingerprint"))
    no_prints = free & (F.col("w.fingerprint").isNull() | F.col("e.fingerprint").isNull())
    by_ref = w.join(e, (F.col("w.ref") == F.col("e.ref")) & no_prints)
    cols = [F.col(f"w.{ident}").alias(ident), F.col("e.ord").alias("ord"), F.col("e.applied").alias("applied")]
    found = by_id.select(*cols).unionByName(by_print.select(*cols)).unionByName(by_ref.select(*cols))
    rank = Window.partitionBy(ident).orderBy("applied", "ord")
    best = found.withColumn("__r", F.row_number().over(rank)).filter("__r = 1").select(ident, F.col("ord").alias("entry"))
    return wanted.select(ident).join(best, ident, "left")
