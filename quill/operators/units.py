"""Line units, occurrence indexes, fingerprints, duplicates and edit plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The dispositions of a unit, by their exact spelling, and what each allows.
RULED, DEFECT, UNVERIFIABLE = "ruled → apply", "contradicts code → suspected defect", "not verifiable"
DECISION, OBSOLETE, REGENERABLE = "historical decision → ADR", "obsolete", "regenerable → delete"
CONDENSE, STRIP, STILL = "condense", "stale fragment → strip", "still true"
DUPLICATE, SEVERED, RETAINED = "duplicate → delete", "severed", "retained"
ADMISSIBLE = {
    "comment": (RULED, DEFECT, UNVERIFIABLE, DECISION, OBSOLETE, REGENERABLE, CONDENSE, STRIP, STILL),
    "document": (RULED, DEFECT, UNVERIFIABLE, DECISION, DUPLICATE, OBSOLETE, CONDENSE, STRIP, STILL),
    "severance": (SEVERED, RETAINED),
}
CHANGE_AUTHORIZED = (RULED, DECISION, DUPLICATE, OBSOLETE, REGENERABLE, CONDENSE, STRIP, SEVERED)
EDIT_ALLOWED = (RULED, OBSOLETE, CONDENSE, STRIP, SEVERED, REGENERABLE)
EDIT_REQUIRED = (CONDENSE, STRIP)
FROZEN = (DEFECT, UNVERIFIABLE)
REMOVED_WHOLE = (DECISION, DUPLICATE, REGENERABLE)


def line_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ord, line): the lines of each document that aren't blank, numbered from 1 over all lines."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ord", "line"))
    return lines.withColumn("ord", F.col("ord") + 1).filter(F.trim("line") != "")


def paragraph_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sl, el, body): runs of lines that aren't blank, by islands over a window of each document's lines."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ord", "line")).withColumn("blank", F.trim("line") == "")
    by = Window.partitionBy(key).orderBy("ord")
    lines = lines.withColumn("island", F.sum(F.col("blank").cast("int")).over(by)).filter(~F.col("blank"))
    unit = lines.groupBy(key, "island").agg(F.min("ord").alias("sl"), F.max("ord").alias("el"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return unit.select(key, (F.col("sl") + 1).alias("sl"), (F.col("el") + 1).alias("el"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def with_occurrence(units: DataFrame, path: str, body: str, order: str) -> DataFrame:
    """Adds norm, occ (place among equal normalised bodies of a path) and fingerprint."""
    units = units.withColumn("norm", tx.norm(F.col(body)))
    units = units.withColumn("occ", F.row_number().over(Window.partitionBy(path, "norm").orderBy(order)))
    return units.withColumn("fingerprint", tx.fingerprint(F.col(path).cast("string"), F.col("occ"), F.col(body)))


def duplicates(units: DataFrame, path: str, ident: str) -> DataFrame:
    """(path, norm, ids): bodies that stand more than once in a path, with their ids in order."""
    same = units.groupBy(path, "norm").agg(F.array_sort(F.collect_list(ident)).alias("ids"))
    return same.filter(F.size("ids") > 1)


def plan_op(pass_kind: Column, disposition: Column, edit: Column, in_tbc: Column, tbc: Column) -> Column:
    """What a disposition does to its unit: sever, tbc, keep, remove, replace, or null for nothing. Edits may be ''."""
    d = tx.norm(disposition)
    one_of = lambda names: d.isin(*(n.lower() for n in names))
    has_edit = F.coalesce(edit, F.lit("")) != ""
    severance = pass_kind == "severance"
    return (
        F.when(severance & one_of((SEVERED,)) & edit.isNotNull(), "sever")
        .when(severance, None)
        .when(one_of((UNVERIFIABLE,)) & (pass_kind == "document") & (F.coalesce(in_tbc, F.lit("")) != "yes") & (F.coalesce(tbc, F.lit("")) != ""), "tbc")
        .when(one_of((*FROZEN, STILL, "")), None)
        .when(one_of((REGENERABLE,)) & has_edit, "keep")
        .when(one_of(REMOVED_WHOLE) | (one_of((OBSOLETE, RULED)) & ~has_edit), "remove")
        .when(one_of(EDIT_ALLOWED), "replace")
    )
