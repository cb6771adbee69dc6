"""Records of judged units: parsing, integrity rules, caps, edits and replay."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..staging import numbered
from . import cuts, units

#: Fields of a record and the forms of intake lines.
SCRIPT_FIELDS = ("file", "lines", "span", "fingerprint", "preview", "in_tbc", "facts")
JUDGEMENT_FIELDS = ("disposition", "basis", "edit", "claims", "ruling", "tbc", "of", "conflicts", "escalate", "adr", "adr_title", "adr_text")
MULTILINE = ("edit", "claims", "adr_text")
REQUIRED_HEADER = ("unit_id", "baseline_sha", "pass_kind", "unit_rule", "scope", "floor", "floor_observed")
INTAKE_LINE = r"^- (\S+) `([^`]+)` — (.*?)(?: \[([a-z]+=[^\]]*)\])?$"
BEGIN, END = r"--- consolidation-record v[23] ---", "--- end consolidation-record ---"


def disposition_counts(record: DataFrame) -> DataFrame:
    """(disposition, n)."""
    return record.filter("disposition is not null").groupBy(tx.norm(F.col("disposition")).alias("disposition")).agg(F.count("*").alias("n"))


def is_judgement(disposition: Column) -> Column:
    return tx.norm(disposition).isin(*(d.lower() for d in units.CHANGE_AUTHORIZED))


def bound_problems(record: DataFrame, removed_cap: int = 200, judgement_cap: int = 30) -> DataFrame:
    """(bound, measured, cap) of the caps on removed lines and on judgements that a record (disposition, removed) exceeds."""
    got = record.agg(F.sum("removed").alias("r"), F.count_if(is_judgement(F.col("disposition"))).alias("j"))
    row = lambda name, c, cap: got.select(F.lit(name).alias("bound"), F.col(c).cast("long").alias("measured"), F.lit(cap).alias("cap")).filter("measured > cap")
    return row("removed lines", "r", removed_cap).unionByName(row("judgements", "j", judgement_cap))


def record_problems(record: DataFrame, pass_kind: str) -> DataFrame:
    """(file, id, problem) over (file, id, disposition, basis, edit, ruling, tbc): one row for each rule that a unit breaks."""
    d = tx.norm(F.col("disposition"))
    one_of = lambda names: d.isin(*(n.lower() for n in names))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = [
        (d == "", "no disposition"),
        ((d != "") & ~one_of(units.ADMISSIBLE[pass_kind]), "disposition not admissible"),
        (one_of(units.EDIT_REQUIRED) & blank("edit"), "an edit is required"),
        (~one_of(units.EDIT_ALLOWED) & (d != "") & ~blank("edit"), "no edit is allowed"),
        (one_of(units.CHANGE_AUTHORIZED) & blank("basis"), "a change needs evidence"),
        (one_of((units.RULED,)) & blank("ruling"), "a ruling is named by its id"),
        ((F.lit(pass_kind) != "document") & ~blank("tbc"), "open questions belong to document passes"),
    ]
    broken = F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in rules)))
    rows = record.select("file", "id", F.explode(broken).alias("problem"))
    twice = record.groupBy("file", "id").count().filter("count > 1").select("file", "id", F.lit("id used twice").alias("problem"))
    return rows.unionByName(twice)


def pair_problems(record: DataFrame) -> DataFrame:
    """(file, id, problem): units whose of_id is their own, names no unit of the file, or names one that is removed whole."""
    named = record.select("file", F.col("id").alias("of_id"), tx.norm(F.col("disposition")).alias("__d"), F.lit(True).alias("__there"))
    gone = F.col("__d").isin(*(n.lower() for n in units.REMOVED_WHOLE))
    out = record.filter("of_id is not null").join(named, ["file", "of_id"], "left")
    problem = F.when(F.col("of_id") == F.col("id"), "names itself").when(F.col("__there").isNull(), "no such unit").when(gone, "names a removed unit")
    return out.select("file", "id", problem.alias("problem")).filter("problem is not null")


def adr_names(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(id, name): file names for new decision records (id, title), numbered on from the largest of existing (name)."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("name", r"^(\d{4})-", 1).try_cast("int")), F.lit(0))).first()[0]
    ranked = new.withColumn("k", F.row_number().over(Window.orderBy("id")))  # the new records of one run, few by their nature
    return ranked.select("id", F.concat(F.lpad((F.col("k") + top).cast("string"), 4, "0"), F.lit("-"), tx.slug(F.col("title")), F.lit(".md")).alias("name"))


def drop_page_furniture(lines: DataFrame, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """(doc, page, line) without lines on ``share`` of a document's pages (of ``least_pages`` at least), and without page numbers."""
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    heads = lines.groupBy("doc", "line").agg(F.count_distinct("page").alias("on")).join(pages, "doc")
    heads = heads.filter((F.col("pages") >= least_pages) & (F.col("on") >= share * F.col("pages"))).select("doc", "line")
    return lines.join(heads, ["doc", "line"], "left_anti").filter(~F.col("line").rlike(r"^\s*\d+\s*$")).select("doc", "page", "line")


def greedy_pages(headings: DataFrame) -> DataFrame:
    """(doc, ord, page) over (doc, ord, hits: pages a heading is found on): the first hit not before the previous page; none keeps it null.

    A fold over each document's headings inside the JVM.
    """
    grouped = headings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", F.sort_array("hits").alias("hits")))).alias("h"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<ord:int,page:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        page = F.get(F.filter(x["hits"], lambda p: p >= acc["at"]), F.lit(0))
        return F.struct(F.coalesce(page, acc["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(x["ord"].cast("int").alias("ord"), page.cast("int").alias("page")))).alias("out"))

    folded = F.aggregate("h", start, step, lambda acc: acc["out"])
    return grouped.select("doc", F.explode(folded).alias("r")).select("doc", "r.ord", "r.page")


# --- text forms -------------------------------------------------------------------------------


def intake_fields(line: Column) -> Column:
    """Struct (date, ref, body, fields) of an intake line, null for any other line."""
    part = lambda k: F.regexp_extract(line, INTAKE_LINE, k)
    fields = F.when(part(4) != "", F.str_to_map(part(4), F.lit(" "), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    return F.when(line.rlike(INTAKE_LINE), F.struct(part(1).alias("date"), part(2).alias("ref"), part(3).alias("body"), fields.alias("fields")))


def record_text(message: Column) -> Column:
    """The record between its marks in a commit message, null without one."""
    pattern = rf"(?s){BEGIN}\n(.*?){END}"
    return F.when(message.rlike(pattern), F.regexp_extract(message, pattern, 1))


def scope_entries(scope: Column) -> Column:
    """Array of (path, lo, hi) of a scope text 'a.py, docs/x.md:10-80'; lo and hi are null for whole files."""
    parts = F.filter(F.transform(F.split(F.coalesce(scope, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    ranged = r"^(.*):(\d+)-(\d+)$"
    num = lambda x, k: F.regexp_extract(x, ranged, k).try_cast("int")
    return F.transform(parts, lambda x: F.struct(F.when(x.rlike(ranged), F.regexp_extract(x, ranged, 1)).otherwise(x).alias("path"), num(x, 2).alias("lo"), num(x, 3).alias("hi")))


RECORD = "struct<header:map<string,string>,units:array<map<string,string>>,problems:array<string>>"


def _record_of(text: str) -> dict:
    """Header lines, then units that open with ``unit: n``; fields of several lines go on with indented lines."""
    header: dict[str, str] = {}
    found: list[dict[str, str]] = []
    problems: list[str] = []
    last = None
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        at = found[-1] if found else header
        if line[0] in " \t":
            if last in MULTILINE:
                at[last] += ("\n" if at[last] else "") + re.sub("^ {1,4}", "", line)
            else:
                problems.append(f"line {n}: continues nothing")
            continue
        m = re.match(r"^([a-z_]+):\s?(.*)$", line)
        if not m:
            problems.append(f"line {n}: not a field")
            last = None
            continue
        last, value = m[1], m[2].rstrip()
        if last == "unit":
            found.append({"unit": value})
        elif found and last not in SCRIPT_FIELDS + JUDGEMENT_FIELDS:
            problems.append(f"line {n}: unknown field {last}")
        elif last in at:
            problems.append(f"line {n}: {last} stands twice")
        else:
            at[last] = value
    problems += [f"no {k}" for k in REQUIRED_HEADER if k not in header]
    return {"header": header, "units": found, "problems": problems}


def parse_record(text: Column | str) -> Column:
    """Struct (header, units, problems) of a record text; null text has every header field missing."""

    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_record_of(t or "") for t in col], columns=["header", "units", "problems"])

    return F.pandas_udf(run, RECORD)(text)


def diff_lines(old: Column | str, new: Column | str) -> Column:
    """Array of (sign, old_line, new_line, content): lines removed and added between two texts; a changed final line end alone is no change."""
    from difflib import SequenceMatcher

    kind = "array<struct<sign:string,old_line:int,new_line:int,content:string>>"

    def one(a: str | None, b: str | None) -> list[dict]:
        x, y = (a or "").splitlines(), (b or "").splitlines()
        out = []
        for tag, i, j, k, m in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag != "equal":
                out += [{"sign": "-", "old_line": n + 1, "new_line": k, "content": x[n]} for n in range(i, j)]
                out += [{"sign": "+", "old_line": j, "new_line": n + 1, "content": y[n]} for n in range(k, m)]
        return out

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)])

    return F.pandas_udf(run, kind)(old, new)


# --- applying and planning ---------------------------------------------------------------------


def apply_edits(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, text): files (path, text) with planned operations (path, sl, el, op, edit) done from the bottom up; lines from 1, inclusive.

    remove cuts the lines, and a blank line left beside another; replace and keep put the edit's lines in their place; tbc adds the edit as an
    item under 'To be confirmed' once. Files without operations stay as they are. A cogroup of each file with its own operations.
    """

    def one(f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in f.itertuples():
            text = row.text or ""
            end = "\r\n" if "\r\n" in text else "\n"
            lines = re.split(r"\r?\n", text)
            asked = []
            for op in p.sort_values("sl", ascending=False).itertuples():
                edit = op.edit if isinstance(op.edit, str) else ""
                if op.op == "tbc":
                    asked.insert(0, f"- {edit}")
                    continue
                lines[op.sl - 1 : op.el] = edit.split("\n") if edit and op.op != "remove" else []
                at = op.sl - 1
                if op.op == "remove" and 0 < at < len(lines) and not lines[at - 1].strip() and not lines[at].strip():
                    del lines[at]
            asked = [a for a in dict.fromkeys(asked) if a not in lines]
            if asked:
                lines = [*"\n".join(lines).rstrip("\n").split("\n"), *([] if "## To be confirmed" in lines else ["", "## To be confirmed", ""]), *asked, ""]
            out.append((row.path, end.join(lines)))
        return pd.DataFrame(out, columns=["path", "text"])

    return files.groupBy("path").cogroup(plan.groupBy("path")).applyInPandas(one, "path string, text string")


def pack_files(sizes: DataFrame, group: str, unit_cap: int, line_cap: int) -> DataFrame:
    """(group, path, part): files in path order dealt into parts under caps on units and lines; a file over a cap is a part of its own.

    Paths must be unique in a group, which may be of any size; files without a group are left out.
    """
    rows = numbered(sizes.select(group, "path", "units", "lines").filter(F.col(group).isNotNull()), [F.col(group), F.col("path")], "files")
    first = rows.groupBy(group).agg(F.min("place").alias("first"))
    dense = rows.join(first, group).withColumn("place", F.col("place") - F.col("first")).drop("first")
    return cuts.greedy_parts(dense, group, "place", {"units": unit_cap, "lines": line_cap}).select(group, "path", "part")


def balance(sizes: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Files (path, units) with the shard each goes to: the heaviest first, to the shard that is lightest so far. A driver-side plan of one run."""
    load = [0] * max(1, shards)
    rows = []
    for r in sizes.sort_values(["units", "path"], ascending=[False, True]).itertuples():
        k = load.index(min(load))
        load[k] += r.units
        rows.append((r.path, r.units, k))
    return pd.DataFrame(rows, columns=["path", "units", "shard"])


def sample_size(n: int, rate: float = 0.25) -> int:
    return math.ceil(n * rate)


#: The order of an intake entry's fields.
INTAKE_FIELDS = ("kind", "state", "observed", "fingerprint", "context", "repo", "ruling", "id", "occurrences", "latest", "tbc", "applied")


def render_intake(date: Column, ref: Column, body: Column, fields: Column) -> Column:
    """An intake line: known fields in their order, then others by name; fields without a value stand alone, known ones are left out."""
    known = F.array(*(F.when(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}="), F.try_element_at(fields, F.lit(k)))) for k in INTAKE_FIELDS))
    other = F.filter(F.array_sort(F.map_keys(fields)), lambda k: ~k.isin(*INTAKE_FIELDS))
    rest = F.transform(other, lambda k: F.when(F.try_element_at(fields, k) == "", k).otherwise(F.concat(k, F.lit("="), F.try_element_at(fields, k))))
    tail = F.array_join(F.concat(F.array_compact(known), rest), " ")
    return F.concat(F.lit("- "), date, F.lit(" `"), ref, F.lit("` — "), body, F.when(tail != "", F.concat(F.lit(" ["), tail, F.lit("]"))).otherwise(""))


def upsert_intake(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(ord, ident, line): entries with changed lines in their places and new ones after the last; of several changes of one entry the last counts."""
    last = changes.groupBy("ident").agg(F.max_by("line", "seq").alias("new"), F.min("seq").alias("seq"))
    top = current.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    kept = current.join(last, "ident", "left").select("ord", "ident", F.coalesce("new", "line").alias("line"))
    added = last.join(current.select("ident"), "ident", "left_anti")
    return kept.unionByName(added.select((F.lit(top) + F.row_number().over(Window.orderBy("seq"))).cast(dict(current.dtypes)["ord"]).alias("ord"), "ident", F.col("new").alias("line")))


def render_record(header: DataFrame, record: DataFrame) -> DataFrame:
    """(record, text) of (record, ord, key, value) header rows and (record, id, ord, key, value) unit rows; values of several lines go on indented."""
    text = F.concat("key", F.lit(": "), F.replace("value", F.lit("\n"), F.lit("\n  ")))
    h = header.select("record", F.lit(0).alias("id"), "ord", text.alias("line"))
    u = record.select("record", "id", "ord", text.alias("line"))
    marks = record.select("record", "id").distinct().select("record", "id", F.lit(-1).alias("ord"), F.concat(F.lit("unit: "), F.col("id").cast("string")).alias("line"))
    rows = h.unionByName(u).unionByName(marks).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("id", "ord", "line"))).alias("l"))
    return rows.select("record", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def identity_problems(record: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, problem): units of a record (id, file, lines, span, fingerprint) against a fresh enumeration, and spans that stand twice."""
    from .integrity import compare

    twice = record.groupBy("file", "span").agg(F.count("*").alias("n"), F.max("id").alias("id")).filter("n > 1")
    return compare(record, fresh, ["id"], ["file", "lines", "span", "fingerprint"]).unionByName(twice.select("id", F.lit("span used twice").alias("problem")))


def cut_ranges(sizes: DataFrame, unit_cap: int, line_cap: int) -> DataFrame:
    """(path, lo, hi): a file's units (path, sl, el, removed) cut from the bottom into ranges under caps on units and removed lines.

    Units have different first lines; :func:`quill.operators.cuts.cut_files` does the same where pairs of units must stay together.
    """
    rows = cuts.places(sizes.select("path", "sl", "el", "removed", (-F.col("sl")).alias("up"), F.lit(1).alias("one")), "path", "up")
    parts = cuts.greedy_parts(rows, "path", "place", {"one": unit_cap, "removed": line_cap})
    return parts.groupBy("path", "part").agg(F.min("sl").alias("lo"), F.max("el").alias("hi")).select("path", "lo", "hi")


def set_verified(text: Column, sha: Column) -> Column:
    """A document with ``last-verified-at`` in its front matter set to a sha, added where it lacks it; text without front matter gets one."""
    line = F.concat(F.lit("last-verified-at: "), sha)
    has_matter, has_line = text.rlike(r"^\x{FEFF}?---\n"), text.rlike(r"(?s)^\x{FEFF}?---\n(?:(?!---).*?\n)??last-verified-at:")
    changed = F.regexp_replace(text, r"(?m)^last-verified-at:.*$", "\u0001")
    put = F.replace(F.regexp_replace(changed, "(?s)\u0001(.*)\u0001", "\u0001$1"), F.lit("\u0001"), line)
    added = F.concat(F.regexp_extract(text, r"^(\x{FEFF}?---\n)", 1), line, F.lit("\n"), F.regexp_replace(text, r"^\x{FEFF}?---\n", ""))
    return F.when(has_line, put).when(has_matter, added).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n\n"), text))
