"""A corpus on disk: index and manifest, pages with what a crawl could not reach, and small helpers for paths, lines and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ENTRY_POINTS, MOST_PROBLEMS = 80, 200
COVERAGE = "blocked_domains array<string>, robots_excluded array<string>"

# Words that ask for an output format, in the order of preference, and the format without any.
FORMAT_WORDS = {
    "xlsx": ("spreadsheet", "tracking", "filtering", "analysis"),
    "pdf": ("pdf", "print", "official copy"),
    "md": ("github", "gitlab", "repository", "version control"),
    "docx": ("report", "document", "presentation"),
}
USUAL_FORMAT = "docx"

# Dispositions in the order in which they are asked for, each with the fact that calls for it.
DISPOSITIONS = (
    ("ruled", "ruled → apply"),
    ("contradicts", "contradicts code → suspected defect"),
    ("external", "not verifiable"),
    ("decision", "historical decision → ADR"),
    ("gone", "obsolete"),
    ("rebuildable", "regenerable → delete"),
    ("condensable", "condense"),
    ("stale", "stale fragment → strip"),
)
STILL_TRUE = "still true"


# --- index and manifest ------------------------------------------------------------------------


def index_rows(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, kinds, chars, problems, line): a source's row of the index, from sources (id, label, origin, redactions, warnings) and files
    (id, path, kind, chars, status, warnings).

    ``kinds`` counts files by kind in the order of kinds; ``problems`` counts the source's own warnings and its files that have one or weren't read.
    Sources without files stand in the index too.
    """
    bad = (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0) | F.col("status").isin("unreadable", "skipped")
    by_kind = files.groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_if(bad).alias("bad"))
    kind = F.struct("kind", F.concat("kind", F.lit(" "), F.col("n").cast("string")).alias("text"))
    per = by_kind.groupBy("id").agg(F.array_sort(F.collect_list(kind)).alias("k"), F.sum("chars").alias("chars"), F.sum("bad").alias("bad"))
    rows = sources.join(per, "id", "left").withColumns({"chars": F.coalesce("chars", F.lit(0)), "problems": F.size("warnings") + F.coalesce("bad", F.lit(0))})
    kinds = F.coalesce(F.array_join(F.transform("k", lambda x: x["text"]), ", "), F.lit("-"))
    cells = (F.col("id"), F.col("label"), F.concat(F.lit("`"), "origin", F.lit("`")), kinds, F.format_number("chars", 0), F.col("redactions").cast("string"), F.col("problems").cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select("id", kinds.alias("kinds"), "chars", "problems", line.alias("line"))


def index_notes(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, part, ord, line): entry points (part 1; sources have them in ``entry_points``) and problems (part 2) below the index, at most 80 and 200 a
    source; a source's own warnings come before its files'."""
    points = sources.select("id", F.lit(1).alias("part"), F.posexplode(F.slice("entry_points", 1, MOST_ENTRY_POINTS)).alias("ord", "x")).withColumn("line", F.concat(F.lit("- `"), "x", F.lit("`")))
    own = sources.select("id", F.lit(2).alias("part"), F.posexplode("warnings").alias("ord", "x")).withColumn("line", F.concat(F.lit("- "), "x"))
    bad = files.filter((F.size("warnings") > 0) | F.col("status").isin("unreadable", "skipped"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    named = F.concat(F.lit("- `"), "path", F.lit("` ("), "status", F.lit("): "), F.array_join("warnings", "; "))
    listed = bad.withColumn("ord", place).filter(F.col("ord") <= MOST_PROBLEMS).select("id", F.lit(2).alias("part"), (F.col("ord") + 1_000_000).alias("ord"), named.alias("line"))
    return points.drop("x").unionByName(own.drop("x")).unionByName(listed)


def write_manifest(sources: DataFrame, files: DataFrame, path: str) -> None:
    """Sources with their files inside, a JSON object a line."""
    inside = files.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", *(c for c in files.columns if c not in ("id", "path"))))).alias("files"))
    sources.join(inside, "id", "left").write.mode("error").json(path)


# --- pages and what a crawl could not reach -----------------------------------------------------


def write_pages(pages: DataFrame, path: str, blocked: list[str], excluded: list[str]) -> None:
    """Pages as JSON lines, and beside them the domains that blocked the crawl and the addresses that robots.txt withheld."""
    pages.write.mode("error").json(f"{path}/pages")
    coverage = pages.sparkSession.createDataFrame([(sorted(set(blocked)), list(excluded))], COVERAGE)
    coverage.coalesce(1).write.mode("error").json(f"{path}/coverage")


def read_pages(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, list[str], list[str]]:
    """(pages, blocked domains, excluded addresses); both lists are empty where they weren't written or aren't lists."""
    pages = spark.read.schema(schema).json(f"{path}/pages")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/coverage")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return pages, [], []
    row = spark.read.schema(COVERAGE).json(f"{path}/coverage").first()
    if row is None or row.blocked_domains is None or row.robots_excluded is None:
        return pages, [], []
    return pages, sorted(row.blocked_domains), row.robots_excluded


# --- paths, lines, spans --------------------------------------------------------------------------


def posix_path(path: Column) -> Column:
    """Slashes of one kind, and no ``./`` in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def is_output(path: Column, folders: list[str]) -> Column:
    """Whether a path is one of the folders that a run writes, or below one."""
    out = F.lit(False)
    for f in folders:
        out = out | (path == f.rstrip("/")) | path.startswith(f.rstrip("/") + "/")
    return out


def lines_with_ends(text: Column) -> Column:
    """A text's lines as (content, eol); a last line without an end has eol '', and the text's own end opens no line. Put together they are the text."""
    parts = F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+$)"), F.lit(1))
    end = lambda p: F.regexp_extract(p, r"(\r?\n)$", 1)
    return F.transform(parts, lambda p: F.struct(F.substring(p, F.lit(1), F.length(p) - F.length(end(p))).alias("content"), end(p).alias("eol")))


def joined_lines(lines: Column) -> Column:
    """The text of :func:`lines_with_ends`."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x["content"], x["eol"])), "")


def line_offsets(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, ord, line) with ``offset``, where each begins in its text, ends of one character counted."""
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def in_spans(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Points (key, offset) with ``inside``: whether a span (key, lo, hi), hi open, holds them.

    Points and ends of spans are put in one order and open spans are counted, so no pair of a point and a span is made.
    """
    events = spans.select(key, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.at", "e.d", F.lit(None).alias("p"))
    asked = points.select(key, F.col("offset").alias("at"), F.lit(0).alias("d"), F.struct(*points.columns).alias("p"))
    both = events.withColumn("p", F.lit(None).cast(asked.schema["p"].dataType)).unionByName(asked)
    open_ = F.sum("d").over(Window.partitionBy(key).orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("inside", open_ > 0).filter("p is not null").select("p.*", "inside")


def provider_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata (ord, key, value), rows (ord, path, fields)) of a command's output (ord, line): ``# key: value`` lines, and rows between tabs
    whose first field is a path."""
    line = F.col("line")
    meta = lines.filter(line.startswith("#")).select("ord", F.trim(F.regexp_extract(line, r"^#\s*([^:]*)", 1)).alias("key"), F.trim(F.regexp_extract(line, r"^#[^:]*:(.*)$", 1)).alias("value"))
    fields = F.split(line, "\t")
    rows = lines.filter(~line.startswith("#") & (F.trim(line) != "")).select("ord", posix_path(fields[0]).alias("path"), F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))).alias("fields"))
    return meta, rows


def repository_identity(commits: DataFrame) -> DataFrame:
    """(repo, identity) of commits (repo, ord, sha, parents): the first 8 characters of the earliest commit without a parent."""
    roots = commits.filter(F.size(F.coalesce("parents", F.array().cast("array<string>"))) == 0)
    return roots.groupBy("repo").agg(F.substring(F.min_by("sha", "ord"), 1, 8).alias("identity"))


def remapped_references(references: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, id, target) of references (file, id, target) with old ids replaced by new ones: ids meet by file and fingerprint in before and
    after (file, id, fp). References of or to units that are gone are left out."""
    new = before.join(after.withColumnRenamed("id", "new"), ["file", "fp"]).select("file", "id", "new")
    out = references.join(new, ["file", "id"]).select("file", F.col("new").alias("id"), "target")
    return out.join(new.select("file", F.col("id").alias("target"), "new"), ["file", "target"]).select("file", "id", F.col("new").alias("target"))


# --- decision lists -----------------------------------------------------------------------------------


def suggested_disposition(facts: Column) -> Column:
    """The disposition that the first of a unit's facts (a struct of booleans, null as false) calls for; a suggestion, as judgement is the reviewer's."""
    out = F.lit(STILL_TRUE)
    for fact, name in reversed(DISPOSITIONS):
        out = F.when(F.coalesce(facts[fact], F.lit(False)), name).otherwise(out)
    return out


def recommended_formats(request: Column) -> Column:
    """Formats that a request's words ask for, in the order of preference; the usual one without any; several stand for a mixed audience."""
    asked = F.array_compact(F.array(*(F.when(F.lower(request).rlike("|".join(rf"\b{w}" for w in words)), f) for f, words in FORMAT_WORDS.items())))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit(USUAL_FORMAT)))
