"""Names in texts: code identifiers, chat terms and their absence from code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shapes of names.
BACKTICK = r"`([A-Za-z_][\w.]*)(?:\(\))?`"
DOTTED_CALL = r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)(?=\s*\()"
CAMEL = r"\b((?:[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+))\b"
SNAKE = r"\b(_*[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b"


def code_identifiers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, name): code-shaped names of three characters or more in a text, each at its first place.

    Names in backticks, dotted calls (their last part), camelCase and snake_case. Places come from the text before each match, so the order
    is that of reading, whatever the form.
    """
    forms = (BACKTICK, DOTTED_CALL, CAMEL, SNAKE)
    found = F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x, k=k: F.struct(x.alias("m"), F.lit(k).alias("form"))) for k, p in enumerate(forms)))
    rows = df.select(key, F.col(text).alias("__t"), F.explode(found).alias("f")).select(key, "__t", "f.m", "f.form")
    bare = F.regexp_replace(F.regexp_replace("m", r"`|\(\)", ""), r"^.*\.", "")
    name = F.when(F.col("form") < 2, bare).otherwise(F.col("m"))
    rows = rows.select(key, F.expr("instr(__t, m)").alias("pos"), name.alias("name")).filter(F.length("name") >= 3)
    return rows.groupBy(key, "name").agg(F.min("pos").alias("pos")).select(key, "pos", "name")


def absent_identifiers(mentions: DataFrame, key: str, code: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions (key, pos, name) of names that no code token has outside comments.

    ``code``: (path, offset, name), ``spans``: (path, lo, hi) of comments, half open. Tokens inside a comment don't count: a range join by path,
    then an anti join by name.
    """
    c, s = code.alias("c"), spans.alias("s")
    inside = (F.col("c.path") == F.col("s.path")) & (F.col("c.offset") >= F.col("s.lo")) & (F.col("c.offset") < F.col("s.hi"))
    live = c.join(s, inside, "left_anti").select("name").distinct()
    return mentions.join(live, "name", "left_anti").select(key, "pos", "name")


def chat_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, term): names in chat lines without their time and speaker: pieces of up to six words with a capital, digit or mark, and quotes."""
    line = F.trim(F.regexp_replace("line", r"^\s*(?:\[[^\]]*\]\s*)?(?:[^:]{1,60}:\s+)?", ""))
    lines = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ord", "line")).select(key, "ord", line.alias("line")).filter("line <> ''")
    pieces = F.transform(F.split("line", r"\s+[–—-]\s+|[,;()]"), lambda p: F.regexp_replace(p, r"^[ .;,:]+|[ .;,:]+$", ""))
    kept = F.filter(pieces, lambda p: (p != "") & (F.size(F.split(p, r"\s+")) <= 6) & p.rlike(r"[A-Z0-9_\\/.@#]"))
    quoted = F.regexp_extract_all("line", F.lit("[\"“«']([^\"”»']{3,60})[\"”»']"), 1)
    camel = F.regexp_extract_all("line", F.lit(CAMEL), 1)
    return lines.select(key, "ord", F.explode(F.array_distinct(F.concat(kept, camel, quoted))).alias("term"))


def frequent_terms(terms: DataFrame, least: int = 2, length: int = 6, most: int = 400) -> DataFrame:
    """(term, n, first): the ``most`` frequent terms (ord, term) that occur ``least`` times and are long enough; ties to the earliest."""
    counted = terms.groupBy("term").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.filter((F.col("n") >= least) & (F.length("term") >= length)).orderBy(F.desc("n"), "first", "term").limit(most)


def distinct_terms(*sources: DataFrame) -> DataFrame:
    """(ord, term) of all sources (ord, term) in turn, distinct without case: the first spelling stays."""
    every = None
    for k, s in enumerate(sources):
        part = s.select(F.lit(k).alias("src"), "ord", "term")
        every = part if every is None else every.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("src", "ord"))
    return every.withColumn("r", rank).filter("r = 1").select("src", "ord", "term")


def reference_occurrences(docs: DataFrame, key: str, text: str, targets: Column | list[str]) -> DataFrame:
    """(key, line, target): lines that name a target path as whole path segments."""
    lines = docs.select(key, F.posexplode(F.split(text, "\r?\n")).alias("ord", "content"))
    rows = None
    for t in targets:
        quoted = "\\Q" + t + "\\E"
        part = lines.filter(F.col("content").rlike(rf"(?<![\w./\-]){quoted}(?![\w\-]|\.\w|/\w)")).select(key, (F.col("ord") + 1).alias("line"), F.lit(t).alias("target"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
