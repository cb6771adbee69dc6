"""Queries over documents, labels and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fuzzy, secrets, transcripts, units
from ..registry import query
from ..sources import table

NORM_SQL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
LINES_SQL = "SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ord, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
UNITS_SQL = f"SELECT doc_id, ord, line, {NORM_SQL.format('line')} AS norm FROM ({LINES_SQL}) WHERE trim(line) <> ''"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.line_units(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "corpus_rollup",
    """SELECT source, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE text LIKE '%TODO%') AS n_marked,
  count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'es') AS es
FROM documents GROUP BY source""",
)
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, characters and languages of each source."""
    count = lambda lang: F.count_if(F.col("lang") == lang).alias(lang)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("text").contains("TODO")).alias("n_marked"), *map(count, ("en", "de", "fr", "es")))


@query(
    "line_units",
    f"""WITH u AS ({UNITS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY ord) AS occ FROM u)
SELECT doc_id, ord, occ, sha1({NORM_SQL.format("doc_id || chr(10) || occ || chr(10) || line")})[1:8] AS fingerprint, rtrim(trim(line)[1:70]) AS preview FROM o""",
)
def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units: place among equal lines of the document, content key and preview."""
    df = units.with_occurrence(lines(spark, sf_dir), "doc_id", "line", "ord")
    return df.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("occ").cast("long").alias("occ"), "fingerprint", F.rtrim(F.substring(F.trim("line"), 1, 70)).alias("preview"))


@query("duplicate_units", f"WITH u AS ({UNITS_SQL}) SELECT doc_id, norm, list(ord ORDER BY ord) AS ids FROM u GROUP BY doc_id, norm HAVING count(*) > 1")
def duplicate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand more than once in a document."""
    df = lines(spark, sf_dir).withColumn("norm", tx.norm(F.col("line"))).withColumn("ord", F.col("ord").cast("long"))
    return units.duplicates(df, "doc_id", "ord")


@query(
    "body_groups",
    f"""WITH u AS ({UNITS_SQL}) SELECT norm, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM u GROUP BY norm HAVING count(DISTINCT doc_id) > 2""",
)
def body_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in more than two documents."""
    df = lines(spark, sf_dir).select("doc_id", tx.norm(F.col("line")).alias("norm"))
    return df.groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter("n_docs > 2")


_FACTS_SQL = rf"""
WITH u AS ({LINES_SQL}), f AS (
  SELECT doc_id, ord, line, list_distinct(list_filter(list_transform(
    regexp_extract_all(line, '\b[A-Z][A-Z0-9]+-\d+\b') || regexp_extract_all(line, '#\d{{3,}}\b') || regexp_extract_all(line, '\b\d{{4}}-\d{{2}}-\d{{2}}\b')
    || regexp_extract_all(line, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b'), lambda x: trim(regexp_replace(x, '[\s,;]+', ' ', 'g'))), lambda x: x <> '')) AS fr FROM u WHERE trim(line) <> '')
SELECT doc_id, ord, list_sort(fr) AS fragments, NOT regexp_matches(line, '[\p{{L}}\p{{N}}_]') AS separator, regexp_matches(line, '(?i)\b(TODO|FIXME|XXX|HACK)\b') AS todo
FROM f WHERE len(fr) > 0 OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}_]') OR regexp_matches(line, '(?i)\b(TODO|FIXME|XXX|HACK)\b')"""


@query("unit_facts", _FACTS_SQL)
def unit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with dates, ticket ids or issue numbers, without any word, or with a marker of open work."""
    line = F.col("line")
    df = lines(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), F.sort_array(tx.fragments(line)).alias("fragments"), (~line.rlike(r"(?U)\w")).alias("separator"), line.rlike(r"(?i)\b(TODO|FIXME|XXX|HACK)\b").alias("todo"))
    return df.filter((F.size("fragments") > 0) | F.col("separator") | F.col("todo"))


LICENCE = r"(?i)\b(copyright|licen[cs]ed?|spdx-license-identifier|all rights reserved|creative commons|cc by|apache license|mit license|gnu (?:lesser )?general public)\b"


@query("licence_lines", f"SELECT doc_id, ord, line FROM ({LINES_SQL}) WHERE regexp_matches(line, '{LICENCE}')")
def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that speak of a licence or of copyright."""
    return lines(spark, sf_dir).filter(F.col("line").rlike(LICENCE)).select("doc_id", F.col("ord").cast("long").alias("ord"), "line")


@query(
    "repeated_lines_filter",
    f"""WITH l AS (SELECT d.source, u.doc_id, trim(u.line) AS line FROM ({LINES_SQL}) u JOIN documents d USING (doc_id) WHERE trim(u.line) <> ''),
n AS (SELECT source, count(*) AS docs FROM documents GROUP BY source)
SELECT source, line, count(DISTINCT doc_id) AS n_docs, count(DISTINCT doc_id) * 1.0 / any_value(docs) AS share FROM l JOIN n USING (source) GROUP BY source, line HAVING count(DISTINCT doc_id) >= 0.03 * any_value(docs) AND count(DISTINCT doc_id) > 1""",
)
def repeated_lines_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in at least 3 % of a source's documents (and in two): running heads and boilerplate."""
    docs = table(spark, sf_dir, "documents")
    return transcripts.repeated_lines(docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")), docs.groupBy("source").agg(F.count("*").alias("docs")), "source", "doc_id", 0.03, 2)


@query(
    "table_width_issues",
    rf"""WITH l AS (SELECT doc_id, ord, trim(line) AS s FROM ({LINES_SQL})),
r AS (SELECT *, s LIKE '%|%' AS is_row, lag(s LIKE '%|%', 1, false) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM l),
t AS (SELECT *, sum(CASE WHEN is_row AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS tab, len(regexp_extract_all(trim(s, '|'), '\|')) + 1 AS cells FROM r),
h AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id, tab ORDER BY ord) AS header_cells FROM t WHERE is_row)
SELECT doc_id, ord, cells, header_cells FROM h WHERE cells <> header_cells""",
)
def table_width_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with bars whose number of cells isn't that of the first row of their run."""
    bar = F.col("s").contains("|")
    by = Window.partitionBy("doc_id").orderBy("ord")
    all_lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    df = all_lines.select("doc_id", (F.col("ord") + 1).cast("long").alias("ord"), F.trim("line").alias("s")).withColumn("is_row", bar)
    df = df.withColumn("tab", F.sum((F.col("is_row") & ~F.coalesce(F.lag("is_row").over(by), F.lit(False))).cast("int")).over(by)).filter("is_row")
    df = df.withColumn("cells", (F.regexp_count(F.regexp_replace("s", r"^\|+|\|+$", ""), F.lit(r"\|")) + 1).cast("long"))
    df = df.withColumn("header_cells", F.first("cells").over(Window.partitionBy("doc_id", "tab").orderBy("ord")))
    return df.filter("cells <> header_cells").select("doc_id", "ord", "cells", "header_cells")


@query(
    "marker_issues",
    rf"""SELECT 'W' AS severity, doc_id, ord, 'marker ' || regexp_extract(line, '\b(TODO|TBD|FIXME|XXX)\b|«REDACTED»') AS message FROM ({LINES_SQL}) WHERE regexp_matches(line, '\b(TODO|TBD|FIXME|XXX)\b|«REDACTED»')
UNION ALL SELECT 'I', doc_id, ord, 'empty cell' FROM ({LINES_SQL}) WHERE line LIKE '%| |%'""",
)
def marker_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue rows: markers of open work, and empty table cells."""
    df = lines(spark, sf_dir).withColumn("ord", F.col("ord").cast("long"))
    found = F.regexp_extract("line", tx.MARKERS, 0)
    one = df.filter(F.col("line").rlike(tx.MARKERS)).select(F.lit("W").alias("severity"), "doc_id", "ord", F.concat(F.lit("marker "), found).alias("message"))
    two = df.filter(F.col("line").contains("| |")).select(F.lit("I").alias("severity"), "doc_id", "ord", F.lit("empty cell").alias("message"))
    return one.unionByName(two)


@query(
    "word_budget_tier",
    r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words FROM documents)
SELECT doc_id, words, CASE WHEN words BETWEEN 800 AND 1500 THEN 'high' WHEN words BETWEEN 400 AND 799 THEN 'medium' WHEN words BETWEEN 150 AND 399 THEN 'low' WHEN words < 150 THEN 'under' ELSE 'over' END AS tier, CAST(ceil(words / 400.0) AS BIGINT) AS pages FROM w""",
)
def word_budget_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, the budget they fit, and pages of about 400 words."""
    w = F.col("words")
    df = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"))
    tier = F.when(w.between(800, 1500), "high").when(w.between(400, 799), "medium").when(w.between(150, 399), "low").when(w < 150, "under").otherwise("over")
    return df.select("doc_id", "words", tier.alias("tier"), F.ceil(w / 400).alias("pages"))


@query("rtl_flag", r"SELECT doc_id, len(regexp_extract_all(text, '[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]')) > len(regexp_extract_all(text, '\p{L}')) / 2.0 AS rtl FROM documents")
def rtl_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_rtl(F.col("text")).alias("rtl"))


_TERMS_SQL = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS term FROM documents)
SELECT term, count(*) AS n, min(doc_id) AS first_doc FROM t GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, first_doc, term LIMIT 400"""


@query("term_frequency_topk", _TERMS_SQL)
def term_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 most frequent words of six letters or more that occur twice; ties to the earliest document."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), 0)).alias("term"))
    t = t.groupBy("term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n >= 2")
    return t.orderBy(F.desc("n"), "first_doc", "term").limit(400)


@query(
    "deterministic_sample",
    """WITH r AS (SELECT doc_id, sha1('baseline:' || source || ':' || doc_id) AS h, source, row_number() OVER (PARTITION BY source ORDER BY sha1('baseline:' || source || ':' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE rn <= ceil(n * 0.25)""",
)
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each source's documents, the lowest by a keyed hash: the same sample every time."""
    from ..operators.sampling import keyed_sample

    return keyed_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "baseline", 0.25)


@query(
    "label_integrity",
    """SELECT doc_id, 'label without document' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'document without label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'labelled twice' FROM labels GROUP BY doc_id HAVING count(*) > 1""",
)
def label_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and documents that lack each other, and repeated labels: three anti joins as issue rows."""
    from ..operators.integrity import reference_problems

    return reference_problems(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", ("label without document", "document without label", "labelled twice"))


@query(
    "label_compare",
    """WITH a AS (SELECT doc_id, quality AS grade FROM labels UNION ALL SELECT -1, 1), b AS (SELECT doc_id, 1 - toxic AS grade FROM labels UNION ALL SELECT -2, 0)
SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'differs: grade' END AS problem
FROM a FULL JOIN b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.grade IS DISTINCT FROM b.grade""",
)
def label_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two gradings of the labelled documents: missing rows, extra rows and changed fields."""
    from ..operators.integrity import compare

    labels = table(spark, sf_dir, "labels")
    a = labels.selectExpr("doc_id", "quality AS grade").unionByName(spark.sql("SELECT -1L AS doc_id, 1 AS grade"))
    b = labels.selectExpr("doc_id", "1 - toxic AS grade").unionByName(spark.sql("SELECT -2L AS doc_id, 0 AS grade"))
    return compare(a, b, ["doc_id"], ["grade"]).select(F.col("doc_id").alias("id"), "problem")


@query("lang_codes", "SELECT CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'en' ELSE regexp_extract(lower(trim(lang)), '^[^-_]*') END AS code, count(*) AS n FROM documents GROUP BY 1")
def lang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(tx.lang_code(F.col("lang")).alias("code")).agg(F.count("*").alias("n"))


@query("letter_norms", "SELECT item_id, regexp_replace(lower(text), '[^0-9a-zà-ÿ]', '', 'g') AS norm FROM benchmark")
def letter_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.letters_norm(F.col("text")).alias("norm"))


@query(
    "ngram_windows",
    r"""WITH t AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM benchmark),
w AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS pos, ws FROM t), k AS (SELECT item_id, pos, ws, unnest([1,2,3,4,5]) AS k FROM w)
SELECT item_id, pos - 1 AS pos, k, array_to_string(ws[pos:pos + k - 1], ' ') AS words FROM k WHERE pos + k - 1 <= len(ws)""",
)
def ngram_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of one to five words with their positions."""
    df = fuzzy.windows(table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), 0).alias("tokens")), "tokens", 5)
    return df.select("item_id", F.col("pos").cast("long").alias("pos"), "k", "words")


@query(
    "trigram_candidates",
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS n FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS n FROM documents),
bg AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, length(n) + 2), lambda i: ('  ' || n || ' ')[i:i + 2]))) AS g FROM b),
dg AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(n) + 2), lambda i: ('  ' || n || ' ')[i:i + 2]))) AS g FROM d),
need AS (SELECT item_id, greatest(2, CAST(floor(count(*) * 0.3) AS BIGINT)) AS need FROM bg GROUP BY item_id),
c AS (SELECT item_id, doc_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY ALL)
SELECT item_id, doc_id, shared, need FROM c JOIN need USING (item_id) WHERE shared >= need""",
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share enough trigrams with a benchmark passage. A document is one key, so every gram counts, however many documents hold it."""
    start = lambda c: tx.norm(F.col(c))
    terms = table(spark, sf_dir, "benchmark").select("item_id", start("text").alias("n"))
    keys = table(spark, sf_dir, "documents").select("doc_id", start("text").alias("n"))
    return fuzzy.candidates(terms, "item_id", keys, "doc_id")


@query("sound_keys", r"SELECT doc_id, regexp_replace(translate(regexp_replace(lower(text), '[^0-9a-zà-ÿ]', '', 'g'), 'pvfcqgtzxwy', 'bbbkkkdssui'), '[aeiouàèéìòùh]', '', 'g') AS consonants FROM documents")
def sound_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonant classes of each document: the sound key before doubles are collapsed."""
    n = tx.letters_norm(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.translate(n, *tx.PHONETIC), "[aeiouàèéìòùh]", "").alias("consonants"))


@query("prose_chunks")
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as anchored chunks of at most 700 characters, whole sentences where they fit."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(transcripts.prose_chunks("text")).alias("n", "text"))
    return df.select("doc_id", F.concat(F.lit("¶"), (F.col("n") + 1).cast("string")).alias("anchor"), "text")


@query("secret_hits")
def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, with an extra pattern for hexadecimal tokens."""
    hits = secrets.find_secrets("text", (r'token = "[0-9a-f]{40}"',))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.kind", "h.start", "h.end", "h.line")


@query(
    "token_patterns",
    r"""SELECT doc_id, len(regexp_extract_all(text, '\b(AKIA|ASIA)[A-Z0-9]{16}\b')) AS aws, len(regexp_extract_all(text, '\b(ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b')) AS github,
  len(regexp_extract_all(text, '\bxox[abprs]-[A-Za-z0-9\-]{10,}\b')) AS slack, len(regexp_extract_all(text, '\bsk-(ant-|proj-)?[A-Za-z0-9_\-]{20,}\b')) AS sk FROM documents""",
)
def token_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tokens with recognisable prefixes."""
    count = lambda kind, name: F.regexp_count("text", F.lit(secrets.DETECTORS[kind])).cast("long").alias(name)
    return table(spark, sf_dir, "documents").select("doc_id", count("aws-access-key", "aws"), count("github-token", "github"), count("slack-token", "slack"), count("generic-sk-key", "sk"))
