"""Queries over whole tables for the corpus's index, lines, formats and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import languages
from ..operators import corpus, transcripts
from ..registry import query
from ..sources import table


@query(
    "corpus_index",
    """WITH k AS (SELECT coalesce(source, '') AS id, coalesce(lang, '') AS kind, count(*) AS n, sum(length(coalesce(text, ''))) AS chars, count(*) FILTER (WHERE coalesce(text, '') = '') AS bad FROM documents GROUP BY 1, 2),
p AS (SELECT id, string_agg(kind || ' ' || CAST(n AS VARCHAR), ', ' ORDER BY kind) AS kinds, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(bad) AS BIGINT) AS problems FROM k GROUP BY id)
SELECT id, kinds, chars, problems, '| ' || id || ' | ' || id || ' | `' || id || '` | ' || kinds || ' | ' || format('{:,}', chars) || ' | 0 | ' || CAST(problems AS VARCHAR) || ' |' AS line FROM p""",
)
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a corpus index: a source's documents by language, their characters and how many are empty."""
    docs = table(spark, sf_dir, "documents").withColumns({"id": F.coalesce("source", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    none = F.array().cast("array<string>")
    files = docs.select("id", F.col("doc_id").cast("string").alias("path"), F.coalesce("lang", F.lit("")).alias("kind"), F.length("text").cast("long").alias("chars"), F.when(F.col("text") == "", "unreadable").otherwise("ok").alias("status"), none.alias("warnings"))
    sources = docs.select("id").distinct().select("id", F.col("id").alias("label"), F.col("id").alias("origin"), F.lit(0).alias("redactions"), none.alias("warnings"))
    return corpus.index_rows(sources, files)


@query(
    "line_endings",
    r"""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n_lines,
  CAST((length(text) - length(replace(text, chr(13) || chr(10), ''))) / 2 AS BIGINT) AS n_crlf, CAST(length(replace(replace(text, chr(13) || chr(10), ''), chr(10), '')) AS BIGINT) AS chars, true AS whole
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
)
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines with their own endings, and whether they are the text again when put together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.withColumn("lines", corpus.lines_with_ends(F.col("text")))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"]))
    crlf = F.size(F.filter("lines", lambda x: x["eol"] == "\r\n")).cast("long")
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), crlf.alias("n_crlf"), chars.alias("chars"), (corpus.joined_lines(F.col("lines")) == F.col("text")).alias("whole"))


@query(
    "recommended_formats",
    r"""SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(t, '\bspreadsheet|\btracking|\bfiltering|\banalysis') THEN 'xlsx' END, CASE WHEN regexp_matches(t, '\bpdf|\bprint|\bofficial copy') THEN 'pdf' END,
  CASE WHEN regexp_matches(t, '\bgithub|\bgitlab|\brepository|\bversion control') THEN 'md' END,
  CASE WHEN regexp_matches(t, '\breport|\bdocument|\bpresentation') OR NOT regexp_matches(t, '\b(spreadsheet|tracking|filtering|analysis|pdf|print|official copy|github|gitlab|repository|version control)') THEN 'docx' END], lambda x: x IS NOT NULL) AS formats
FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)""",
)
def recommended_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output formats that a turn's words ask for."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", corpus.recommended_formats(F.coalesce("text", F.lit(""))).alias("formats"))


FACTS = [f for f, _ in corpus.DISPOSITIONS]


@query(
    "suggested_dispositions",
    r"""SELECT doc_id, CASE WHEN toxic = 1 THEN 'ruled → apply' WHEN regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'historical decision → ADR' WHEN quality = 0 THEN 'obsolete'
  WHEN length(t) < 200 THEN 'regenerable → delete' WHEN length(t) > 5000 THEN 'condense' ELSE 'still true' END AS disposition
FROM (SELECT d.doc_id, coalesce(d.text, '') AS t, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def suggested_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fact of a document that calls for a disposition, with facts made from its label, dates and length."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("t", F.coalesce("text", F.lit("")))
    known = {"ruled": F.col("toxic") == 1, "decision": F.col("t").rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), "gone": F.col("quality") == 0, "rebuildable": F.length("t") < 200, "condensable": F.length("t") > 5000}
    facts = F.struct(*(known.get(f, F.lit(False)).alias(f) for f in FACTS))
    return docs.select("doc_id", corpus.suggested_disposition(facts).alias("disposition"))


@query(
    "page_languages",
    r"""SELECT page_id, CASE WHEN name = '' THEN NULL WHEN regexp_matches(name, '.\.(html|htm|vue|svelte|xhtml)$') THEN 'html' WHEN regexp_matches(name, '.\.(json|txt|csv|lock|map)$') THEN 'none'
  WHEN regexp_matches(name, '.\.(xml|xsd|xsl|xslt|svg|csproj|vbproj|config|plist|xaml|resx|nuspec|props|targets|pubxml)$') THEN 'xml' WHEN regexp_matches(name, '.\.(php|phtml)$') THEN 'php'
  WHEN regexp_matches(name, '.\.(aspx|ascx|master)$') THEN 'aspnet' WHEN regexp_matches(name, '.\.css$') THEN 'css' WHEN regexp_matches(name, '.\.(js|mjs|cjs|ts|mts|cts)$') THEN 'js' END AS lang
FROM (SELECT page_id, lower(regexp_extract(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '[^/]*$')) AS name FROM pages)""",
)
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages by the names in their addresses."""
    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", languages.language(path).alias("lang"))


@query(
    "posix_paths",
    r"SELECT page_id, regexp_replace(replace('./' || replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '/', chr(92)), chr(92), '/'), '^(\./)+', '') AS path FROM pages",
)
def posix_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written as paths of another system, and back."""
    odd = F.concat(F.lit("./"), F.replace(F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", ""), F.lit("/"), F.lit("\\")))
    return table(spark, sf_dir, "pages").select("page_id", corpus.posix_path(odd).alias("path"))


@query(
    "offsets_of_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ord FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(max(o) AS BIGINT) AS last_offset, CAST(sum(o % 997) AS BIGINT) AS check_sum FROM (SELECT doc_id, ord, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l) GROUP BY doc_id""",
)
def offsets_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines begin in their documents, as digests."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ord", "line"))
    at = corpus.line_offsets(lines, "doc_id")
    return at.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("offset").cast("long").alias("last_offset"), F.sum(F.col("offset") % 997).cast("long").alias("check_sum"))


@query("sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of at most 700 characters made of whole sentences, cut inside the JVM; held against the batch form in tests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(transcripts.split_text("text")).alias("n", "text"))
