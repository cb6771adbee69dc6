"""Queries that look for dictionary phrases and carry states along texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import choice, cuts, fuzzy, phrases, states, units
from ..registry import query
from ..sources import table
from ..staging import written
from .documents import NORM_SQL

SHORTEST, LONGEST = 3, 8


@query(
    "phrase_matches",
    rf"""
WITH RECURSIVE b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark
), g AS (
  SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT item_id, ws, unnest(range({SHORTEST}, {LONGEST + 1})) AS n FROM b) WHERE len(ws) >= n
), p AS (
  SELECT array_to_string(ws[i:i + n - 1], ' ') AS words, n, min(item_id) AS item_id FROM g GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents
), t AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d
), s AS (
  SELECT doc_id, i, ws[i:i + {LONGEST - 1}] AS ahead FROM t WHERE array_to_string(ws[i:i + {SHORTEST - 1}], ' ') IN (SELECT words FROM p)
), c AS (
  SELECT doc_id, i, n, array_to_string(ahead[1:n], ' ') AS words FROM (SELECT doc_id, i, ahead, unnest(range({SHORTEST}, {LONGEST + 1})) AS n FROM s) WHERE len(ahead) >= n
), m AS MATERIALIZED (
  SELECT c.doc_id, c.i AS pos, max(c.n) AS n, arg_max(p.item_id, c.n) AS item_id FROM c JOIN p USING (words) GROUP BY c.doc_id, c.i
), o AS MATERIALIZED (
  SELECT m.doc_id, m.pos, m.n, m.item_id, k.pos AS following FROM m ASOF LEFT JOIN m k ON k.doc_id = m.doc_id AND m.pos + m.n <= k.pos
), r AS (
  SELECT o.* FROM o JOIN (SELECT doc_id, min(pos) AS pos FROM m GROUP BY doc_id) USING (doc_id, pos) UNION ALL SELECT o.* FROM r JOIN o ON o.doc_id = r.doc_id AND o.pos = r.following
)
SELECT doc_id, pos - 1 AS pos, CAST(n AS INTEGER) AS n_words, item_id FROM r""",
)
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs of benchmark passages, of three to eight words, in all documents: from left to right, the longest at each place; of equal runs the item with the smallest id."""
    items = table(spark, sf_dir, "benchmark").select("item_id", phrases.words(F.col("text")).alias("w"))
    sizes = items.withColumn("n", F.explode(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)))).filter(F.size("w") >= F.col("n"))
    runs = sizes.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice(F.col("w"), i, F.col("n")))).alias("run"))
    out = phrases.phrase_matches(table(spark, sf_dir, "documents"), "doc_id", "text", runs, "item_id", "run")
    return out.select("doc_id", "pos", "n_words", F.col("phrase").alias("item_id"))


_LINES = "SELECT doc_id, unnest(range(1, len(ls) + 1)) AS ord, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"


@query(
    "line_states",
    rf"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, ord, line, regexp_extract(line, '^[ \t\r\f]*(`{{3,}}|~{{3,}})', 1) AS mark, contains(line, '-->') AS closes, regexp_matches(line, '^[ \t\r\f]*<!--') AND NOT contains(line, '-->') AS opens,
         regexp_matches(line, '^#{{1,6}}[ \t]') AS is_heading, contains(line, '|') AS is_row
  FROM ({_LINES})
), s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS ord, '' AS before, '' AS after FROM (SELECT DISTINCT doc_id FROM l)
  UNION ALL
  SELECT l.doc_id, l.ord, s.after, CASE WHEN s.after = 'c' THEN CASE WHEN closes THEN '' ELSE 'c' END WHEN s.after <> '' THEN CASE WHEN starts_with(mark, s.after) THEN '' ELSE s.after END
    WHEN opens THEN 'c' ELSE mark END FROM s JOIN l ON l.doc_id = s.doc_id AND l.ord = s.ord + 1
), z AS (
  SELECT l.*, before = '' AND after = '' AS outside, before = 'c' OR after = 'c' AS comment FROM s JOIN l USING (doc_id, ord)
), c AS (
  SELECT *, max(CASE WHEN outside AND is_heading THEN ord END) OVER w AS heading, ord - coalesce(max(CASE WHEN NOT (outside AND is_row) THEN ord END) OVER w, 0) AS table_row
  FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
)
SELECT doc_id, ord, CASE WHEN outside THEN 'text' WHEN comment THEN 'comment' ELSE 'fence' END AS zone, heading, CASE WHEN table_row > 0 THEN table_row END AS table_row FROM c""",
)
def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line of every document: text, fence or comment; the heading it stands under; its place in a run of rows with bars."""
    return states.line_states(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "page_piece_states",
    r"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, unnest(range(len(ps))) AS pos, unnest(ps) AS piece FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+|<') AS ps FROM pages)
), l AS MATERIALIZED (
  SELECT page_id, pos, piece, regexp_matches(piece, '(?i)^<h[1-3]\b') AS is_heading, ends_with(piece, '-->') AS c1, regexp_matches(piece, '(?i)^</script\b') AS c2, regexp_matches(piece, '(?i)^</style\b') AS c3,
    CASE WHEN regexp_matches(piece, '(?i)^<style\b') THEN 'style' WHEN regexp_matches(piece, '(?i)^<script\b') THEN 'script' WHEN starts_with(piece, '<!--') AND NOT ends_with(piece, '-->') THEN 'comment' ELSE 'text' END AS opens
  FROM p
), s AS (
  SELECT page_id, CAST(-1 AS BIGINT) AS pos, 'text' AS before, 'text' AS after FROM (SELECT DISTINCT page_id FROM l)
  UNION ALL
  SELECT l.page_id, l.pos, s.after, CASE s.after WHEN 'text' THEN opens WHEN 'comment' THEN CASE WHEN c1 THEN 'text' ELSE 'comment' END WHEN 'script' THEN CASE WHEN c2 THEN 'text' ELSE 'script' END
    ELSE CASE WHEN c3 THEN 'text' ELSE 'style' END END FROM s JOIN l ON l.page_id = s.page_id AND l.pos = s.pos + 1
)
SELECT page_id, pos, CASE WHEN before <> 'text' THEN before ELSE after END AS zone,
  max(CASE WHEN before = 'text' AND after = 'text' AND is_heading THEN pos END) OVER (PARTITION BY page_id ORDER BY pos) AS heading,
  CASE WHEN before = 'text' AND after = 'text' AND NOT starts_with(piece, '<') THEN length(regexp_replace(piece, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')) ELSE 0 END AS n_chars
FROM s JOIN l USING (page_id, pos)""",
)
def page_piece_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every tag and text of every page: whether it stands in a comment, script or style, and the heading it stands under."""
    return states.piece_states(table(spark, sf_dir, "pages"), "page_id", "html")


UNIT_CAP, ROW_CAP = 8, 24
LONG_TEXT = 1 << 22
_UNITS = rf"SELECT doc_id, ord, {NORM_SQL.format('line')} AS norm, CAST(ceil(length(line) / 80.0) AS BIGINT) AS n_rows FROM ({_LINES}) WHERE trim(line) <> ''"


@query(
    "cut_ranges",
    f"""
WITH RECURSIVE u AS MATERIALIZED (
  SELECT *, min(ord) OVER (PARTITION BY doc_id, norm) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM ({_UNITS})
), f AS (
  SELECT u.*, lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) + 1 AS cut FROM u
), b AS MATERIALIZED (
  SELECT *, sum(CASE WHEN EXISTS (SELECT 1 FROM u p WHERE p.doc_id = f.doc_id AND p.first < f.cut AND f.cut <= p.ord AND p.first <> p.ord) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS block FROM f
), k AS MATERIALIZED (
  SELECT doc_id, block, max(ord) AS hi, count(*) AS n_units, sum(n_rows) AS n_rows, row_number() OVER (PARTITION BY doc_id ORDER BY block DESC) AS place FROM b GROUP BY doc_id, block
), g AS (
  SELECT doc_id, place, hi, n_units AS n, n_rows AS m, 0 AS part FROM k WHERE place = 1
  UNION ALL
  SELECT k.doc_id, k.place, k.hi, CASE WHEN g.n + k.n_units > {UNIT_CAP} OR g.m + k.n_rows > {ROW_CAP} THEN k.n_units ELSE g.n + k.n_units END,
    CASE WHEN g.n + k.n_units > {UNIT_CAP} OR g.m + k.n_rows > {ROW_CAP} THEN k.n_rows ELSE g.m + k.n_rows END, g.part + CASE WHEN g.n + k.n_units > {UNIT_CAP} OR g.m + k.n_rows > {ROW_CAP} THEN 1 ELSE 0 END
  FROM g JOIN k ON k.doc_id = g.doc_id AND k.place = g.place + 1
), r AS (
  SELECT g.doc_id, part, max(g.hi) AS hi, CAST(sum(k.n_units) AS BIGINT) AS n_units, CAST(sum(k.n_rows) AS BIGINT) AS n_rows FROM g JOIN k USING (doc_id, place) GROUP BY g.doc_id, part
)
SELECT doc_id, part, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY part DESC) + 1, 1) AS lo, hi, n_units, n_rows FROM r""",
)
def cut_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines cut from the bottom into ranges of at most 8 units and 24 printed rows, where no cut parts a repeated line from the first of its kind.

    Documents are cut in their rows; lines of those longer than ``LONG_TEXT`` bytes become rows of their own, of which one document may have more than a task holds.
    """
    docs, caps, long = table(spark, sf_dir, "documents").select("doc_id", "text"), {"n": UNIT_CAP, "n_rows": ROW_CAP}, F.octet_length("text") > LONG_TEXT
    unit = lambda line, k: F.struct((k + 1).alias("sl"), tx.norm(line).alias("kind"), F.lit(1).alias("n"), F.ceil(F.length(line) / 80).alias("n_rows"), (F.trim(line) != "").alias("said"))
    lines = F.filter(F.transform(F.split("text", "\r?\n"), unit), lambda u: u["said"])
    out = cuts.cut_rows(docs.filter(~long).select("doc_id", lines.alias("units")), "doc_id", "units", caps)
    if not docs.filter(long).isEmpty():
        rows = units.line_units(docs.filter(long)).withColumn("ord", F.col("ord").cast("long"))
        rows = written(rows.select("doc_id", "ord", tx.norm(F.col("line")).alias("norm"), F.ceil(F.length("line") / 80).alias("n_rows")), "units")
        first = rows.groupBy("doc_id", "norm").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").select("doc_id", "lo", "hi")
        out = out.unionByName(cuts.cut_files(rows.select("doc_id", F.col("ord").alias("sl"), F.col("ord").alias("el"), F.lit(1).cast("long").alias("n"), "n_rows"), first, "doc_id", caps))
    return out.drop("n")


@query(
    "packed_parts",
    """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT source, doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, length(coalesce(text, '')) AS n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents
), g AS (
  SELECT source, doc_id, place, n_lines AS n, n_chars AS m, 0 AS part FROM d WHERE place = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.place, CASE WHEN over THEN d.n_lines ELSE g.n + d.n_lines END, CASE WHEN over THEN d.n_chars ELSE g.m + d.n_chars END, g.part + CAST(over AS INTEGER)
  FROM g JOIN d ON d.source = g.source AND d.place = g.place + 1, LATERAL (SELECT g.n + d.n_lines > 60 OR g.m + d.n_chars > 20000 AS over)
)
SELECT source, doc_id, part FROM g""",
)
def packed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in the order of their ids, dealt into parts of at most 60 lines and 20,000 characters; one over a cap is a part of its own."""
    text = F.coalesce("text", F.lit(""))
    size = (F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_chars"))
    docs = cuts.places(written(table(spark, sf_dir, "documents").select("source", "doc_id", *size), "sizes"), "source", "doc_id")
    return cuts.greedy_parts(docs, "source", "place", {"n_lines": 60, "n_chars": 20_000}).select("source", "doc_id", "part")


@query(
    "repeated_runs",
    r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM conversations
), w AS (
  SELECT conv_id, turn, n, i, array_to_string(ws[i:i + n - 1], ' ') AS words FROM (SELECT conv_id, turn, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4, 5]) AS n FROM t))
), c AS MATERIALIZED (
  SELECT conv_id, turn, words, n, list(i - 1 ORDER BY i) AS places, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, n DESC, words) AS k
  FROM w GROUP BY conv_id, turn, words, n HAVING count(*) > 1
), g AS (
  SELECT conv_id, turn, k, words, places, n, true AS taken, flatten(list_transform(places, lambda p: range(p, p + n))) AS used FROM c WHERE k = 1
  UNION ALL
  SELECT c.conv_id, c.turn, c.k, c.words, c.places, c.n, ok, CASE WHEN ok THEN list_concat(g.used, flatten(list_transform(c.places, lambda p: range(p, p + c.n)))) ELSE g.used END
  FROM g JOIN c ON c.conv_id = g.conv_id AND c.turn = g.turn AND c.k = g.k + 1, LATERAL (SELECT NOT list_has_any(g.used, range(c.places[1], c.places[1] + c.n)) AS ok)
)
SELECT conv_id, turn, words, len(places) AS count, places[1] AS first_pos FROM g WHERE taken""",
)
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two to five words that a turn says more than once, the most frequent first, then the longest, none where a better one stands."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", phrases.words(F.coalesce("text", F.lit(""))).alias("tokens"))
    spots = fuzzy.repeated_windows(said, ["conv_id", "turn"], "tokens")
    order = [-F.size("places"), -F.col("width"), F.col("words")]
    kept = choice.best_first(spots.withColumn("said_in", F.struct("conv_id", "turn")), "said_in", order, "places", "width")
    return kept.select("conv_id", "turn", "words", F.size("places").cast("long").alias("count"), F.element_at("places", 1).cast("long").alias("first_pos"))
