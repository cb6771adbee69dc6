"""Rules about records, scopes, versions and headings over rows derived from the data folder's tables; what still stands on VALUES has no input there. The same SQL gives the rows in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, text, times, urls
from ..operators import integrity, markdown, quality, records, robots, sampling, units
from ..registry import query
from ..streaming import events as stream
from .documents import LINES_SQL
from .given import given


def values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns})"


SCOPE = "SELECT source AS path, doc_id AS ord, doc_id * 10 AS lo, doc_id * 10 + n_chars % 400 AS hi FROM @documents"


@query("interval_overlaps", f"WITH s AS (SELECT path, ord, coalesce(lo, 1) AS lo, coalesce(hi, 2147483647) AS hi FROM ({SCOPE})) SELECT a.path, a.ord AS a, b.ord AS b FROM s a JOIN s b ON a.path = b.path AND a.lo <= b.hi AND b.lo <= a.hi AND a.ord < b.ord")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.overlaps(given(spark, sf_dir, SCOPE))


REMOVED = "SELECT source AS path, doc_id * 10 + 395 AS line FROM @documents"


@query("unauthorized_removals", f"SELECT r.path, r.line FROM ({REMOVED}) r WHERE NOT EXISTS (SELECT 1 FROM ({SCOPE}) s WHERE s.path = r.path AND r.line BETWEEN s.lo AND s.hi)")
def unauthorized_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed lines that no authorized range of their file holds."""
    return integrity.outside(given(spark, sf_dir, REMOVED), given(spark, sf_dir, SCOPE))


SPANS = "SELECT user_id AS doc, event_id AS s, event_id + CAST(floor(value * 4) AS BIGINT) AS e, event_type AS kind FROM @events"


@query(
    "merged_spans",
    f"""WITH o AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM ({SPANS})),
i AS (SELECT *, sum(n) OVER (PARTITION BY doc ORDER BY s, e, kind) AS k FROM o)
SELECT doc, min(s) AS first, max(e) AS last, arg_min(kind, s) AS kind FROM i GROUP BY doc, k""",
)
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap as one; touching spans stay apart."""
    spans = given(spark, sf_dir, SPANS).withColumnsRenamed({"s": "start", "e": "end"})
    return integrity.merge_intervals(spans, "doc").withColumnsRenamed({"start": "first", "end": "last"})


IDS = "SELECT concat('L', CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS STRING)) AS prefix, CAST(doc_id AS INT) AS num FROM @labels"


@query("id_gaps", f"WITH i AS ({IDS}), r AS (SELECT prefix, unnest(range(min(num), max(num) + 1)) AS missing FROM i GROUP BY prefix) SELECT prefix, CAST(missing AS INT) AS missing FROM r WHERE (prefix, missing) NOT IN (SELECT prefix, num FROM i)")
def id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.sequence_gaps(given(spark, sf_dir, IDS), "prefix", "num")


OLD = "SELECT d.doc_id AS id, d.lang AS file, substr(md5(d.text), 1, 8) AS fp, CASE l.quality WHEN 1 THEN 'still true' ELSE 'obsolete' END AS disposition FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id"
NEW = "SELECT doc_id AS id, lang AS file, substr(md5(text), 1, 8) AS fp FROM @documents"


@query(
    "carried_judgements",
    f"""WITH o AS ({OLD}), n AS ({NEW}), b AS (SELECT file, fp, count(*) AS n, count(DISTINCT disposition) AS kinds, min(disposition) AS d FROM o GROUP BY 1, 2),
a AS (SELECT file, fp, count(*) AS m FROM n GROUP BY 1, 2), ro AS (SELECT *, row_number() OVER (PARTITION BY file, fp ORDER BY id) AS r FROM o), rn AS (SELECT *, row_number() OVER (PARTITION BY file, fp ORDER BY id) AS r FROM n)
SELECT rn.id, rn.file, rn.fp, CASE WHEN kinds = 1 THEN d WHEN b.n = m THEN ro.disposition END AS disposition
FROM rn JOIN a USING (file, fp) LEFT JOIN b USING (file, fp) LEFT JOIN ro USING (file, fp, r)""",
)
def carried_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements carried to a new enumeration where bodies kept their number or all agree."""
    return integrity.carry(given(spark, sf_dir, OLD), given(spark, sf_dir, NEW), ["file", "fp"], ["disposition"])


PACE = "SELECT CAST(event_id AS STRING) AS host, (event_id % 7) / 2.0 AS floor, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS delay, event_id % 4 AS requests, event_id % 11 AS secs FROM @events"


@query("robots_effective_pace", f"SELECT host, greatest(CAST(floor AS DOUBLE), least(greatest(coalesce(CAST(delay AS DOUBLE), 0), CASE WHEN requests > 0 THEN CAST(secs AS DOUBLE) / requests ELSE 0 END), 30)) AS pace FROM ({PACE})")
def robots_effective_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return given(spark, sf_dir, PACE).select("host", times.effective_delay(d("floor"), d("delay"), F.col("requests"), d("secs")).alias("pace"))


CLOCKS = """SELECT CASE event_id % 7 WHEN 0 THEN CAST(event_id * 37 AS STRING) WHEN 1 THEN concat(CAST(event_id % 24 AS STRING), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'))
  WHEN 2 THEN concat(CAST(event_id % 100 AS STRING), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':', lpad(CAST(user_id % 60 AS STRING), 2, '0'), '.9') WHEN 3 THEN concat(CAST(event_id % 500 AS STRING), '.5s')
  WHEN 4 THEN concat('PT', CAST(event_id % 30 AS STRING), 'H', CAST(user_id % 90 AS STRING), 'M') WHEN 5 THEN concat('-', CAST(user_id AS STRING)) ELSE event_type END AS v FROM @events"""


@query(
    "session_times",
    rf"""WITH c AS ({CLOCKS}), s AS (SELECT v, CASE
  WHEN regexp_matches(v, '^-?\d+(\.\d+)?$') THEN greatest(CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT), 0)
  WHEN regexp_matches(v, '^\d+(\.\d+)?s$') THEN CAST(trunc(CAST(rtrim(v, 's') AS DOUBLE)) AS BIGINT)
  WHEN regexp_matches(v, '(?i)^PT') THEN CAST(trunc(coalesce(TRY_CAST(regexp_extract(v, '(?i)(\d+)H', 1) AS DOUBLE), 0) * 3600 + coalesce(TRY_CAST(regexp_extract(v, '(?i)(\d+)M', 1) AS DOUBLE), 0) * 60 + coalesce(TRY_CAST(regexp_extract(v, '(?i)([\d.]+)S', 1) AS DOUBLE), 0)) AS BIGINT) END AS n FROM c)
SELECT v, CASE WHEN n IS NOT NULL THEN CASE WHEN n < 36000 THEN '0' ELSE '' END || n // 3600 || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0')
  WHEN regexp_matches(v, '^(\d{{1,2}}:)?\d{{1,2}}:\d{{2}}([.,]\d{{1,3}})?$') THEN
    CASE WHEN regexp_matches(v, '^\d+:\d+:') THEN lpad(split_part(v, ':', 1), 2, '0') || ':' || lpad(split_part(v, ':', 2), 2, '0') || ':' || regexp_extract(split_part(v, ':', 3), '^\d+') ELSE '00:' || lpad(split_part(v, ':', 1), 2, '0') || ':' || regexp_extract(split_part(v, ':', 2), '^\d+') END
  ELSE '' END AS clock FROM s""",
)
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, CLOCKS).select("v", times.time_value(F.col("v")).alias("clock"))


RETRY = "SELECT CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id % 150 - 10 AS STRING) END AS v FROM @events"


@query("retry_waits", f"SELECT v, CASE WHEN TRY_CAST(v AS BIGINT) IS NOT NULL THEN CAST(greatest(1, least(CAST(v AS BIGINT), 60)) AS INT) WHEN v LIKE '%00:00:30%' THEN 30 WHEN v LIKE '%01:00:00%' THEN 60 ELSE 5 END AS wait FROM ({RETRY})")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, RETRY).select("v", times.retry_after(F.col("v"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("wait"))


PLAN = """SELECT doc_id AS id, CASE WHEN n_chars % 13 IN (6, 7) THEN 'severance' WHEN doc_id % 5 < 2 THEN 'document' ELSE 'comment' END AS pass_kind,
  CASE n_chars % 13 WHEN 0 THEN 'Still true' WHEN 1 THEN 'obsolete' WHEN 2 THEN 'OBSOLETE' WHEN 3 THEN 'regenerable → delete' WHEN 4 THEN 'not verifiable' WHEN 5 THEN 'condense' WHEN 6 THEN 'severed' WHEN 7 THEN 'retained'
    WHEN 8 THEN 'duplicate → delete' WHEN 9 THEN 'ruled → apply' WHEN 10 THEN 'historical decision → ADR' WHEN 11 THEN 'stale fragment → strip' END AS disposition,
  CASE WHEN doc_id % 3 = 0 THEN lang END AS edit, CASE WHEN doc_id % 7 = 0 THEN 'yes' END AS in_tbc, CASE WHEN doc_id % 4 < 3 THEN source END AS tbc FROM @documents"""


@query(
    "planned_operations",
    f"""SELECT id, CASE WHEN pass_kind = 'severance' THEN CASE WHEN lower(disposition) = 'severed' AND edit IS NOT NULL THEN 'sever' END
  WHEN lower(disposition) = 'not verifiable' THEN CASE WHEN pass_kind = 'document' AND coalesce(in_tbc, '') <> 'yes' AND tbc IS NOT NULL THEN 'tbc' END
  WHEN lower(disposition) = 'regenerable → delete' AND edit IS NOT NULL THEN 'keep'
  WHEN lower(disposition) IN ('regenerable → delete', 'duplicate → delete', 'historical decision → adr') OR (lower(disposition) IN ('obsolete', 'ruled → apply') AND edit IS NULL) THEN 'remove'
  WHEN lower(disposition) IN ('obsolete', 'ruled → apply', 'condense', 'stale fragment → strip') THEN 'replace' END AS op FROM ({PLAN})""",
)
def planned_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, PLAN).select("id", units.plan_op(F.col("pass_kind"), F.col("disposition"), F.col("edit"), F.col("in_tbc"), F.col("tbc")).alias("op"))


@query("disposition_counts", f"SELECT lower(disposition) AS disposition, count(*) AS n FROM ({PLAN}) WHERE disposition IS NOT NULL GROUP BY 1")
def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.disposition_counts(given(spark, sf_dir, PLAN))


@query(
    "bound_problems",
    f"""WITH u AS (SELECT *, 15 * id AS removed FROM ({PLAN}))
SELECT 'removed lines' AS bound, CAST(sum(removed) AS BIGINT) AS measured, 200 AS cap FROM u HAVING sum(removed) > 200
UNION ALL SELECT 'judgements', count(*), 5 FROM u WHERE lower(disposition) IN ('ruled → apply', 'obsolete', 'historical decision → adr', 'duplicate → delete', 'regenerable → delete', 'condense', 'stale fragment → strip', 'severed') HAVING count(*) > 5""",
)
def bound_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps that a record exceeds, with what was measured."""
    return records.bound_problems(given(spark, sf_dir, PLAN).withColumn("removed", 15 * F.col("id")), removed_cap=200, judgement_cap=5)


#: Lines of documents as Markdown: what a line becomes follows from its length.
MARKS = """CASE length(line) % 11 WHEN 0 THEN concat('## ', trim(replace(substr(line, 1, 12), '#', ''))) WHEN 1 THEN '::: note' WHEN 2 THEN ':::' WHEN 3 THEN concat('### S', lpad(CAST(length(line) % 40 AS STRING), 2, '0'), ' · Part')
  WHEN 4 THEN concat('see S', lpad(CAST(length(line) % 40 AS STRING), 2, '0')) WHEN 5 THEN '' WHEN 6 THEN '![Fig](x.png)' WHEN 7 THEN 'Table: one' WHEN 8 THEN '# Head' ELSE line END"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of MD."""
    rows = given(spark, sf_dir, "SELECT doc_id AS doc, text FROM @documents").select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("doc", (F.col("at") + 1).cast("long").alias("ord"), F.expr(MARKS).alias("line"))


MD = f"SELECT doc_id AS doc, ord, {MARKS} AS line FROM ({LINES_SQL})"


@query(
    "current_headings",
    rf"""SELECT doc, ord, last_value(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN regexp_replace(line, '^#+ +', '') END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS heading FROM ({MD})""",
)
def current_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that governs each line."""
    return quality.with_heading(marked_lines(spark, sf_dir), "doc").select("doc", "ord", "heading")


@query(
    "container_problems",
    rf"""WITH d AS (SELECT doc, ord, CASE WHEN regexp_matches(line, '^:::\s*\w+') THEN 1 WHEN trim(line) = ':::' THEN -1 ELSE 0 END AS step FROM ({MD})),
s AS (SELECT *, sum(step) OVER (PARTITION BY doc ORDER BY ord) AS raw FROM d), m AS (SELECT *, least(0, min(raw) OVER (PARTITION BY doc ORDER BY ord)) AS low, least(0, coalesce(min(raw) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM s)
SELECT doc, ord, 'closes nothing' AS problem FROM m WHERE low < before
UNION ALL SELECT doc, 0, CAST(CAST(arg_max(raw - low, ord) AS BIGINT) AS VARCHAR) || ' not closed' FROM m GROUP BY doc HAVING arg_max(raw - low, ord) > 0""",
)
def container_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container marks that close nothing, and containers left open: running sums that restart at zero."""
    return quality.container_problems(marked_lines(spark, sf_dir), "doc")


@query(
    "empty_sections",
    rf"""WITH h AS (SELECT doc, ord, length(regexp_extract(line, '^#+')) AS lvl, regexp_replace(line, '^#+ +', '') AS title FROM ({MD}) WHERE regexp_matches(line, '^#{{1,6}} ')),
n AS (SELECT *, lead(lvl) OVER (PARTITION BY doc ORDER BY ord) AS nl, lead(ord) OVER (PARTITION BY doc ORDER BY ord) AS nx FROM h)
SELECT n.doc, n.ord, n.title FROM n WHERE nl <= lvl AND NOT EXISTS (SELECT 1 FROM ({MD}) l WHERE l.doc = n.doc AND l.ord > n.ord AND l.ord < n.nx AND trim(l.line) <> '')""",
)
def empty_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings followed by one of the same or a higher level with nothing between."""
    return quality.empty_sections(marked_lines(spark, sf_dir), "doc")


@query(
    "id_problems",
    rf"""WITH d AS (SELECT doc, ord, regexp_extract(line, '^#+ (S\d+)', 1) AS id FROM ({MD}) WHERE regexp_matches(line, '^#+ S\d+ ·')),
r AS (SELECT doc, ord, unnest(regexp_extract_all(line, '\bS\d\d\b')) AS id FROM ({MD}) WHERE NOT regexp_matches(line, '^#+ S\d+ ·'))
SELECT 'E' AS severity, doc, min(ord) AS ord, id || ' is cited but never defined' AS message FROM r WHERE (doc, id) NOT IN (SELECT doc, id FROM d) GROUP BY doc, id
UNION ALL SELECT 'W', doc, min(ord), id || ' is defined but never cited' FROM d WHERE (doc, id) NOT IN (SELECT doc, id FROM r) GROUP BY doc, id
UNION ALL SELECT 'E', doc, max(ord), id || ' is defined more than once' FROM d GROUP BY doc, id HAVING count(*) > 1""",
)
def id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids cited but not defined, the other way round, and defined twice."""
    return quality.id_problems(quality.scan_ids(marked_lines(spark, sf_dir), "doc", ["S"]), "doc").filter("message not like '%gap%'")


@query(
    "caption_numbers",
    rf"""WITH c AS (SELECT doc, ord, CASE WHEN line LIKE '![%' THEN 'figure' ELSE 'table' END AS kind FROM ({MD}) WHERE line LIKE '![%' OR line LIKE 'Table:%') SELECT doc, ord, kind, CAST(row_number() OVER (PARTITION BY doc, kind ORDER BY ord) AS INTEGER) AS n FROM c""",
)
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and captioned tables numbered in document order."""
    return quality.caption_numbers(marked_lines(spark, sf_dir), "doc")


ROBOTS_TXT = "SELECT 'h.com' AS host, concat('User-agent: Bot/2.1', chr(10), 'User-agent: other', chr(10), 'Disallow: /private # no', chr(10), 'Allow: /', chr(10), 'Crawl-delay: 4', chr(10), 'User-agent: *', chr(10), 'Disallow:', chr(10), 'Request-rate: 1/9') AS text"


@query(
    "robots_groups",
    """SELECT * FROM (VALUES ('h.com', 1, 'bot', 'rule', '/private', false), ('h.com', 1, 'other', 'rule', '/private', false), ('h.com', 1, 'bot', 'rule', '/', true), ('h.com', 1, 'other', 'rule', '/', true),
('h.com', 1, 'bot', 'crawl-delay', NULL, NULL), ('h.com', 1, 'other', 'crawl-delay', NULL, NULL), ('h.com', 2, '*', 'request-rate', NULL, NULL)) AS t(host, grp, agent, kind, pattern, allow)""",
)
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file as rows: groups, agents and rules."""
    return robots.parse_rules(given(spark, sf_dir, ROBOTS_TXT)).select("host", F.col("grp").cast("int").alias("grp"), "agent", "kind", "pattern", "allow")


WANTED = """SELECT d.doc_id AS q, CASE WHEN l.toxic = 1 THEN concat('i', CAST(d.doc_id AS STRING)) END AS id, CASE WHEN l.quality = 1 THEN substr(md5(d.text), 1, 8) END AS fingerprint, concat(d.source, '-', CAST(d.n_chars AS STRING)) AS ref
  FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id"""
ENTRIES = """SELECT doc_id AS ord, concat('i', CAST(doc_id AS STRING)) AS id, CASE WHEN doc_id % 4 > 0 THEN substr(md5(text), 1, 8) END AS fingerprint, concat(source, '-', CAST(n_chars AS STRING)) AS ref, doc_id % 2 = 0 AS applied FROM @documents"""


@query(
    "answered_by",
    f"""WITH w AS ({WANTED}), e AS ({ENTRIES}), m AS (SELECT w.q, e.ord, e.applied FROM w JOIN e ON CASE WHEN w.id IS NOT NULL THEN w.id = e.id WHEN w.fingerprint IS NOT NULL AND e.fingerprint IS NOT NULL THEN w.fingerprint = e.fingerprint ELSE w.ref = e.ref END)
SELECT w.q, (SELECT m.ord FROM m WHERE m.q = w.q ORDER BY applied, ord LIMIT 1) AS entry FROM w""",
)
def answered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake entry that answers each question: by id, else fingerprint, else reference; live before closed."""
    return integrity.first_match(given(spark, sf_dir, WANTED), given(spark, sf_dir, ENTRIES), "q")


TARGETS = "SELECT CAST(doc_id AS STRING) AS path FROM @documents"
DECLARED = "SELECT CAST(doc_id AS STRING) AS path FROM @labels"


@query("scope_differences", f"SELECT path, 'undeclared' AS problem FROM (({TARGETS}) EXCEPT ({DECLARED})) UNION ALL SELECT path, 'not a target' FROM (({DECLARED}) EXCEPT ({TARGETS}))")
def scope_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set differences both ways between declared and target scope."""
    a, b = given(spark, sf_dir, TARGETS), given(spark, sf_dir, DECLARED)
    return a.exceptAll(b).distinct().withColumn("problem", F.lit("undeclared")).unionByName(b.exceptAll(a).distinct().withColumn("problem", F.lit("not a target")))


EN = values("key, v", "('toc', 'Contents')", "('figure', 'Figure')", "('table', 'Table')", "('note', 'Note')")
IT = values("key, v", "('toc', 'Indice')", "('figure', 'Figura')", "('extra', 'Altro')")


@query("pack_fallback", f"SELECT coalesce(e.key, i.key) AS key, coalesce(i.v, e.v) AS v, i.key IS NULL AS missing FROM ({EN}) e FULL JOIN ({IT}) i ON e.key = i.key")
def pack_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language pack completed from English, and the keys it lacks."""
    e, i = given(spark, sf_dir, EN).withColumnRenamed("v", "en"), given(spark, sf_dir, IT).withColumnsRenamed({"v": "own"}).withColumn("has", F.lit(True))
    return e.join(i, "key", "full_outer").select("key", F.coalesce("own", "en").alias("v"), F.col("has").isNull().alias("missing"))


VERSIONS = "SELECT doc_id AS doc, concat(CAST(doc_id % 3 AS STRING), '.', CAST(n_chars % 12 AS STRING)) AS old, concat(CAST(n_chars % 3 AS STRING), '.', CAST(doc_id % 11 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.1' ELSE '' END) AS new FROM @documents"


@query("version_order", f"SELECT doc, list_transform(string_split(new, '.'), lambda x: CAST(x AS INT)) > list_transform(string_split(old, '.'), lambda x: CAST(x AS INT)) AS rises FROM ({VERSIONS})")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a version rises, compared number by number."""
    num = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    return given(spark, sf_dir, VERSIONS).select("doc", (num("new") > num("old")).alias("rises"))


OLD_IDS = "SELECT concat('S', CAST(doc_id AS STRING)) AS id, CAST(doc_id AS STRING) AS title FROM @documents"
NEW_IDS = "SELECT DISTINCT concat(CASE quality WHEN 1 THEN 'S' ELSE 'T' END, CAST(doc_id AS STRING)) AS id, CAST(doc_id AS STRING) AS title FROM @labels"


@query("revision_problems", f"SELECT o.id, CASE WHEN n.id IS NOT NULL THEN 'renumbered to ' || n.id ELSE 'gone' END AS problem FROM ({OLD_IDS}) o LEFT JOIN ({NEW_IDS}) n ON n.title = o.title AND n.id <> o.id WHERE o.id NOT IN (SELECT id FROM ({NEW_IDS}))")
def revision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the previous version that are gone, or that their title now has another id."""
    return quality.revision_problems(given(spark, sf_dir, OLD_IDS), given(spark, sf_dir, NEW_IDS))


@query("id_parity", f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only here' ELSE 'only there' END AS problem FROM ({OLD_IDS}) a FULL JOIN ({NEW_IDS}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def id_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric difference of the ids of two language versions."""
    return quality.parity_problems(given(spark, sf_dir, OLD_IDS), given(spark, sf_dir, NEW_IDS))


NAMED = "SELECT doc_id AS ref, CAST(n_chars % 5 AS STRING) AS section, CASE WHEN doc_id % 3 > 0 THEN concat('doc ', lang) ELSE source END AS title FROM @documents"
SECTIONS = "SELECT DISTINCT concat('doc ', lang) AS title, CAST(doc_id % 4 AS STRING) AS number FROM @documents"


@query(
    "set_reference_problems",
    f"""WITH n AS (SELECT r.ref, any_value(r.section) AS section, any_value(r.title) AS title FROM ({NAMED}) r WHERE r.title IN (SELECT title FROM ({SECTIONS})) GROUP BY r.ref HAVING count(DISTINCT r.title) = 1)
SELECT ref, section, title FROM n WHERE NOT EXISTS (SELECT 1 FROM ({SECTIONS}) s WHERE s.title = n.title AND s.number = n.section)""",
)
def set_reference_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that name exactly one other document, and a section it lacks."""
    return quality.set_reference_problems(given(spark, sf_dir, NAMED), given(spark, sf_dir, SECTIONS))


PAIRS = """SELECT d.source AS file, d.doc_id AS id, CASE WHEN g.least_id < d.doc_id THEN 'duplicate → delete' ELSE 'still true' END AS disposition, CASE WHEN g.n > 1 THEN g.least_id END AS of_id
  FROM @documents d JOIN (SELECT md5(text) AS h, min(doc_id) AS least_id, count(*) AS n FROM @documents GROUP BY md5(text)) g ON g.h = md5(d.text)"""


@query(
    "pair_reference_problems",
    f"""WITH p AS ({PAIRS}) SELECT a.file, a.id, CASE WHEN a.of_id = a.id THEN 'names itself' WHEN b.id IS NULL THEN 'no such unit' WHEN b.disposition LIKE 'duplicate%' THEN 'names a removed unit' END AS problem
FROM p a LEFT JOIN p b ON a.file = b.file AND a.of_id = b.id WHERE a.of_id IS NOT NULL AND (a.of_id = a.id OR b.id IS NULL OR b.disposition LIKE 'duplicate%')""",
)
def pair_reference_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that refer to themselves, to none, or to one that is removed."""
    return records.pair_problems(given(spark, sf_dir, PAIRS))


SNAP_A = "SELECT doc_id AS path, md5(text) AS sha FROM @documents"
SNAP_B = "SELECT doc_id AS path, md5(replace(text, '!!', '')) AS sha FROM @documents"


@query("snapshot_changes", f"SELECT coalesce(a.path, b.path) AS path FROM ({SNAP_A}) a FULL JOIN ({SNAP_B}) b ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose content differs between two snapshots."""
    a, b = given(spark, sf_dir, SNAP_A).withColumnRenamed("sha", "x"), given(spark, sf_dir, SNAP_B).withColumnRenamed("sha", "y")
    return a.join(b, "path", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("path")


TERM_SOURCES = "SELECT doc_id AS ord, split_part(text, ' ', 1) AS term FROM @documents"


@query("term_union", f"SELECT arg_min(term, ord) AS term, min(ord) AS first FROM ({TERM_SOURCES}) GROUP BY lower(term)")
def term_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms distinct without case: the first spelling stays."""
    return given(spark, sf_dir, TERM_SOURCES).groupBy(F.lower("term").alias("k")).agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("first")).drop("k")


ADRS = values("name", "('0001-first.md')", "('0007-seventh.md')", "('readme.md')")
NEW_ADRS = values("id, title", "(1, 'Use Spark!')", "(2, '  Drop  the queue ')")


@query(
    "adr_names",
    rf"""WITH m AS (SELECT coalesce(max(TRY_CAST(regexp_extract(name, '^(\d{{4}})-', 1) AS INT)), 0) AS top FROM ({ADRS})), r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM ({NEW_ADRS}))
SELECT id, lpad(CAST(top + k AS VARCHAR), 4, '0') || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS name FROM r, m""",
)
def adr_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of new decision records: the next numbers and a slug."""
    return records.adr_names(given(spark, sf_dir, ADRS), given(spark, sf_dir, NEW_ADRS))


LISTING = "SELECT page_id AS ord, url FROM @pages"


@query("capped_listing", f"SELECT pos, url AS text FROM (SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS pos, url FROM ({LISTING})) WHERE pos <= 5 UNION ALL SELECT 6, (count(*) - 5) || ' more not listed' FROM ({LISTING}) HAVING count(*) > 5")
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_listing(given(spark, sf_dir, LISTING), ["ord"], "url", 5)


PATHS = values("path", "('docs/a.md')", "('src/x.py')", "('meeting-transcript.txt')", "('call.vtt')", "('x/Dockerfile')", "('a.tar.gz')", "('mail.eml')", "('src/page.html')", "('site/page.html')", "('pic.PNG')", "('book.docx')", "('trascrizione.docx')", "('noext')", "('data.json')", "('transcript.json')")


@query(
    "file_kinds",
    r"""SELECT * FROM (VALUES ('docs/a.md', 'text'), ('src/x.py', 'code'), ('meeting-transcript.txt', 'transcript'), ('call.vtt', 'transcript'), ('x/Dockerfile', 'config'), ('a.tar.gz', 'binary'), ('mail.eml', 'mail'), ('src/page.html', 'code'), ('site/page.html', 'web'),
('pic.PNG', 'image'), ('book.docx', 'document'), ('trascrizione.docx', 'transcript'), ('noext', 'other'), ('data.json', 'config'), ('transcript.json', 'transcript')) AS t(path, kind)""",
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, PATHS).select("path", files.classify(F.col("path")).alias("kind"))


HOSTS = values("host", "('127.0.0.1')", "('10.1.2.3')", "('172.20.0.1')", "('172.32.0.1')", "('100.100.100.200')", "('8.8.8.8')", "('169.254.169.254')", "('example.com')", "('224.0.0.1')")


@query("internal_hosts", "SELECT host, internal FROM (VALUES ('127.0.0.1', true), ('10.1.2.3', true), ('172.20.0.1', true), ('172.32.0.1', false), ('100.100.100.200', true), ('8.8.8.8', false), ('169.254.169.254', true), ('example.com', false), ('224.0.0.1', true)) AS t(host, internal)")
def internal_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, HOSTS).select("host", urls.is_internal_ipv4(F.col("host")).alias("internal"))


PEOPLE = values("s", "('Anna Bianchi')", "('Luca De Rossi')", "('Vincent van Gogh')", "('il backup')", "('Speaker 1')", "('A')", "('Il backup termina')", "('')", "('One Two Three Four Five Six')")


@query("person_names", "SELECT s, ok FROM (VALUES ('Anna Bianchi', true), ('Luca De Rossi', true), ('Vincent van Gogh', true), ('il backup', false), ('Speaker 1', true), ('A', true), ('Il backup termina', false), ('', false), ('One Two Three Four Five Six', false)) AS t(s, ok)")
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, PEOPLE).select("s", text.is_name(F.col("s")).alias("ok"))


INTAKE = values(
    "ident, ord, action, kind",
    "('a', 1, 'append', 'suspected-defect')", "('a', 2, 'append', 'suspected-defect')", "('a', 3, 'rule', '')", "('a', 4, 'apply', '')", "('a', 5, 'apply', '')", "('a', 6, 'revert', '')",
    "('b', 7, 'append', 'obsolete-citation')", "('b', 8, 'append', 'obsolete-citation')", "('b', 9, 'apply', '')", "('b', 10, 'rule-external', '')", "('c', 11, 'rule', '')",
)


@query(
    "intake_log",
    """SELECT ident, CAST(ord AS BIGINT) AS ord, state, occurrences, reason IS NULL AS accepted, reason FROM (VALUES ('a', 1, 'open', 1, NULL), ('a', 2, 'open', 1, 'duplicate'), ('a', 3, 'ruled', 1, NULL), ('a', 4, 'applied', 1, NULL), ('a', 5, 'applied', 1, 'not ruled'), ('a', 6, 'open', 1, NULL),
('b', 7, 'open', 1, NULL), ('b', 8, 'open', 2, NULL), ('b', 9, 'open', 2, 'not ruled'), ('b', 10, 'ruled-external', 2, NULL), ('c', 11, '', 0, 'not open')) AS t(ident, ord, state, occurrences, reason)""",
)
def intake_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intake state machine replayed over a log."""
    return stream.intake_states(given(spark, sf_dir, INTAKE).withColumn("ord", F.col("ord").cast("long")))


TRANSLATED = values("id, src, dst, term, translated", "(1, 'Turn 2 times, 10 s', 'Girare 2 volte, 10 s', 'valve', 'valvola')", "(2, 'Use 3 bolts', 'Usare 4 bulloni', 'bolt', 'bullone')", "(3, 'Open valve', 'Aprire saracinesca', 'valve', 'saracinesca')")


@query(
    "translation_problems",
    rf"""WITH t AS ({TRANSLATED}) SELECT 'numbers differ in ' || id AS problem FROM t WHERE list_sort(regexp_extract_all(src, '\d+')) <> list_sort(regexp_extract_all(dst, '\d+'))
UNION ALL SELECT term || ' has ' || count(DISTINCT translated) || ' translations' FROM t GROUP BY term HAVING count(DISTINCT translated) > 1""",
)
def translation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers lost in translation, and terms translated in more than one way."""
    return quality.translation_problems(given(spark, sf_dir, TRANSLATED))


USE_CASES = values("code, priority, sentences, items, depends", "('ORD-001', 'High', 4, 7, NULL)", "('ORD-002', 'Medium', 5, 4, 'ORD-001')", "('ORD-004', 'Low', 1, 2, 'ORD-009')", "('PAY-001', 'High', 3, 3, 'ORD-002')")


@query(
    "use_case_problems",
    rf"""WITH u AS (SELECT *, split_part(code, '-', 1) AS p, CAST(split_part(code, '-', 2) AS INT) AS n FROM ({USE_CASES})),
b AS (SELECT * FROM (VALUES ('High', 3, 5, 5, 15), ('Medium', 2, 3, 3, 8), ('Low', 1, 2, 2, 5)) AS t(priority, s1, s2, i1, i2))
SELECT code, 'number out of sequence' AS problem FROM (SELECT code, n, row_number() OVER (PARTITION BY p ORDER BY n) AS k FROM u) WHERE n <> k
UNION ALL SELECT code, 'depends on ' || depends FROM u WHERE depends IS NOT NULL AND depends NOT IN (SELECT code FROM u)
UNION ALL SELECT u.code, 'size outside its band' FROM u JOIN b USING (priority) WHERE NOT (sentences BETWEEN s1 AND s2 AND items BETWEEN i1 AND i2)""",
)
def use_case_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering gaps, dependencies that don't resolve, and sizes outside the band of a priority."""
    return quality.use_case_problems(given(spark, sf_dir, USE_CASES))


SEVERITY = values("id, src, dst", "(1, 'DANGER', 'WARNING')", "(2, 'WARNING', 'WARNING')", "(3, 'CAUTION', 'DANGER')", "(4, 'NOTICE', 'CAUTION')", "(5, 'CAUTION', 'NOTICE')")


@query("weakened_signals", f"WITH l AS (SELECT * FROM (VALUES ('NOTICE', 1), ('CAUTION', 2), ('WARNING', 3), ('DANGER', 4)) AS t(w, n)) SELECT s.id FROM ({SEVERITY}) s JOIN l a ON a.w = s.src JOIN l b ON b.w = s.dst WHERE b.n < a.n")
def weakened_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal words whose translation says less."""
    return quality.weakened_signals(given(spark, sf_dir, SEVERITY))


BLOCKS = values("pos, kind, lvl, body", "(1, 'heading', 1, 'Intro')", "(2, 'paragraph', 0, 'a|b')", "(3, 'heading', 6, 'Deep')", "(4, 'code', 0, 'x ``` y')", "(5, 'callout', 0, 'mind')", "(6, 'image', 0, 'Alt')")


@query(
    "rendered_blocks",
    f"""SELECT pos, CASE kind WHEN 'heading' THEN repeat('#', least(lvl + 1, 6)) || ' ' || body WHEN 'paragraph' THEN body WHEN 'code' THEN repeat(chr(96), 4) || chr(10) || body || chr(10) || repeat(chr(96), 4) WHEN 'callout' THEN '> ' || body ELSE '![' || body || '](x.png)' END AS markdown FROM ({BLOCKS})""",
)
def rendered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content blocks as Markdown."""
    none = lambda kind: F.lit(None).cast(kind)
    b = given(spark, sf_dir, BLOCKS)
    block = F.struct(F.col("kind").alias("type"), F.col("lvl").alias("level"), F.when(F.col("kind") != "image", F.col("body")).alias("text"), F.lit("").alias("language"), F.lit(False).alias("ordered"), F.lit(0).alias("start"), none("array<string>").alias("items"), none("array<array<string>>").alias("data"), F.lit("x.png").alias("src"), F.col("body").alias("alt"))
    return b.select("pos", markdown.render_block(block).alias("markdown"))


PDF_LINES = values("doc, page, line", *(f"(1, {p}, '{t}')" for p in range(1, 5) for t in ("Manual v2", f"{p}", f"body {p} of the trans-" if p == 2 else f"body {p}")), "(2, 1, 'Manual v2')", "(2, 2, 'Manual v2')")


@query(
    "page_furniture_removed",
    rf"""WITH l AS ({PDF_LINES}), n AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc), r AS (SELECT l.doc, l.line FROM l JOIN n USING (doc) WHERE pages >= 3 GROUP BY l.doc, l.line, pages HAVING count(DISTINCT page) >= 0.6 * pages)
SELECT l.doc, l.page, l.line FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc = l.doc AND r.line = l.line) AND NOT regexp_matches(l.line, '^\s*\d+\s*$')""",
)
def page_furniture_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text without running heads (on six pages in ten, of three at least) and page numbers."""
    return records.drop_page_furniture(given(spark, sf_dir, PDF_LINES))


GREEDY = values("doc, ord, hits", "(1, 1, array(1, 4))", "(1, 2, array(1, 3))", "(1, 3, array(2))", "(1, 4, array(9))").replace("array", "ARRAY")


@query("heading_pages", "SELECT doc, ord, page FROM (VALUES (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 9)) AS t(doc, ord, page)")
def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each heading: the first hit not before the previous heading's page."""
    return records.greedy_pages(given(spark, sf_dir, GREEDY))
