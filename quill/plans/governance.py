"""Identifiers, archives, gates and records over rows derived from the data folder's tables; what still stands on VALUES has no input there. The same SQL gives the rows in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, languages, times
from ..operators import archive, gates, identifiers, quality, records
from ..registry import query
from .fixtures import values
from .given import given

NOTES = values("id, body", "(1, 'call `Repo.save()` then parse_all and getName')", "(2, 'see Order.items.total (x) or plain words')", "(3, 'nothing here')", "(4, 'getName again, getName twice')")


@query("code_identifiers", "SELECT id, name FROM (VALUES (1, 'save'), (1, 'parse_all'), (1, 'getName'), (2, 'total'), (4, 'getName')) AS t(id, name)")
def code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-shaped names in texts, each once."""
    return identifiers.code_identifiers(given(spark, sf_dir, NOTES), "id", "body").select("id", "name")


TOKENS = values('path, "offset", name'.replace('"offset"', "pos"), "('a.py', 0, 'save')", "('a.py', 40, 'getName')", "('b.py', 5, 'total')")
COMMENTS = values("path, lo, hi", "('a.py', 30, 60)")


@query("absent_identifiers", f"SELECT id, name FROM (VALUES (1, 'save'), (1, 'parse_all'), (1, 'getName'), (2, 'total'), (4, 'getName')) AS t(id, name) WHERE name NOT IN (SELECT name FROM ({TOKENS}) k WHERE NOT EXISTS (SELECT 1 FROM ({COMMENTS}) c WHERE c.path = k.path AND k.pos >= c.lo AND k.pos < c.hi))")
def absent_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that texts mention and no code outside comments has."""
    found = identifiers.code_identifiers(given(spark, sf_dir, NOTES), "id", "body")
    return identifiers.absent_identifiers(found, "id", given(spark, sf_dir, TOKENS).withColumnRenamed("pos", "offset"), given(spark, sf_dir, COMMENTS)).select("id", "name")


CHAT = values("id, body", "(1, '[10:00] Anna: OrbitERP – Orbit Data API (prod)')", "(2, 'Luca: just words here')", "(3, 'the \"pick list\" view, GAM_VIEW')")


@query("chat_terms", "SELECT id, term FROM (VALUES (1, 'OrbitERP'), (1, 'Orbit Data API'), (3, 'GAM_VIEW'), (3, 'pick list')) AS t(id, term)")
def chat_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in chat lines."""
    return identifiers.chat_terms(given(spark, sf_dir, CHAT), "id", "body").select("id", "term")


CONTENTS = """SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(page_id % 7 AS INT) AS depth FROM @pages"""


@query(
    "contents_lines",
    rf"""WITH a AS (SELECT *, replace(regexp_replace(lower(trim(title)), '[^\p{{L}}\p{{N}}_\- ]', '', 'g'), ' ', '-') AS a FROM ({CONTENTS})), n AS (SELECT *, row_number() OVER (PARTITION BY site, a ORDER BY pos) - 1 AS k FROM a)
SELECT site, pos, repeat('  ', least(depth, 4)) || '- [' || title || '](#' || a || CASE WHEN k > 0 THEN '-' || k ELSE '' END || ')' AS line FROM n""",
)
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of an archive, with unique anchors."""
    return archive.toc(given(spark, sf_dir, CONTENTS), "depth")


FILE_REFS = """SELECT page_id AS pos, 0 AS k, regexp_extract(html, 'href="([^"]*)"', 1) AS url, regexp_extract(url, '^([a-z]+):', 1) AS type, url AS name FROM @pages"""


@query("attachments_once", f"SELECT url, arg_min(type, pos * 1000 + k) AS type, arg_min(name, pos * 1000 + k) AS name FROM ({FILE_REFS}) GROUP BY url")
def attachments_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments by URL, the first reference's name."""
    refs = given(spark, sf_dir, FILE_REFS).groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "url", "type", "name"))), lambda r: F.struct(r["url"].alias("url"), r["type"].alias("type"), r["name"].alias("name"))).alias("r"))
    return archive.attachments(refs.select("pos", F.struct(F.col("r").alias("binary_references")).alias("page")))


SITEMAPS = values(
    "url, body",
    "('https://h.com/sitemap.xml', '<sitemapindex><sitemap><loc>https://h.com/a.xml</loc></sitemap><sitemap><loc>https://evil.com/x.xml</loc></sitemap></sitemapindex>')",
    "('https://h.com/a.xml', '<urlset><url><loc> https://h.com/1?a=1&amp;b=2 </loc></url><url><loc>https://h.com/2</loc></url></urlset>')",
    "('https://evil.com/x.xml', '<urlset><url><loc>https://evil.com/3</loc></url></urlset>')",
)


@query(
    "sitemap_pages",
    f"""WITH RECURSIVE i AS (SELECT url, body, regexp_extract(url, '://([^/]+)', 1) AS host FROM ({SITEMAPS})),
l AS (SELECT url, host, body LIKE '<sitemapindex%' AS is_index, replace(trim(regexp_extract(x, '<loc>(.*)</loc>', 1)), '&amp;', '&') AS loc FROM (SELECT url, host, body, unnest(regexp_extract_all(body, '<loc>[^<]*</loc>')) AS x FROM i)),
r AS (SELECT 'https://h.com/sitemap.xml' AS url, 0 AS depth UNION ALL SELECT l.loc, r.depth + 1 FROM r JOIN l ON l.url = r.url WHERE l.is_index AND regexp_extract(l.loc, '://([^/]+)', 1) = l.host AND r.depth < 3)
SELECT l.loc AS url, r.depth FROM r JOIN l ON l.url = r.url WHERE NOT l.is_index""",
)
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that sitemaps list, through an index; other hosts' indexes aren't followed."""
    return archive.sitemap_urls(given(spark, sf_dir, SITEMAPS), ["https://h.com/sitemap.xml"])


CONFIGS = values("id, raw, tracked", "(1, '{\"REMOVED_LINE_CAP\": 500}', true)", "(2, '{\"REMOVED_LINE_CAP\": 500, \"SPOT_CHECK_RATE\": 0.1}', false)", "(3, '{\"REMOVED_LINE_CAP\": 50, \"SPOT_CHECK_RATE\": 0.9}', false)", "(4, '{}', true)")


@query(
    "bounded_config",
    f"""WITH c AS (SELECT id, tracked, TRY_CAST(json_extract_string(raw, '$.REMOVED_LINE_CAP') AS DOUBLE) AS cap, TRY_CAST(json_extract_string(raw, '$.SPOT_CHECK_RATE') AS DOUBLE) AS rate FROM ({CONFIGS}))
SELECT id, CASE WHEN cap IS NULL THEN 200 WHEN tracked THEN cap ELSE least(cap, 200) END AS cap, CASE WHEN rate IS NULL THEN 0.25 WHEN tracked THEN rate ELSE greatest(rate, 0.25) END AS rate FROM c""",
)
def bounded_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caps from a configuration; an untracked one may only tighten them."""
    c = given(spark, sf_dir, CONFIGS).select("id", gates.config(F.col("raw"), F.col("tracked")).alias("c"))
    return c.select("id", F.col("c.REMOVED_LINE_CAP").alias("cap"), F.col("c.SPOT_CHECK_RATE").alias("rate"))


CHECKS = "SELECT user_id AS run, event_id AS ord, event_type AS name, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'advisory' ELSE 'ok' END AS outcome FROM @events"


@query("gate_verdicts", f"SELECT run, CASE max(CASE outcome WHEN 'fail' THEN 2 WHEN 'advisory' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'advisory' ELSE 'ok' END AS verdict, coalesce(list(name ORDER BY ord) FILTER (WHERE outcome = 'fail'), []) AS failed FROM ({CHECKS}) GROUP BY run")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.verdict(given(spark, sf_dir, CHECKS))


HISTORY = "SELECT user_id AS branch, event_id AS ord, event_type <> 'error' AS ok FROM @events"


@query("verified_prefix", f"SELECT branch, ord, ok FROM ({HISTORY}) h WHERE NOT EXISTS (SELECT 1 FROM ({HISTORY}) b WHERE b.branch = h.branch AND b.ord <= h.ord AND NOT b.ok)")
def verified_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits before the first that isn't verified."""
    return gates.verified_prefix(given(spark, sf_dir, HISTORY))


DIFF = values("sha, sign, content", "('a', '-', 'x = 1')", "('a', '+', 'x  =  1')", "('a', '+', '')", "('b', '-', 'y')", "('c', '+', ' ')")


@query(
    "mechanical_commits",
    f"""SELECT sha, coalesce(string_agg(c, '' ORDER BY c) FILTER (WHERE sign = '-'), '') = coalesce(string_agg(c, '' ORDER BY c) FILTER (WHERE sign = '+'), '') AS mechanical
FROM (SELECT sha, sign, regexp_replace(content, '\\s', '', 'g') AS c FROM ({DIFF})) GROUP BY sha""",
)
def mechanical_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that change white space alone."""
    return gates.mechanical_only(given(spark, sf_dir, DIFF))


STALE = "SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN event_type ELSE CAST(CAST(ts AS DATE) AS STRING) END AS observed, CAST(CAST(ts AS DATE) + CAST(event_id % 20 AS INT) AS STRING) AS committed FROM @events"


@query("stale_observations", f"SELECT id, coalesce(date_diff('day', TRY_CAST(observed AS DATE), TRY_CAST(committed AS DATE)) > 7, true) AS stale FROM ({STALE})")
def stale_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, STALE).select("id", gates.stale(F.col("observed"), F.col("committed")).alias("stale"))


RULES = "SELECT user_id AS file, event_id AS distance, CASE WHEN event_type <> 'click' THEN event_type END AS rule FROM @events"


@query("nearest_rules", f"SELECT file, arg_min(rule, distance) AS rule FROM ({RULES}) WHERE rule IS NOT NULL GROUP BY file")
def nearest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.nearest_rule(given(spark, sf_dir, RULES))


ASKED = "SELECT concat(source, '/', CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END, '/', CAST(doc_id AS STRING)) AS path FROM @documents"
TRACKED = "SELECT concat(d.source, '/', d.lang, '/', CAST(d.doc_id AS STRING)) AS path FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id"


@query("spelling_problems", f"SELECT a.path, CASE WHEN t.path IS NULL THEN 'not tracked' ELSE 'spelled ' || t.path END AS problem FROM ({ASKED}) a LEFT JOIN ({TRACKED}) t ON lower(t.path) = lower(a.path) WHERE t.path IS DISTINCT FROM a.path")
def spelling_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.spelling_problems(given(spark, sf_dir, ASKED), given(spark, sf_dir, TRACKED))


SKILLS = "SELECT lower(split_part(text, ' ', 1)) AS name, substr(text, 1, 40) AS description FROM @documents"


@query(
    "package_problems",
    f"""SELECT name, unnest(list_filter([CASE WHEN NOT regexp_matches(name, '^[a-z0-9-]{{1,64}}$') THEN 'name has other characters or is too long' END,
  CASE WHEN coalesce(trim(description), '') = '' THEN 'no description' END, CASE WHEN regexp_matches(description, '[<>]') THEN 'description holds markup' END], lambda x: x IS NOT NULL)) AS problem FROM ({SKILLS})""",
)
def package_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.build_problems(given(spark, sf_dir, SKILLS))


STYLES = """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN concat('#', substr(md5(text), 1, 6)) WHEN 1 THEN ' ' END AS doc, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 5 > 0 THEN substr(md5(source), 1, 6) END AS profile, 'FFFFFF' AS fallback FROM @documents"""


@query("style_settings", f"SELECT id, CASE WHEN regexp_matches(trim(v), '^#?[0-9A-Fa-f]{{6}}$') THEN upper(ltrim(trim(v), '#')) END AS color FROM (SELECT id, coalesce(nullif(trim(doc), ''), nullif(trim(profile), ''), fallback) AS v FROM ({STYLES}))")
def style_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by precedence, validated as colours."""
    return given(spark, sf_dir, STYLES).select("id", gates.valid_color(gates.style(F.col("doc"), F.col("profile"), F.col("fallback"))).alias("color"))


SOURCES = """SELECT concat('p', CAST(doc_id AS STRING), '/', CASE doc_id % 9 WHEN 0 THEN 'b.py' WHEN 1 THEN 'Dockerfile.dev' WHEN 2 THEN 'Makefile' WHEN 3 THEN 'x.TSX' WHEN 4 THEN 'conf.ini' WHEN 5 THEN 'noext' WHEN 6 THEN 'data.json' WHEN 7 THEN '.gitignore' ELSE 'x.hs' END) AS path FROM @documents"""


@query(
    "file_languages",
    f"""SELECT path, CASE WHEN name IN ('makefile', 'rakefile', 'gemfile') THEN 'hash' WHEN name IN ('.gitignore', '.env') OR starts_with(name, 'dockerfile') THEN 'hashline'
  ELSE CASE regexp_extract(name, '.(\\.[^.]*)$', 1) WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'jsx' WHEN '.ini' THEN 'ini' WHEN '.json' THEN 'none' WHEN '.hs' THEN 'haskell' END END AS lang
FROM (SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name FROM ({SOURCES}))""",
)
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, SOURCES).select("path", languages.language(F.col("path")).alias("lang"))


WALK = """SELECT concat('p', CAST(doc_id AS STRING), '/', CASE doc_id % 8 WHEN 0 THEN 'b.py' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN '.git/config' WHEN 3 THEN 'x.min.js' WHEN 4 THEN 'yarn.lock' WHEN 5 THEN 'out/z.txt' WHEN 6 THEN 'app.map' ELSE 'me.txt' END) AS path FROM @documents"""


@query(
    "walked_files",
    f"""SELECT path FROM ({WALK}) WHERE NOT regexp_matches(path, '(^|/)(\\.[^/]*|node_modules|out)/') AND NOT regexp_matches(path, '\\.min\\.js$|\\.lock$|\\.map$')""",
)
def walked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a directory walk keeps."""
    return given(spark, sf_dir, WALK).filter(~files.is_skipped(F.col("path")))


ENTRIES = values("ord, ident, line", "(1, 'a', 'A1')", "(2, 'b', 'B1')")
CHANGES = values("seq, ident, line", "(1, 'b', 'B2')", "(2, 'c', 'C1')", "(3, 'b', 'B3')", "(4, 'd', 'D1')")


@query(
    "intake_upsert",
    f"""WITH c AS (SELECT ident, arg_max(line, seq) AS line, min(seq) AS seq FROM ({CHANGES}) GROUP BY ident)
SELECT e.ord, e.ident, coalesce(c.line, e.line) AS line FROM ({ENTRIES}) e LEFT JOIN c ON c.ident = e.ident
UNION ALL SELECT CAST((SELECT max(ord) FROM ({ENTRIES})) + row_number() OVER (ORDER BY c.seq) AS INTEGER), c.ident, c.line FROM c WHERE c.ident NOT IN (SELECT ident FROM ({ENTRIES}))""",
)
def intake_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intake with changed and new entries."""
    return records.upsert_intake(given(spark, sf_dir, ENTRIES), given(spark, sf_dir, CHANGES))


INTAKE_LINES = """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN lang ELSE concat('- 2026-01-0', CAST(doc_id % 9 + 1 AS STRING), ' `r', CAST(doc_id AS STRING), '` — ', replace(split_part(text, ' ', 1), chr(10), ' '), CASE WHEN doc_id % 2 = 0 THEN ' [kind=suspected-defect state=open]' ELSE '' END) END AS line FROM @documents"""


@query("intake_entries", r"SELECT id, regexp_extract(line, '^- (\S+) `([^`]+)` — (.*?)( \[([a-z]+=[^\]]*)\])?$', 1) AS date, regexp_extract(line, '`([^`]+)`', 1) AS ref, regexp_extract(line, '— (.*?)( \[|$)', 1) AS body FROM (" + INTAKE_LINES + ") WHERE line LIKE '- %'")
def intake_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = given(spark, sf_dir, INTAKE_LINES).select("id", records.intake_fields(F.col("line")).alias("e")).filter("e is not null")
    return e.select("id", "e.date", "e.ref", "e.body")


MESSAGES = """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('consolidation: ', source, chr(10), chr(10), '--- consolidation-record v3 ---', chr(10), 'unit_id: ', CAST(doc_id AS STRING), chr(10), '--- end consolidation-record ---') ELSE concat('fix: ', source) END AS message FROM @documents"""


@query("embedded_records", f"SELECT id, CASE WHEN message LIKE '%--- end%' THEN regexp_extract(message, '(?s)v3 ---\\n(.*?)--- end', 1) END AS record, starts_with(message, 'consolidation:') AS runner FROM ({MESSAGES})")
def embedded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records inside commit messages, and whether a runner wrote the message."""
    m = F.col("message")
    return given(spark, sf_dir, MESSAGES).select("id", records.record_text(m).alias("record"), gates.is_runner_message(m).alias("runner"))


SCOPES = """SELECT doc_id AS id, CASE WHEN doc_id % 10 = 9 THEN '' ELSE concat(source, '.py, docs/', lang, '.md:', CAST(doc_id + 1 AS STRING), '-', CAST(doc_id + 80 AS STRING)) END AS scope FROM @documents"""


@query(
    "scope_entries",
    f"""SELECT id, regexp_replace(e, ':[0-9]+-[0-9]+$', '') AS path, TRY_CAST(regexp_extract(e, ':([0-9]+)-[0-9]+$', 1) AS INTEGER) AS lo, TRY_CAST(regexp_extract(e, '-([0-9]+)$', 1) AS INTEGER) AS hi
FROM (SELECT id, trim(unnest(string_split(scope, ','))) AS e FROM ({SCOPES})) WHERE e <> ''""",
)
def scope_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, SCOPES).select("id", F.explode(records.scope_entries(F.col("scope"))).alias("e")).select("id", "e.path", "e.lo", "e.hi")


FOUND = values("doc, ord, title", "(1, 1, '1. Intro')", "(1, 2, '2. Close')", "(1, 3, '3. Use')", "(2, 1, 'Intro')")
WANTED = values("pos, title", "(1, 'Intro')", "(2, 'Use')", "(3, 'Close')")


@query(
    "chapter_problems",
    f"""WITH f AS (SELECT f.doc, f.ord, w.pos, w.title FROM ({FOUND}) f JOIN ({WANTED}) w ON lower(w.title) = lower(regexp_replace(f.title, '^[0-9.]+\\s+', '')))
SELECT doc, title || ' is out of order' AS problem FROM f a WHERE EXISTS (SELECT 1 FROM f b WHERE b.doc = a.doc AND b.ord < a.ord AND b.pos > a.pos)
UNION ALL SELECT d.doc, w.title || ' is missing' FROM (SELECT DISTINCT doc FROM ({FOUND})) d, ({WANTED}) w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc = d.doc AND f.title = w.title)""",
)
def chapter_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters missing from, or out of, a type's order."""
    return quality.chapter_problems(given(spark, sf_dir, FOUND), given(spark, sf_dir, WANTED))


CARD = values("doc, ord, line", "(1, 1, '## S01 · Start')", "(1, 2, '**Goal:** begin')", "(1, 3, 'and go on')", "(1, 4, '**Who:** Anna')", "(1, 5, '## Other')", "(1, 6, '**Goal:** no')", "(1, 7, '## To be confirmed')", "(1, 8, '- why?')", "(1, 9, '# End')", "(1, 10, 'x')")


@query(
    "card_fields",
    f"""WITH h AS (SELECT *, regexp_extract(line, '^#+ ([A-Z]+[0-9]+)', 1) AS c, line LIKE '#%' AS head, regexp_extract(line, '^\\*\\*([^*]+):\\*\\*', 1) AS f FROM ({CARD})),
s AS (SELECT *, max(CASE WHEN head THEN ord END) OVER (PARTITION BY doc ORDER BY ord) AS under, max(CASE WHEN f <> '' THEN ord END) OVER (PARTITION BY doc ORDER BY ord) AS at FROM h)
SELECT s.doc, any_value(h.c) AS card, CAST(min(s.ord) AS INTEGER) AS ord, max(s.f) AS field, string_agg(trim(regexp_replace(s.line, '^\\*\\*[^*]+:\\*\\*', '')), chr(10) ORDER BY s.ord) AS value
FROM s JOIN h ON h.doc = s.doc AND h.ord = s.under WHERE NOT s.head AND s.at > s.under AND h.c <> '' GROUP BY s.doc, s.under, s.at""",
)
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.card_fields(given(spark, sf_dir, CARD), "doc")


@query(
    "open_questions",
    f"""WITH h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,2}} ') THEN ord END AS head FROM ({CARD})), s AS (SELECT *, max(head) OVER (PARTITION BY doc ORDER BY ord) AS under FROM h)
SELECT s.doc, s.ord, s.line FROM s JOIN h ON h.doc = s.doc AND h.ord = s.under WHERE s.head IS NULL AND lower(h.line) = '## to be confirmed'""",
)
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under a heading of open questions."""
    return quality.to_be_confirmed(given(spark, sf_dir, CARD), "doc")


PORTABLE = "SELECT DISTINCT concat(replace(split_part(text, ' ', 1), chr(10), ' '), ':', lang, CASE WHEN doc_id % 2 = 0 THEN '?.md' ELSE '...' END) AS name FROM @documents"


@query(
    "portable_names",
    f"""SELECT name, CASE WHEN base = '' THEN '_' WHEN regexp_matches(upper(base), '^(CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9])(\\.|$)') THEN '_' || base ELSE base END AS safe
FROM (SELECT name, rtrim(regexp_replace(name, '[<>:"/|?*\\\\]', '_', 'g'), '. ') AS base FROM ({PORTABLE}))""",
)
def portable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, PORTABLE).select("name", archive.portable_name(F.col("name")).alias("safe"))


SECONDS = "SELECT CAST(value * 97 - 300 AS DOUBLE) AS s FROM @events"


@query("clock_strings", f"SELECT CAST(s AS DOUBLE) AS s, CASE WHEN n < 36000 THEN '0' ELSE '' END || n // 3600 || ':' || lpad(CAST(n // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT s, CAST(greatest(0, trunc(CAST(s AS DOUBLE))) AS BIGINT) AS n FROM ({SECONDS}))")
def clock_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, SECONDS).select(F.col("s").cast("double").alias("s"), times.seconds_to_clock(F.col("s").cast("double")).alias("clock"))
