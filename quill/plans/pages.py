"""Queries over web pages: canonical keys, scope, links, robots, rendering verdicts, titles and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import graph, html, robots
from ..registry import query
from ..sources import table

#: The canonical key in SQL, for URLs whose query values need no encoding.
KEY_SQL = r"""
    regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') ||
    CASE WHEN p = '' OR (NOT regexp_matches(p, '[^/]*[^./][^/]*\.[^./]*$') AND NOT p LIKE '%/') THEN p || '/'
         WHEN lower(regexp_extract(p, '[^/]*$')) IN ('index.html','index.htm','index.php','index.aspx','index.jsp','index.shtml','default.html','default.htm','default.aspx','default.php') THEN regexp_replace(p, '[^/]*$', '')
         ELSE p END ||
    CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END"""
PARTS_SQL = r"""
  SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ('sid','session','utm_source','utm_medium','utm_campaign','ref','source')) AS q
  FROM pages"""
ROOT_SQL = r"array_to_string(string_split(host, '.')[-2:], '.')"
VISIBLE_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"""


def visible_text(page: Column) -> Column:
    """Page text without scripts, styles and tags, white space collapsed; the plain rule, not the extractor's."""
    t = F.regexp_replace(page, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"[ \t\n\r]+", " "))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("key"))


@query("page_canonical_dedup", f"WITH u AS ({PARTS_SQL}) SELECT {KEY_SQL} AS key, min(page_id) AS page_id, count(*) AS n_variants FROM u GROUP BY 1")
def page_canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each canonical page: its first spelling and how many there are."""
    return keyed(spark, sf_dir).groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_variants"))


@query("pages_per_registrable_root", f"WITH u AS ({PARTS_SQL}) SELECT {ROOT_SQL} AS root, count(*) AS n_pages, count(DISTINCT {KEY_SQL}) AS n_keys, count(DISTINCT host) AS n_hosts FROM u GROUP BY 1")
def pages_per_registrable_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.netloc(F.col("url"))
    df = keyed(spark, sf_dir).select("key", host.alias("host"), urls.registrable_root(host).alias("root"))
    return df.groupBy("root").agg(F.count("*").alias("n_pages"), F.count_distinct("key").alias("n_keys"), F.count_distinct("host").alias("n_hosts"))


_SCOPE_SQL = rf"""
WITH u AS ({PARTS_SQL})
SELECT page_id, CASE WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'domain'
  WHEN lower(regexp_extract(p, '[^/]*[^./][^/]*(\.[^./]*)$', 1)) IN ('.pdf','.zip','.docx') THEN 'binary'
  WHEN p LIKE '/en/1%' OR NOT (p LIKE '/en/%' OR p LIKE '/de/%') THEN 'path' END AS reason
FROM u"""


@query("page_scope_filter", _SCOPE_SQL)
def page_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page is out of a subdomain scope with path prefixes; null where it is in."""
    reason = urls.scope_reason(F.col("url"), "help.example.com", "subdomains", include=("en/", "/de/"), exclude=("/en/1",))
    return table(spark, sf_dir, "pages").select("page_id", reason.alias("reason"))


@query(
    "page_href_links",
    r"""
WITH h AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages),
l AS (SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS href FROM h)
SELECT page_id, pos, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target,
  lower(regexp_extract(href, '[^/]*[^./][^/]*(\.[^./]*)$', 1)) IN ('.pdf','.zip','.tar','.gz','.rar','.7z','.mp4','.mp3','.avi','.mov','.mkv','.webm','.exe','.dmg','.pkg','.deb','.rpm','.xls','.xlsx','.ppt','.pptx','.doc','.docx') AS is_binary
FROM l WHERE NOT regexp_matches(lower(trim(href)), '^(mailto:|tel:|javascript:|#|data:|$)')""",
)
def page_href_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of a page, resolved, and whether it leads to a file."""
    links = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))
    links = links.filter(urls.is_page_link(F.col("href")))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href", urls.resolve(F.col("url"), F.col("href")).alias("target"), urls.extension(urls.path(F.col("href"))).isin(*urls.BINARY_EXTENSIONS).alias("is_binary"))


@query(
    "page_link_counts",
    r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, count(DISTINCT href) AS n_links FROM l WHERE regexp_matches(href, '^/[^/]') GROUP BY page_id""",
)
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pages of the same site that a page links to: fragments folded, files left out."""
    links = page_href_links(spark, sf_dir).filter(~F.col("is_binary")).join(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    same = urls.strip_www(urls.netloc(F.col("target"))) == urls.strip_www(urls.netloc(F.col("url")))
    return links.filter(same).groupBy("page_id").agg(F.count_distinct(F.substring_index("target", "#", 1)).alias("n_links"))


#: Pages and the links they share as one graph: a page leads to its links in their order, a link to the pages that carry it, in the order of their ids.
EDGES = """SELECT 'p' || page_id AS src, unnest(range(len(hs))) AS ord, 'l' || unnest(hs) AS dst FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages)
  UNION ALL SELECT DISTINCT 'l' || unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)), page_id, 'p' || page_id FROM pages"""


def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of EDGES."""
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    page, link = F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("l"), F.col("href"))
    out = links.select(page.alias("src"), F.col("pos").cast("long").alias("ord"), link.alias("dst"))
    return out.unionByName(links.select(link.alias("src"), F.col("page_id").alias("ord"), page.alias("dst")).distinct())


@query(
    "link_frontier_depth",
    f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({EDGES})), r AS (
  SELECT 'p0' AS key, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.key WHERE r.depth < 7
) SELECT key, min(depth) AS depth FROM r GROUP BY key""",
)
def link_frontier_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and links reached from page 0 in seven steps over shared links, and their depth."""
    return graph.reachable(spark.range(1).select(F.lit("p0").alias("key")), shared_links(spark, sf_dir), 7)


@query(
    "visit_order",
    f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, min(ord) AS ord FROM ({EDGES}) GROUP BY src, dst), r AS (
  SELECT 0 AS depth, list(k ORDER BY page_id) AS front, list(k) AS seen FROM (SELECT 'p' || page_id AS k, page_id FROM pages WHERE page_id < 3)
  UNION ALL
  SELECT r.depth + 1, n.front, list_concat(r.seen, n.front) FROM r, LATERAL (
    SELECT list(dst ORDER BY spot, dst) AS front FROM (
      SELECT e.dst, min(f.i * 1000000000000 + e.ord) AS spot FROM (SELECT unnest(r.front) AS src, generate_subscripts(r.front, 1) AS i) f JOIN e ON e.src = f.src WHERE NOT list_contains(r.seen, e.dst) GROUP BY e.dst)) n
  WHERE r.depth < 6 AND len(n.front) > 0
), o AS (
  SELECT depth, i, k AS key, row_number() OVER (ORDER BY depth, i) - 1 AS place FROM (SELECT depth, unnest(front) AS k, generate_subscripts(front, 1) AS i FROM r)
)
SELECT key, depth, place FROM o WHERE place < 400""",
)
def visit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 visits of a queue that starts with the first three pages and follows shared links, six deep at most."""
    seeds = table(spark, sf_dir, "pages").filter("page_id < 3").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("page_id").alias("ord"))
    return graph.visit_order(seeds, shared_links(spark, sf_dir), max_pages=400, max_depth=6)


@query(
    "site_frontier",
    rf"""
WITH u AS ({PARTS_SQL}), k AS (SELECT DISTINCT {KEY_SQL} AS key FROM u),
l AS (SELECT DISTINCT {KEY_SQL} AS key FROM (
  SELECT url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, []::VARCHAR[] AS q FROM (
    SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS url FROM (SELECT url, unnest(regexp_extract_all(html, 'href="(/[^"?#]*)"', 1)) AS href FROM pages))))
SELECT key FROM l WHERE key NOT IN (SELECT key FROM k)""",
)
def site_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical targets of links that no page of the table is: what a crawl would visit next."""
    links = page_href_links(spark, sf_dir).filter(F.col("href").rlike("^/[^?#]*$"))
    return links.select(urls.canonical(F.col("target")).alias("key")).distinct().join(keyed(spark, sf_dir).select("key"), "key", "left_anti")


#: Rules for hosts of the page table and for one that has none; a named agent, wildcards, an end anchor and a tie.
ROBOTS = """SELECT host, rule AS pattern, allow FROM (VALUES
  ('www.therer.example.com', '/fr/', false), ('www.therer.example.com', '/fr/1', true), ('www.therer.example.com', '/*.html$', false),
  ('blog.ththan.example.net', '/', false), ('blog.ththan.example.net', '/e', true), ('blog.ththan.example.net', '/en/9*', false),
  ('www.therti.example.com', '/en/*', false), ('www.therti.example.com', '/en/*', true), ('m.ththth.example.net', '*ref=x', false)) AS t(host, rule, allow)"""


@query(
    "robots_decision",
    rf"""
WITH r AS ({ROBOTS}), u AS (
  SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS target FROM pages
), m AS (
  SELECT page_id, length(pattern) AS len, allow FROM u JOIN r USING (host)
  WHERE regexp_matches(target, '^' || replace(regexp_escape(rtrim(pattern, '$')), '\*', '.*') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END)
)
SELECT u.page_id, coalesce(arg_max(allow, 2 * len + CAST(allow AS INT)), true) AS allowed, CAST(max(len) AS INT) AS rule_len
FROM u LEFT JOIN m USING (page_id) GROUP BY u.page_id""",
)
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether robots rules let each page be fetched, and the length of the rule that decides."""
    rules = spark.sql(ROBOTS).select("host", F.lit("rule").alias("kind"), "pattern", "allow", F.length("pattern").alias("len"))
    return robots.decide(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query(
    "page_js_verdict",
    f"""
WITH v AS (SELECT page_id, length({VISIBLE_SQL}) AS visible_chars, strlen(html) AS bytes FROM pages)
SELECT page_id, visible_chars, bytes, visible_chars < 200 OR (bytes > 2000 AND visible_chars < bytes * 0.02) AS js_rendered FROM v""",
)
def page_js_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page looks rendered by scripts: little visible text, or a tiny share of its bytes."""
    html_ = F.col("html")
    df = table(spark, sf_dir, "pages").select("page_id", F.length(visible_text(html_)).cast("long").alias("visible_chars"), F.octet_length(html_).cast("long").alias("bytes"))
    return df.withColumn("js_rendered", (F.col("visible_chars") < 200) | ((F.col("bytes") > 2000) & (F.col("visible_chars") < F.col("bytes") * 0.02)))


@query(
    "page_text_sparse",
    f"""
WITH v AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, length({VISIBLE_SQL}) AS chars, len(regexp_extract_all(html, '<img[ >]')) AS images FROM pages)
SELECT host, count(*) AS n_pages, avg(chars) AS avg_chars, CAST(sum(images) AS BIGINT) AS images, avg(chars) < 150 AND sum(images) < count(*) AS sparse FROM v GROUP BY host""",
)
def page_text_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: whether its pages hold too little to build a document from."""
    df = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.length(visible_text(F.col("html"))).alias("chars"), F.regexp_count("html", F.lit("<img[ >]")).alias("images"))
    out = df.groupBy("host").agg(F.count("*").alias("n_pages"), F.avg("chars").alias("avg_chars"), F.sum("images").alias("images"))
    return out.withColumn("sparse", (F.col("avg_chars") < 150) & (F.col("images") < F.col("n_pages")))


@query(
    "page_title_rule",
    r"""
WITH t AS (SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS h1 FROM pages)
SELECT page_id, CASE WHEN h1 <> '' AND (title = '' OR NOT starts_with(title, h1) OR length(h1) * 2 > length(title)) THEN h1 ELSE title END AS title FROM t""",
)
def page_title_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading, unless it is only a short beginning of the page's title."""
    title, h1 = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), F.trim(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    use = (h1 != "") & ((title == "") | ~title.startswith(h1) | (F.length(h1) * 2 > F.length(title)))
    return table(spark, sf_dir, "pages").select("page_id", F.when(use, h1).otherwise(title).alias("title"))


@query(
    "page_file_kind",
    r"""
WITH u AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*[^./][^/]*(\.[^./]*)$', 1)) AS ext FROM pages)
SELECT page_id, ext, CASE WHEN ext IN ('.html', '.htm', '.mhtml') THEN 'web' ELSE 'other' END AS kind FROM u""",
)
def page_file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of file that a page's path names, the first rule that holds."""
    from ..functions.files import classify

    p = urls.path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", urls.extension(p).alias("ext"), classify(p).alias("kind"))


@query("page_sniff", "SELECT page_id, regexp_matches(lower(left(html, 1024)), '<!doctype html|<html|<head|<body') AS looks_like_html, md5(url)[1:12] AS url_key FROM pages")
def page_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a body looks like HTML in its first 1024 characters, and the key its URL is stored under."""
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.left("html", F.lit(1024))).rlike("<!doctype html|<html|<head|<body").alias("looks_like_html"), F.substring(F.md5(F.col("url").cast("binary")), 1, 12).alias("url_key"))


@query(
    "page_anchors",
    r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, replace(regexp_replace(lower(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))), '[^\p{L}\p{N}_\- ]', '', 'g'), ' ', '-') AS a FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY host, a ORDER BY page_id) - 1 AS k FROM a)
SELECT page_id, CASE WHEN k = 0 THEN a ELSE a || '-' || k END AS anchor FROM n""",
)
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading anchors with a number after each repeat on a host."""
    a = tx.anchor(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    df = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), a.alias("a"))
    k = F.row_number().over(Window.partitionBy("host", "a").orderBy("page_id")) - 1
    return df.withColumn("k", k).select("page_id", F.when(F.col("k") == 0, F.col("a")).otherwise(F.concat("a", F.lit("-"), F.col("k").cast("string"))).alias("anchor"))


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of each page with headings, items, cells and link targets marked."""
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text")).withColumn("n_chars", F.length("text"))


@query("page_blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content blocks of each page in order: kind, level, text, items and rows."""
    page = table(spark, sf_dir, "pages").select("page_id", html.extract_page("html", "url").alias("p"))
    return page.select("page_id", "p.title", F.posexplode_outer("p.content").alias("pos", "b")).select("page_id", "title", "pos", "b.type", "b.level", "b.text", "b.ordered", "b.items")
