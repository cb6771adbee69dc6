"""Queries over chains of events and over trees of hashes: ancestry, one-to-one bindings, changed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merkle
from ..operators.binding import bind_once
from ..operators.lineage import lineage
from ..operators.scans import running
from ..registry import query
from ..sources import table
from .given import given


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, kind): each event and the one before it of the same user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    before = running(e, ["user_id"], ["event_id"], F.col("event_id"), {"parent": (F.max, F.col("event_id"))}, own=False)
    return before.select(F.col("event_id").alias("node"), "parent", F.col("event_type").alias("kind"))


@query(
    "event_ancestry",
    """SELECT event_id AS node, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth, NOT bool_or(event_type = 'error') OVER w AS verified,
max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS nearest, row_number() OVER w - max(CASE WHEN event_type = 'purchase' THEN i END) OVER w AS nearest_steps
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def event_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From links to the event before alone: where each chain begins, how far from it an event is, whether all up to it are free of errors, and the nearest purchase on the way back."""
    return lineage(_links(spark, sf_dir), F.col("kind") != "error", F.col("kind") == "purchase").nodes.drop("on_cycle")


@query(
    "event_ancestors",
    """SELECT b.event_id AS b, a.event_id AS a, a.user_id = b.user_id AS is_ancestor FROM events b JOIN events a ON a.event_id = b.event_id // 2""",
)
def event_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the event with half an event's number lies on that event's way back, by climbing doubled pointers."""
    links = _links(spark, sf_dir)
    return lineage(links).ancestors(links.select(F.floor(F.col("node") / 2).alias("a"), F.col("node").alias("b")))


_BOUND = """WITH e AS (SELECT user_id, event_id, event_type = 'click' AS o FROM events WHERE event_type IN ('click', 'purchase') AND user_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN o THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM e),
m AS (SELECT *, greatest(0, max(-total) OVER (PARTITION BY user_id ORDER BY event_id)) AS fell, greatest(0, coalesce(max(-total) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
h AS (SELECT *, NOT o AND -total > low AS alone, CASE WHEN o THEN total + fell ELSE total + fell + 1 END AS height FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY {by}, o ORDER BY event_id) AS nth FROM h WHERE NOT alone)
SELECT a.user_id, a.event_id AS opened, b.event_id AS closed FROM (SELECT * FROM n WHERE o) a LEFT JOIN (SELECT * FROM n WHERE NOT o) b USING ({using}, nth)
UNION ALL SELECT user_id, NULL, event_id FROM h WHERE alone"""


def _bound(spark: SparkSession, sf_dir: str, latest: bool) -> DataFrame:
    kind = F.col("event_type")
    pairs = bind_once(table(spark, sf_dir, "events"), "user_id", ["event_id"], kind == "click", kind == "purchase", latest)
    return pairs.select("user_id", F.col("opener.event_id").alias("opened"), F.col("closer.event_id").alias("closed"))


@query("queue_bindings", _BOUND.format(by="user_id", using="user_id"))
def queue_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase of a user bound to the earliest click that is still free; clicks and purchases that stay unbound."""
    return _bound(spark, sf_dir, False)


@query("stack_bindings", _BOUND.format(by="user_id, height", using="user_id, height"))
def stack_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the latest free click."""
    return _bound(spark, sf_dir, True)


_VALUES = ["lang", "source", "text"]
_CELL = "CASE WHEN {0} IS NULL THEN 'n' ELSE length({0}) || ':' || {0} END"


@query(
    "document_tree",
    f"""WITH RECURSIVE e AS (SELECT path, r, count(*) AS n FROM (SELECT sha256(coalesce('k' || doc_id, 'n')) AS path, sha256({" || ".join(_CELL.format(v) for v in _VALUES)}) AS r FROM documents) GROUP BY 1, 2),
d AS (SELECT CASE WHEN count(*) <= 16 THEN 0 WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 4096 THEN 2 WHEN count(*) <= 65536 THEN 3 ELSE 4 END AS depth FROM e),
x AS (SELECT depth, path, n, sha256(path || ':' || r || ':' || n) AS h FROM e, d),
s AS (SELECT depth, substr(path, 1, depth) AS prefix, sum(n) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS s{i}" for i in range(4))} FROM x GROUP BY ALL),
t AS (SELECT depth AS level, prefix, n, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS hash FROM s
UNION ALL SELECT level - 1, substr(prefix, 1, level - 1), sum(n), sha256(string_agg(prefix || hash, '' ORDER BY prefix)) FROM t WHERE level > 0 GROUP BY level, substr(prefix, 1, level - 1))
SELECT CAST(level AS INT) AS level, prefix, CAST(n AS BIGINT) AS n, hash FROM t""",
)
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the tree of hashes over documents."""
    return merkle.tree(table(spark, sf_dir, "documents"), "doc_id", _VALUES).nodes()


# a later state of documents: some are gone, some have other texts, some are new
_LATER = """SELECT CASE WHEN n_chars % 31 = 3 THEN -1 - doc_id ELSE doc_id END AS doc_id, lang, source, CASE WHEN n_chars % 29 = 2 THEN concat(text, ' ') ELSE text END AS text
FROM @documents WHERE n_chars % 37 <> 1"""


@query(
    "changed_documents",
    f"""WITH b AS ({_LATER}) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM documents a FULL JOIN b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM b.source""",
)
def changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that differ between the table and a later state of it, found by descending two trees of hashes."""
    old = merkle.tree(table(spark, sf_dir, "documents"), "doc_id", _VALUES)
    new = merkle.tree(given(spark, sf_dir, _LATER), "doc_id", _VALUES, depth=len(old.levels) - 1)
    return merkle.differences(old, new)[0].withColumnRenamed("key", "doc_id")
