"""Queries over events: streaks, paces, first values and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import table
from ..streaming import events as stream


@query(
    "error_streaks",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM events)
SELECT user_id, CAST(streak AS BIGINT) AS streak_id, count(*) AS n, min(event_id) AS first_event, count(*) >= 3 AS blocked FROM e WHERE bad GROUP BY user_id, streak""",
)
def error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of errors between other events of a user; three in a row block."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    e = e.withColumn("streak_id", F.sum((~F.col("bad")).cast("int")).over(by)).filter("bad")
    return e.groupBy("user_id", "streak_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).withColumn("blocked", F.col("n") >= 3)


@query(
    "rising_pace",
    """SELECT user_id, event_id, greatest(1.0, max(least(value, 30.0)) OVER (PARTITION BY user_id ORDER BY event_id)) AS pace FROM events""",
)
def rising_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pace that only rises: the largest delay asked for so far, 30 at most and 1 at least."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.greatest(F.lit(1.0), F.max(F.least("value", F.lit(30.0))).over(by)).alias("pace"))


@query(
    "early_stop",
    """WITH e AS (SELECT user_id, row_number() OVER w AS seq, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, running, running < 10 AS stop FROM e WHERE seq = 10""",
)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running mean at each user's tenth event, and whether it is too thin to go on."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(by).alias("seq"), F.avg("value").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    return e.filter("seq = 10").select("user_id", "running", (F.col("running") < 10).alias("stop"))


@query(
    "first_present",
    """SELECT event_id, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(json_extract_string(props, '$.label'), ''), nullif(json_extract_string(props, '$.k'), ''), event_type) AS value FROM events""",
)
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first property of a list that has a value, else the event's type; properties are read as VARIANT."""
    v = F.try_parse_json("props")
    get = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(get("name"), get("label"), get("k"), F.col("event_type")).alias("value"))


@query(
    "event_windows",
    """SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2""",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of day windows by event time (an extension: the same plan runs on a stream)."""
    return stream.tumbling(table(spark, sf_dir, "events"), "1 day")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM i GROUP BY user_id, k""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps under six hours (an extension)."""
    return stream.sessions(table(spark, sf_dir, "events"), "6 hours")


@query(
    "user_blocks",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM events),
f AS (SELECT user_id, event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, streak ORDER BY event_id) AS INT) AS failures FROM e)
SELECT user_id, event_id, failures, max(failures) OVER (PARTITION BY user_id ORDER BY event_id) >= 3 AS blocked FROM f""",
)
def user_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at each event, and whether the user is blocked by then."""
    return stream.failure_blocks(table(spark, sf_dir, "events"))
