"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import transcripts
from ..registry import query
from ..sources import table

NAMES = "SELECT * FROM (VALUES ('user', 'Anna Bianchi'), ('assistant', 'Luca De Rossi'), ('2', 'Marco')) AS t(label, name)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit("").alias("t"), F.col("role").alias("speaker"), "text")


@query("speaker_rename", f"WITH n AS ({NAMES}) SELECT conv_id, turn, coalesce(n.name, c.role) AS speaker FROM conversations c LEFT JOIN n ON n.label = c.role")
def speaker_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker labels replaced by names where there are names."""
    return transcripts.rename_speakers(turns(spark, sf_dir), spark.sql(NAMES)).select("conv_id", "turn", "speaker")


@query(
    "merged_turns",
    """WITH RECURSIVE c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
m AS (SELECT conv_id, rn, role, text, 0 AS ord FROM c WHERE rn = 1 UNION ALL
  SELECT c.conv_id, c.rn, c.role, CASE WHEN c.role = m.role AND length(m.text) + length(c.text) <= 700 THEN m.text || ' ' || c.text ELSE c.text END,
    CASE WHEN c.role = m.role AND length(m.text) + length(c.text) <= 700 THEN m.ord ELSE m.ord + 1 END
  FROM m JOIN c ON c.conv_id = m.conv_id AND c.rn = m.rn + 1)
SELECT conv_id, ord, arg_max(role, rn) AS speaker, arg_max(text, rn) AS text FROM m GROUP BY conv_id, ord""",
)
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one speaker joined up to 700 characters."""
    return transcripts.merge_turns(turns(spark, sf_dir), "conv_id", "turn").select("conv_id", "ord", "speaker", "text")


@query("transcript_lines")
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts: renamed, merged, long turns anchored, one line a turn."""
    rows = transcripts.rename_speakers(turns(spark, sf_dir), spark.sql(NAMES))
    return transcripts.render_turns(transcripts.anchor_long_turns(transcripts.merge_turns(rows, "conv_id", "turn"), "conv_id", "ord"), "conv_id")


@query(
    "speaker_runs",
    """WITH r AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM r)
SELECT conv_id, CAST(island AS BIGINT) AS run, any_value(role) AS role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(text[1:1], '' ORDER BY turn) AS initials FROM i GROUP BY conv_id, island""",
)
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and islands: runs of turns by one speaker."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").withColumn("s", (~F.coalesce(F.col("role") == F.lag("role").over(by), F.lit(False))).cast("int"))
    df = df.withColumn("run", F.sum("s").over(by))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 1).alias("c")))), lambda x: x["c"]), "")
    return df.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), first.alias("initials"))


@query(
    "label_recurrence",
    r"""WITH l AS (SELECT conv_id, role AS label, count(*) AS n FROM conversations GROUP BY 1, 2), t AS (SELECT conv_id, count(*) AS lines FROM conversations GROUP BY 1)
SELECT l.conv_id, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS labelled, any_value(lines) AS lines, max(n) >= 2 AND sum(n) >= 0.3 * any_value(lines) AS dialogue FROM l JOIN t USING (conv_id) GROUP BY l.conv_id""",
)
def label_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether labels recur as in a dialogue: one does, and labelled lines are three in ten at least."""
    labels = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    out = labels.groupBy("conv_id").agg(F.max("n").alias("most"), F.sum("n").alias("labelled"), F.sum("n").alias("lines"))
    return out.withColumn("dialogue", (F.col("most") >= 2) & (F.col("labelled") >= 0.3 * F.col("lines")))
