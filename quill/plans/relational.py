"""Relational extensions over the star schema: grouping sets, joins by time and pricing summaries. Not operators of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import table


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("sum_base"), F.sum(price * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"))


@query(
    "segment_cube",
    """SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS total, GROUPING(c_mktsegment) * 2 + GROUPING(o_orderstatus) AS level
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)""",
)
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.cube(F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping_id().cast("long").alias("level"))


@query(
    "nation_revenue",
    """SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query(
    "previous_order",
    """SELECT a.o_orderkey, b.o_orderkey AS prev_order, b.o_totalprice AS prev_price FROM orders a ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) b
ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate""",
)
def previous_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last one of its customer on an earlier date: a join as of a time, by one window and no join."""
    o = table(spark, sf_dir, "orders")
    days = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, -1)
    seconds = o.withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).over(days)
    return seconds.withColumn("p", last).select("o_orderkey", F.col("p.o_orderkey").alias("prev_order"), F.col("p.o_totalprice").alias("prev_price"))
