"""Tables in the shared folder: what iterative operators cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or one set here where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = sc._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, and lost executors cost no more than the step that runs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows, written, with their place in the order as ``place`` (from 0).

    Rows are dealt to ranges of the order that Spark samples and numbered inside each; the driver sees one count for each range. No task holds more than its range.
    """
    spark = rows.sparkSession
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    laid = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
    laid = written(laid.withColumns({"__range": F.shiftright("__n", 33), "__at": F.col("__n").bitwiseAND((1 << 33) - 1)}).drop("__n"), name)
    ahead, total = [], 0
    for r in sorted(laid.groupBy("__range").count().collect()):
        ahead.append((r["__range"], total))
        total += r["count"]
    before = F.broadcast(spark.createDataFrame(ahead, "__range long, __ahead long"))
    return laid.join(before, "__range").withColumn("place", F.col("__ahead") + F.col("__at")).drop("__range", "__at", "__ahead")


def lookup(rows: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``entries``, which have each key once; null where the key is null or not among them.

    Keys of more than a thousandth of the rows, fewer than a thousand by that, pass the driver and are looked up in a broadcast of their entries; rows with a null key aren't shuffled at all. Both inputs are read several
    times and should be tables.
    """
    more = [c for c in entries.columns if c != key]
    kind = {f.name: f.dataType for f in entries.schema.fields}
    total = rows.count()
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") * 1000 > total).select(key).collect()
    without = rows.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(kind[c]).alias(c) for c in more))
    rows, columns = rows.filter(F.col(key).isNotNull()), without.columns
    if not found:
        return without.unionByName(rows.join(entries, key, "left").select(*columns))
    often = rows.sparkSession.createDataFrame([tuple(r) for r in found], StructType([rows.schema[key]]))
    hot = rows.join(F.broadcast(often), key, "left_semi").join(F.broadcast(entries.join(F.broadcast(often), key, "left_semi")), key, "left")
    cold = rows.join(F.broadcast(often), key, "left_anti").join(entries, key, "left")
    return without.unionByName(hot.select(*columns)).unionByName(cold.select(*columns))
