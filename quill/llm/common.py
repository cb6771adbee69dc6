"""Shared-folder staging, table access and input normalisation for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of words and of text normalisation.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one set here where it is unset and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jdir.get() if jdir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder; one for each call."""
    return f"{shared_dir(spark)}/quill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> bool:
    """Delete the tables that this application wrote to the shared folder, once no result that reads them is wanted any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quill/{spark.sparkContext.applicationId}")
    return path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit by which shards are dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Row identity that also tells repeated and null ids apart by their text: ``did`` and ``dth``."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("did"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("dth"),
    ]


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column (letter case doesn't tell columns apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, entries: DataFrame, on: list[str], weight: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``entries``, which have each key once and how many of the ``total`` rows bear it.

    Entries of more than a thousandth of all rows, fewer than a thousand by that, are broadcast, and their rows are dealt out by the
    column ``spread`` afterwards, so no task gets all rows of such a key. ``entries`` is read twice and should be a table. ``how``: inner or left.
    """
    heavy = F.col(weight) * 1000 > total
    top = entries.filter(heavy)
    if top.isEmpty():
        return rows.join(entries, on, how)
    values = [c for c in entries.columns if c not in on]
    hit, salt, match, *early = free([*rows.columns, *entries.columns], "hit", "salt", "match", *(f"top_{c}" for c in values))
    top = top.select(*on, F.lit(True).alias(hit), *(F.col(c).alias(e) for c, e in zip(values, early, strict=True)))
    first = rows.join(F.broadcast(top), on, "left").withColumn(salt, F.when(F.col(hit), F.xxhash64(spread)).otherwise(0))
    rest = entries.filter(~heavy).withColumns({salt: F.pmod(weight, F.lit(1)).cast("long"), match: F.lit(True)})
    out = first.join(rest, [*on, salt], "left")
    if how == "inner":
        out = out.filter(F.coalesce(hit, match, F.lit(False)))
    late = (F.coalesce(F.col(e), F.col(c)).alias(c) for c, e in zip(values, early, strict=True))
    return out.select(*on, *(c for c in rows.columns if c not in on), *late)
