"""Deterministic samples and capped listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_sample(df: DataFrame, group: str, ident: str, baseline: str, rate: float) -> DataFrame:
    """``ceil(n * rate)`` rows of each group: those with the lowest sha1 of baseline:group:id. The same rows every time.

    Only rows under a bound on the hash are ranked, which holds the wanted ones but for a chance of about 1e-12; a group in which it doesn't is
    ranked as a whole.
    """
    h = F.sha1(F.concat_ws(":", F.lit(baseline), F.col(group), F.col(ident).cast("string")).cast("binary"))
    hashed = df.withColumn("__h", h).withColumn("__u", F.conv(F.substring("__h", 1, 12), 16, 10).cast("double") / 16.0**12)
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") * rate).alias("__k"), F.count("*").alias("__n"))
    sizes = sizes.select(group, "__k", ((F.col("__k") + 8 * F.sqrt("__k") + 30) / F.col("__n")).alias("__t"))
    near = hashed.join(sizes, group).filter("__u <= __t")
    few = sizes.join(near.groupBy(group).agg(F.count("*").alias("__c")), group, "left").filter("coalesce(__c, 0) < __k").drop("__c")
    rest = hashed.join(few, group).filter("__u > __t")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__h", ident))
    return near.unionByName(rest).withColumn("__rn", rank).filter("__rn <= __k").select(*df.columns)


def capped_listing(df: DataFrame, order: list[str], text: str, most: int) -> DataFrame:
    """(pos, text): the first ``most`` rows in order, and a last row that tells how many more there are."""
    top = df.orderBy(*order).limit(most).select(F.row_number().over(Window.orderBy(*order)).alias("pos"), F.col(text).alias("text"))
    more = df.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(most + 1).alias("pos"), F.concat((F.col("n") - most).cast("string"), F.lit(" more not listed")).alias("text"))
    return top.unionByName(more)
