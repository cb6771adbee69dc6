"""One-to-one matching of ordered openers and closers: each event binds once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import numbered, written
from .scans import PIECE, running


def bind_once(events: DataFrame, key: str, order: list[str], opens: Column, closes: Column, latest: bool = False, piece: int = PIECE) -> DataFrame:
    """Each closer bound to one opener of its key before it: (key, opener, closer), both structs of the ``order`` columns, null where there is none.

    A closer takes the earliest opener that is still free (a queue) or, with ``latest``, the latest one (a stack); where none is free it stays unbound and later events go on without it, and openers
    never taken stay unbound too. Every opener and closer is in one row. Rows that neither condition holds for, or both, and rows with a null key take no part.

    Nobody walks the events: a running sum of +1 and -1 and its running minimum tell how many openers are free and which closers find none. In a queue the k-th bound closer takes the k-th opener; in a
    stack openers and closers of one height alternate, so they are counted within their height. Both are one equi-join on (key, height, k), and the sums go in pieces, so a key with a third of all events
    is many tasks. ``order`` should have no ties within a key; tied rows come in the order of ``opens`` before ``closes`` and are otherwise alike.
    """
    opener, closer = F.coalesce(opens, F.lit(False)), F.coalesce(closes, F.lit(False))
    rows = events.filter((opener != closer) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(*order).alias("spot"), opener.alias("opens"))
    rows = written(numbered(rows, [F.col("k"), F.col("spot"), ~F.col("opens")], "events"), "placed")
    step = F.when(F.col("opens"), 1).otherwise(-1).cast("long")
    at = F.col("place")
    rows = written(running(rows, ["k"], ["place"], at, {"total": (F.sum, step)}, piece), "totals")
    # how far the sum fell below zero before a row is the number of closers that found nothing until then; a closer that makes it fall further finds nothing either
    rows = running(rows, ["k"], ["place"], at, {"low": (F.max, -F.col("total"))}, piece, own=False)
    fell = F.greatest(F.col("low"), F.lit(0))
    free = F.col("total") + F.greatest(fell, -F.col("total"))
    rows = rows.withColumns({"alone": ~F.col("opens") & (-F.col("total") > fell), "height": F.when(F.col("opens"), free).otherwise(free + 1)})
    rows = written(rows, "heights")
    by = ["k", "height"] if latest else ["k"]
    live = running(rows.filter("not alone"), by, ["place"], at, {"openers": (F.sum, F.col("opens").cast("long")), "closers": (F.sum, (~F.col("opens")).cast("long"))}, piece)
    live = written(live, "counted")
    left = live.filter("opens").select(*by, F.col("openers").alias("nth"), F.col("spot").alias("opener"))
    right = live.filter("not opens").select(*by, F.col("closers").alias("nth"), F.col("spot").alias("closer"))
    bound = left.join(right, [*by, "nth"], "left").select("k", "opener", "closer")
    unbound = rows.filter("alone").select("k", F.lit(None).cast(rows.schema["spot"].dataType).alias("opener"), F.col("spot").alias("closer"))
    return bound.unionByName(unbound).withColumnRenamed("k", key)
