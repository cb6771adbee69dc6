"""Inputs that queries derive from the data folder's tables, written once in SQL that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def given(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SQL text in which @name stands for a table of the data folder."""
    return spark.sql(re.sub(r"@(\w+)", rf"parquet.`{sf_dir}/\1.parquet`", sql))
