"""Rows with equal keys: the first of them, and their groups.  Keys are summed up before the shuffle; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds duplicate_of: the least ``order`` of the rows with the same key, if it is another row's.  Null keys equal nothing."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return rows.join(first, key, "left").withColumn("duplicate_of", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_first")


def repeated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, last, n) of each key that several rows have."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where("n > 1")
