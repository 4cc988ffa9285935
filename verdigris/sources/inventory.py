"""Inventories and digests of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exposure(values: DataFrame) -> DataFrame:
    """kind, value_sha256, occurrences of (kind, value) rows; null values don't count."""
    return values.where("value is not null").groupBy("kind", F.sha2("value", 256).alias("value_sha256")).agg(F.count("*").alias("occurrences"))


def ordered_digest(df: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """keys, digest, n: SHA-256 over the values' digests in order. A key's digests meet in one row, so keys must bound the
    size: some 10 million rows a key."""
    parts = df.select(*keys, F.struct(F.col(order).alias("o"), F.sha2(value, 256).alias("d")).alias("x"))
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("l"), F.count("*").alias("n"))
    return g.select(*keys, F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("digest"), "n")


def strided(df: DataFrame, order: str, k: int, ranges: int = 256) -> DataFrame:
    """Every k-th row by a whole-number column, from the first."""
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    placed = df.join(F.broadcast(span)).withColumn("__r", F.least(F.lit(ranges - 1), F.floor((F.col(order) - F.col("lo")) * ranges / (F.col("hi") - F.col("lo") + 1))).cast("int")).drop("lo", "hi")
    sizes = placed.groupBy("__r").agg(F.count("*").alias("m"))
    before = sizes.select("__r", F.coalesce(F.sum("m").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row a range
    at = F.row_number().over(Window.partitionBy("__r").orderBy(order)) - 1
    return placed.withColumn("__i", at).join(F.broadcast(before), "__r").where((F.col("__i") + F.col("b")) % k == 0).select(*df.columns)
