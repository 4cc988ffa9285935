"""Event-time windows, the same expressions for tables and streams. A stream needs ``with_lateness`` first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_lateness(stream: DataFrame, at: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late)


def tumbling(df: DataFrame, at: str, length: str, key: str, value: str) -> DataFrame:
    g = df.groupBy(F.window(at, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sliding(df: DataFrame, at: str, length: str, slide: str, key: str) -> DataFrame:
    return df.groupBy(F.window(at, length, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def sessions(df: DataFrame, at: str, gap: str, key: str) -> DataFrame:
    g = df.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
