"""Windowed counts with watermarks. They work on tables as on streams, where late rows are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """A watermark on ts, which is cast to the type that watermarks take."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, by: list[str], ts: str, width: str, aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    """by, start, end and the aggregates of fixed windows."""
    out = timed(df, ts, late).groupBy(*by, F.window(ts, width).alias("w")).agg(*aggregates)
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *out.columns[len(by) + 1 :])


def sessions(df: DataFrame, by: list[str], ts: str, gap: str, aggregates: list[Column], late: str = "0 seconds") -> DataFrame:
    """by, start, end and the aggregates of sessions that end after a gap without rows."""
    out = timed(df, ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(*aggregates)
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *out.columns[len(by) + 1 :])
