"""The query registry and the stream views that queries run on.

streams(): one row per event; s is the stream (user), pos its dense position by (ts, event_id), g a frame
number with gaps and repeats, x a held state, p a probability with many ties, active the activity gate.
EV is the same view as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("s"),
        F.col("event_id").alias("i"),
        pos.alias("pos"),
        F.floor(F.col("event_id") / 100).cast("long").alias("g"),
        F.col("event_type").alias("key"),
        F.col("value").alias("v"),
        k.alias("k"),
        (k / 100).alias("p"),
        (F.col("value") >= 40).alias("x"),
        (F.col("event_type") != "error").alias("active"),
    )


EV = """ev AS (SELECT user_id AS s, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id // 100 AS g, event_type AS key, value AS v,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0 AS p, value >= 40 AS x, event_type <> 'error' AS active FROM events)"""
#: Runs of consecutive g in each stream.
RUNS = """br AS (SELECT *, CASE WHEN g - lag(g) OVER w = 1 THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)),
    ru AS (SELECT *, CAST(sum(b) OVER (PARTITION BY s ORDER BY pos) AS BIGINT) AS run_id FROM br)"""
#: Maximal runs of x: [start_pos, end_pos).
HELD = """hg AS (SELECT s, pos, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS q FROM ev WHERE x),
    held AS (SELECT s, min(pos) AS a, max(pos) + 1 AS b FROM hg GROUP BY s, q)"""
