"""Queries over the windowed forms, run on the tables, and a latch run as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as T
from .base import query, table


@query("k05_tumbling", "SELECT event_type, floor(epoch(time_bucket(INTERVAL '1 hour', ts)))::BIGINT AS start, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY ALL")
def k05(spark, sf):
    out = T.tumbling(table(spark, sf, "events"), ["event_type"], "ts", "1 hour", [F.count("*").alias("n"), F.sum("user_id").alias("users")])
    return out.select("event_type", _utc(spark, "start").alias("start"), "n", "users")


def _utc(spark, column):
    """Seconds of the wall clock that a timestamp shows in the session's zone."""
    return F.unix_seconds(F.to_utc_timestamp(F.from_utc_timestamp(column, F.current_timezone()), F.lit("UTC")))


@query("k05b_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS b FROM events),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM r GROUP BY user_id, r""")
def k05b(spark, sf):
    out = T.sessions(table(spark, sf, "events"), ["user_id"], "ts", "2 hours", [F.count("*").alias("n")])
    return out.select("user_id", _utc(spark, "start").alias("start"), "n")
