"""Queries that write the tables into files of a folder all machines share, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranges import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from .base import EV, query, streams, table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


@query("a03_versioned_csv", "SELECT p_partkey, p_name, p_size, p_partkey % 2 = 1 AS checked FROM part")
def a03(spark, sf):
    """Parts as CSV of an old version (without `checked`, which reads as true here) and of the new one."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 2 == 1).alias("checked"))
    versions = [_schema("p_partkey long, p_name string, p_size int"), _schema("p_partkey long, p_name string, p_size int, checked boolean")]
    folder, out = _folder(spark), None
    for name, rows in (("old", parts.where("checked").drop("checked")), ("new", parts.where("NOT checked"))):
        rows.write.csv(f"{folder}/{name}", header=True)
        read = R.versioned_csv(spark, f"{folder}/{name}", versions, {"checked": F.lit(True)})
        out = read if out is None else out.unionByName(read)
    return out


@query("a04_json_tree", "SELECT 'r=' || n_regionkey AS region, 'n=' || n_nationkey AS nation, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def a04(spark, sf):
    """Customers as JSON in a tree of folders by region and nation."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    folder = _folder(spark)
    # One folder a nation; files of JSON lines are read line by line.
    rows.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), "c_custkey", "c_name").write.partitionBy("r", "n").json(folder)
    return R.json_tree(spark, folder, _schema("c_custkey long, c_name string"), "*.json", ["region", "nation"], lines=True)


@query("a06_json_lines", "SELECT event_id, event_type, value FROM events")
def a06(spark, sf):
    folder = _folder(spark)
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(folder)
    return R.json_lines(spark, folder, _schema("event_id long, event_type string, value double"), ["event_id", "event_type"])


@query("a07_id_list", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def a07(spark, sf):
    folder = _folder(spark)
    table(spark, sf, "orders").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" "))).write.text(folder)
    return R.id_list(spark, folder)


def _archives(spark, sf):
    """Streams as one archive each."""
    folder = _folder(spark)
    df = streams(spark, sf).select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("stream"), "pos", "k", F.array("k", F.col("pos")).alias("pair"), "p", "x")
    W.write_archives(df, folder, "stream", "pos", ["k", "pair", "p", "x"])
    return folder


@query("a08_array_rows", f"WITH {EV} SELECT 's' || s AS stream, pos - 1 AS \"row\", pos, k, k AS first, pos AS second, p, x FROM ev")
def a08(spark, sf):
    rows = R.array_rows(spark, _archives(spark, sf), ident="session", arrays={"pair": (["int64"], (None, 2)), "x": (["bool"], (None,))})
    stream = F.regexp_extract("file", r"([^/]+)\.npz$", 1)
    return rows.select(stream.alias("stream"), "row", "pos", "k", F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"), "p", "x")


@query("a09_array_headers", f"""WITH {EV}, n AS (SELECT s, count(*) AS n FROM ev GROUP BY s)
SELECT 's' || s AS stream, a AS "array", CASE a WHEN 'session' THEN '' WHEN 'pair' THEN n || ',2' ELSE CAST(n AS VARCHAR) END AS shape, t AS dtype FROM n, (VALUES ('pos', '<i8'), ('k', '<i8'), ('pair', '<i8'), ('p', '<f8'), ('x', '|b1')) AS v(a, t)""")
def a09(spark, sf):
    heads = R.array_headers(spark, _archives(spark, sf)).where("array <> 'session'")
    return heads.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("stream"), "array", F.concat_ws(",", F.col("shape").cast("array<string>")).alias("shape"), "dtype")


@query("b01_fixed_schema", "SELECT o_orderkey, CAST(o_totalprice AS FLOAT) AS price, o_orderstatus AS status FROM orders")
def b01(spark, sf):
    """Written against a schema, with a folder for every status."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderkey")
    folder = _folder(spark)
    W.publish(rows, folder, _schema("o_orderkey long not null, price float, status string"), ["status"])
    return spark.read.schema("o_orderkey long, price float, status string").parquet(folder)


@query("b02_no_overwrite", "SELECT s_suppkey, s_name, true AS refused FROM supplier")
def b02(spark, sf):
    """A second publication into a folder is refused and changes nothing."""
    folder, schema = _folder(spark), _schema("s_suppkey long, s_name string")
    suppliers = table(spark, sf, "supplier")
    W.publish(suppliers, folder, schema)
    try:
        W.publish(suppliers.withColumn("s_name", F.lit("other")), folder, schema)
        refused = False
    except Exception as error:
        if "already exists" not in str(error).lower() and "ALREADY_EXISTS" not in str(error):
            raise
        refused = True
    return spark.read.schema(schema).parquet(folder).withColumn("refused", F.lit(refused))


@query("b03_staged_tables", "SELECT 'orders' AS \"table\", (SELECT count(*) FROM orders) AS rows, true AS complete UNION ALL SELECT 'part', (SELECT count(*) FROM part), true")
def b03(spark, sf):
    folder = _folder(spark)
    frames = {n: (table(spark, sf, n), table(spark, sf, n).schema) for n in ("orders", "part")}
    manifest = W.publish_all(frames, folder)
    return manifest.withColumn("complete", F.lit(W.is_complete(spark, folder)))


@query("b07_append_log", "SELECT event_type, count(*) AS n, CAST(CASE WHEN event_type < 'm' THEN 1 ELSE 2 END AS BIGINT) AS times FROM events GROUP BY ALL")
def b07(spark, sf):
    """Two appends of summaries; the log holds both."""
    folder = _folder(spark)
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    W.append_log(counts, folder)
    W.append_log(counts.where("event_type >= 'm'"), folder)
    log = spark.read.schema("event_type string, n long").json(folder)
    return log.groupBy("event_type").agg(F.max("n").alias("n"), F.count("*").alias("times"))
