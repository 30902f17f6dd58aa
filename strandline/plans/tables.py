"""Queries over readers and writers that need no files of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import writers as W
from .base import EV, query, streams, table


@query("a02_filtered_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def a02(spark, sf):
    """With a01: two columns are read, and the filter is pushed."""
    return R.columns_where(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_returnflag") == "R")


@query("a05_first_of_group", "SELECT conv_id, role, count(*) OVER (PARTITION BY conv_id) AS rows FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1")
def a05(spark, sf):
    return R.first_of_group(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "role", "rows")


@query("a14_tail", f"WITH {EV} SELECT s, pos FROM ev QUALIFY row_number() OVER (PARTITION BY s ORDER BY pos DESC) <= 5")
def a14(spark, sf):
    """The last five rows of each stream; the limit is the feature."""
    return R.tail(streams(spark, sf), ["s"], "pos", 5).select("s", "pos")


@query("a12_first_links", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS link FROM pages")
def a12(spark, sf):
    df = table(spark, sf, "pages").withColumn("links", F.array(F.lit("mailto:a"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.lit("ftp://b")), F.lit("ftp://c")))
    return R.first_link(df, "links", "^https?://").select("page_id", "link")


@query("a15_held_keys", f"WITH {EV} SELECT s AS session, pos, (pos + 7 * s) % 90 BETWEEN 0 AND 5 AS a, (pos + 7 * s) % 90 BETWEEN 10 AND 16 AS b FROM ev")
def a15(spark, sf):
    return R.held_keys(streams(spark, sf), "s", "pos", ["a", "b"])


@query("a17_override_maps", "WITH o AS (SELECT o_custkey, o_orderpriority AS k, min(o_orderkey) AS v FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(k || '=' || v, ';' ORDER BY k) AS overrides FROM o GROUP BY 1")
def a17(spark, sf):
    made = R.override_map(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")
    pairs = F.transform(F.map_entries("overrides"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return made.select("o_custkey", F.array_join(pairs, ";").alias("overrides"))


@query("b04_bounded_parts", f"WITH {EV}, n AS (SELECT s, pos, (pos - 1) // 12 AS part_no FROM ev) SELECT s, part_no, count(*) AS n FROM n GROUP BY ALL HAVING count(*) >= 5")
def b04(spark, sf):
    return W.parts(streams(spark, sf), ["s"], "pos", 12, 5).groupBy("s", "part_no").agg(F.count("*").alias("n"))


@query("b05_upserted", "SELECT doc_id, quality AS q FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT DISTINCT doc_id, 2 FROM documents WHERE n_chars > 500")
def b05(spark, sf):
    fresh = table(spark, sf, "documents").where("n_chars > 500").select("doc_id", F.lit(2).alias("q")).distinct()
    return W.upserted(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q")), fresh, ["doc_id"])
