"""Queries over contract and provenance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from .base import EV, query, streams, table


@query("o01_violations", """SELECT 'price positive' AS rule, CAST(o_orderkey AS VARCHAR) AS subject, o_orderstatus AS detail FROM orders WHERE NOT o_totalprice > 2000
UNION ALL SELECT 'status known', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def o01(spark, sf):
    """With o05: preconditions of every row, all violations in one pass."""
    return K.violations(table(spark, sf, "orders"), F.col("o_orderkey"), {"price positive": F.col("o_totalprice") > 2000, "status known": F.col("o_orderstatus").isin("O", "F")}, F.col("o_orderstatus"))


@query("o02_required", f"WITH {EV} SELECT 'required box.k' AS rule, CAST(i AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS detail FROM ev WHERE k % 7 = 0")
def o02(spark, sf):
    df = streams(spark, sf).select("i", F.struct(F.when(F.col("k") % 7 != 0, F.col("k")).alias("k"), "x").alias("box"))
    return K.required(df, "i", ["box.k", "box.x"])


@query("o04_declared_counts", """WITH d AS (SELECT o_orderkey, count(*) % 8 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(o_orderkey, l_orderkey) AS k, d.n AS dn, coalesce(f.n, 0) AS fn FROM d FULL JOIN f ON o_orderkey = l_orderkey)
SELECT 'declared count' AS rule, CAST(k AS VARCHAR) AS subject, concat_ws(' of ', fn, dn) AS detail FROM j WHERE dn IS DISTINCT FROM fn""")
def o04(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    declared = lines.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k").groupBy("k").agg((F.count("*") % 8).alias("n"))
    return K.declared_counts(declared, lines, "k", "n")


@query("o06_whole_groups", f"WITH {EV}, r AS (SELECT s, min(pos) AS pos FROM ev WHERE k = 99 GROUP BY 1) SELECT s, pos FROM ev WHERE s NOT IN (SELECT s FROM r)")
def o06(spark, sf):
    df = streams(spark, sf)
    return K.whole_groups(df, df.where("k = 99"), "s", "pos", "key")[0].select("s", "pos")


@query("o06b_refused", f"WITH {EV} SELECT s, arg_min(key, pos) AS key FROM ev WHERE k = 99 GROUP BY 1")
def o06b(spark, sf):
    df = streams(spark, sf)
    return K.whole_groups(df, df.where("k = 99"), "s", "pos", "key")[1]


@query("o07_one_value", """SELECT 'one value of ' || c AS rule, CAST(o_custkey AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS detail FROM
(SELECT o_custkey, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b FROM orders GROUP BY 1), (VALUES ('o_orderstatus'), ('o_orderpriority')) AS t(c) WHERE CASE WHEN c = 'o_orderstatus' THEN a ELSE b END <> 1""")
def o07(spark, sf):
    return K.one_value_each(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("o08_close_to", f"WITH {EV} SELECT 'v as in evidence' AS rule, s || '/' || pos AS subject, CAST(NULL AS VARCHAR) AS detail FROM ev WHERE k % 10 = 0 OR k % 10 = 1")
def o08(spark, sf):
    """The evidence lacks a tenth of the rows and differs in another."""
    df = streams(spark, sf)
    evidence = df.where("k % 10 <> 0").withColumn("v", F.when(F.col("k") % 10 == 1, F.col("v") + 1).otherwise(F.col("v")))
    return K.close_to(df, evidence, ["s", "pos"], ["v"], 1e-9)


@query("o09_gated", "SELECT doc_id, CASE WHEN quality = 1 THEN 'passed' WHEN toxic = 1 THEN 'waived' ELSE 'failed' END AS outcome FROM labels")
def o09(spark, sf):
    lab = table(spark, sf, "labels")
    return K.gated(lab, lab.where("toxic = 1"), "doc_id", F.col("quality") == 1)


@query("o11_inventory", """SELECT CAST(page_id AS VARCHAR) AS path, CASE page_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'length' ELSE 'content' END AS problem FROM pages WHERE page_id % 5 < 3""")
def o11(spark, sf):
    listed = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.length("html").alias("length"), F.sha2("html", 256).alias("sha256"))
    found = listed.where("path % 5 <> 0").withColumn("length", F.col("length") + F.when(F.col("path") % 5 == 1, 1).otherwise(0)).withColumn("sha256", F.when(F.col("path") % 5 == 2, F.lit("")).otherwise(F.col("sha256")))
    return K.inventory(found, listed)


@query("o13_only_allowed", f"WITH {EV} SELECT i FROM ev WHERE (k < 10 OR NOT x) AND active")
def o13(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("k") < 10, "low"), F.when(~F.col("x"), "released"), F.when(~F.col("active"), "inactive")))
    return K.only_allowed(streams(spark, sf).withColumn("r", reasons), "r", ["low", "released"]).select("i")


@query("o14_unique_ids", """WITH p AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders), c AS (SELECT id, count(*) AS n FROM p GROUP BY 1)
SELECT CASE WHEN id = '' THEN 'id not blank' ELSE 'id unique' END AS rule, id AS subject, CAST(n AS VARCHAR) AS detail FROM c WHERE id = '' OR n > 1""")
def o14(spark, sf):
    return K.unique_ids(table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).otherwise(F.lit(" ")).alias("id")), "id")


@query("o15_order_problems", f"WITH {EV}, m AS (SELECT *, max(k) OVER (PARTITION BY s, x ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev) SELECT s, x, pos FROM m WHERE k < b")
def o15(spark, sf):
    return K.sequence_problems(streams(spark, sf), ["s", "x"], "pos", "k")
