"""Queries over inventories: reuse, acceptance, totals, tiers and manifest-bound windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as V
from .base import EV, query, streams, table


@query("b06_reusable", """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus || '*' ELSE o_orderstatus END AS a, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS b FROM orders WHERE o_custkey % 5 <> 0)
SELECT o_orderkey AS k, EXISTS (FROM d WHERE d.k = o_orderkey AND d.a = o_orderstatus AND d.b = o_orderpriority) AS reuse FROM orders""")
def b06(spark, sf):
    """Orders as parts bound to status and priority; a third is finished under another status, some without a priority, some not."""
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_custkey").alias("c"))
    done = df.where("c % 5 <> 0").select("k", F.when(F.col("c") % 3 == 0, F.concat("a", F.lit("*"))).otherwise(F.col("a")).alias("a"), F.when(F.col("c") % 7 != 0, F.col("b")).alias("b"))
    return V.reusable(df.drop("c"), done, ["k"], ["a", "b"]).select("k", "reuse")


@query("o10_acceptance_chain", "SELECT o_orderkey AS k, CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'review' WHEN o_custkey % 5 = 0 THEN 'accept' END AS broken_at FROM orders")
def o10(spark, sf):
    """Orders scanned, reviewed and accepted: some reviews are missing or bind another hash, some acceptances occur twice."""
    sha = lambda name: F.sha2(F.concat(F.lit(name), F.col("k").cast("string")), 256)
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    scan = k.select("k", sha("scan").alias("sha"), F.lit(None).cast("string").alias("binds"))
    review = k.where("c % 4 <> 0").select("k", sha("review").alias("sha"), F.when(F.col("k") % 3 != 0, sha("scan")).otherwise(sha("other")).alias("binds"))
    accept = k.select("k", sha("accept").alias("sha"), sha("review").alias("binds"), F.explode(F.when(F.col("c") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")
    return V.acceptance_chain([("scan", scan), ("review", review), ("accept", accept)], ["k"], "sha", "binds")


@query("o12_totals", """WITH f AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, 4 AS n, o_custkey % 100 AS q FROM orders),
j AS (SELECT coalesce(d.k, f.k) AS k, d.n AS dn, f.n AS fn, d.q AS dq, f.q AS fq FROM d FULL JOIN f USING (k)) SELECT k, 'n' AS measure, CAST(dn AS BIGINT) AS declared, fn AS found FROM j WHERE dn IS DISTINCT FROM fn UNION ALL SELECT k, 'q', dq, fq FROM j WHERE dq IS DISTINCT FROM fq""")
def o12(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    stated = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("n"), (F.col("o_custkey") % 100).alias("q"))
    return V.totals(rows, stated, ["k"], {"n": F.count("*"), "q": F.sum("l_quantity")})


@query("j16_tier_inventories", "SELECT CASE WHEN c_nationkey % 3 = 0 THEN 'small' ELSE 'large' END AS tier, count(*) AS n, count(DISTINCT c_nationkey) AS keys FROM customer GROUP BY 1")
def j16(spark, sf):
    tiers = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 3 == 0, "small").otherwise("large").alias("tier"))
    return V.tier_inventories(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), tiers, ["c_nationkey"], "tier").groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("keys"))


@query("a13_manifest_windows", f"""WITH {EV}, w AS (SELECT i AS win, s, pos AS a FROM ev WHERE key = 'error'), n AS (SELECT s, max(pos) AS n FROM ev GROUP BY 1)
SELECT win, CAST(ev.pos - a AS INT) AS slot, ev.i FROM w JOIN n USING (s) JOIN ev ON ev.s = w.s AND ev.pos BETWEEN a AND a + 4 WHERE a + 4 <= n""")
def a13(spark, sf):
    """Windows of five rows from each error on; those that pass a stream's end are left out."""
    df = streams(spark, sf).select("s", "pos", "i", "key")
    manifest = df.where("key = 'error'").select(F.col("i").alias("win"), "s", F.col("pos").alias("a"), F.lit(5).alias("n"))
    return V.manifest_windows(df, manifest, ["s"], "pos", "a", "n", "win").select("win", "slot", "i")


FILES = "fi AS (SELECT doc_id, sha256(text) AS sha, source, lang, n_chars FROM documents)"


def _files(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "source", "lang", "n_chars")


@query("o12b_link_groups", f"WITH {FILES} SELECT doc_id, min(doc_id) OVER (PARTITION BY sha) AS first, count(*) OVER (PARTITION BY sha) AS files FROM fi")
def o12b(spark, sf):
    return V.link_groups(_files(spark, sf), "doc_id", "sha")


@query("o12c_link_problems", f"""WITH {FILES}, t AS (SELECT lang, n_chars, min(doc_id) AS target FROM fi GROUP BY ALL), l AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN -doc_id - 1 ELSE target END AS target FROM fi JOIN t USING (lang, n_chars) UNION ALL SELECT -doc_id - 1, doc_id FROM fi WHERE doc_id % 40 = 3),
j AS (SELECT l.doc_id, l.target, CASE WHEN a.sha IS NULL THEN 'no file' WHEN b.sha IS NULL THEN 'no target' WHEN a.sha <> b.sha THEN 'other content' END AS problem FROM l LEFT JOIN fi a ON a.doc_id = l.doc_id LEFT JOIN fi b ON b.doc_id = l.target)
SELECT * FROM j WHERE problem IS NOT NULL""")
def o12c(spark, sf):
    """Documents as links to the first of the same language and length; some targets and some files don't exist."""
    files = _files(spark, sf)
    targets = files.groupBy("lang", "n_chars").agg(F.min("doc_id").alias("target"))
    links = files.join(targets, ["lang", "n_chars"]).select("doc_id", F.when(F.col("doc_id") % 50 == 7, -F.col("doc_id") - 1).otherwise(F.col("target")).alias("target"))
    links = links.unionByName(files.where("doc_id % 40 = 3").select((-F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("target")))
    return V.link_problems(links, files, "doc_id", "target", "sha")


@query("o12d_list_problems", f"""WITH {FILES}, m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'held' ELSE 'train' END AS list FROM fi),
l AS (SELECT list, doc_id FROM m WHERE doc_id % 17 <> 4 UNION ALL SELECT list, doc_id FROM m WHERE doc_id % 19 = 2 UNION ALL SELECT 'held', doc_id FROM m WHERE doc_id % 23 = 1 AND list = 'train' UNION ALL SELECT 'train', -doc_id - 1 FROM m WHERE doc_id % 29 = 5),
o AS (SELECT list, doc_id, count(*) AS n FROM l GROUP BY ALL), b AS (SELECT coalesce(o.list, m.list) AS list, doc_id, n, o.list AS here, m.list AS stated FROM o FULL JOIN m USING (doc_id)),
c AS (SELECT o.list, doc_id, sha FROM o JOIN fi USING (doc_id)), s AS (SELECT sha FROM c GROUP BY sha HAVING count(DISTINCT list) > 1)
SELECT list, doc_id, 'listed twice' AS problem FROM b WHERE n > 1 UNION ALL SELECT list, doc_id, 'not in the manifest' FROM b WHERE stated IS NULL UNION ALL SELECT list, doc_id, 'not listed' FROM b WHERE here IS NULL
UNION ALL SELECT list, doc_id, 'in another list' FROM b WHERE here <> stated UNION ALL SELECT list, doc_id, 'content in another list' FROM c JOIN s USING (sha)""")
def o12d(spark, sf):
    """A split of the documents into lists, some of which lack, repeat, move or invent an id."""
    files = _files(spark, sf)
    manifest = files.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "held").otherwise("train").alias("list"))
    listed = manifest.where("doc_id % 17 <> 4").unionByName(manifest.where("doc_id % 19 = 2"))
    listed = listed.unionByName(manifest.where("doc_id % 23 = 1 AND list = 'train'").withColumn("list", F.lit("held")))
    listed = listed.unionByName(manifest.where("doc_id % 29 = 5").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("train").alias("list")))
    return V.list_problems(listed, manifest, files, "list", "doc_id", "sha")
