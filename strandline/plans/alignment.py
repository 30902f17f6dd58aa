"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import boxes as B
from ..operators import sequence as S
from .base import EV, RUNS, query, streams, table

ONSETS = """tr AS (SELECT s, pos, x AND NOT lag(x, 1, false) OVER w AS ot, (k >= 50) AND NOT lag(k >= 50, 1, false) OVER w AS op FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)),
ton AS (SELECT s, pos FROM tr WHERE ot), pon AS (SELECT s, pos FROM tr WHERE op)"""


def _onsets(spark, sf):
    df = streams(spark, sf).withColumn("xp", F.col("k") >= 50)
    return tuple(S.transitions(df, ["s"], "pos", c).where("kind = 'onset'").select("s", "pos") for c in ("x", "xp"))


#: Rows of the longer side of a join that a task sorts.
TASK_ROWS = 1_000_000


@query("d01_equi_join", "SELECT o_orderkey, l_linenumber, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def d01(spark, sf):
    """Dealt in as many parts as the rows need, so that a task's memory doesn't grow with the tables."""
    orders, lines = table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    parts = -(-lines.count() // TASK_ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        orders, lines = orders.repartition(parts, "o_orderkey"), lines.repartition(parts, "l_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("d02_matched_rows", """SELECT count(d.doc_id) AS n_left, count(l.doc_id) AS n_right, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_matched,
count(d.doc_id) + count(l.doc_id) - 2 * count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS n_unmatched FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def d02(spark, sf):
    return A.matched_rows(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("d03_shift_sweep", f"""WITH {EV} SELECT CAST(h AS BIGINT) AS shift, count(*) AS n, CAST(sum(CASE WHEN a.x = (b.k >= 50) THEN 1 ELSE 0 END) AS BIGINT) AS agree
FROM ev a, range(-3, 4) AS t(h), ev b WHERE b.s = a.s AND b.pos = a.pos + h GROUP BY h""")
def d03(spark, sf):
    df = streams(spark, sf).withColumn("xp", F.col("k") >= 50)
    return A.shift_sweep(df, df, ["s"], "pos", "x", "xp", 3)


@query("d04_dimension_lookup", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def d04(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@query("d05_on_support", f"WITH {EV} SELECT a.s, a.pos, a.k <> b.k AS conflict FROM ev a JOIN (SELECT s, pos, CASE WHEN pos % 10 = 0 THEN k + 1 ELSE k END AS k FROM ev WHERE active) b ON a.s = b.s AND a.pos = b.pos")
def d05(spark, sf):
    df = streams(spark, sf)
    ref = df.where("active").withColumn("k", F.when(F.col("pos") % 10 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return A.on_support(df, ref, ["s", "pos"], "k").select("s", "pos", "conflict")


@query("d06_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def d06(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("d07_nearest_event", f"""WITH {EV}, {ONSETS}, c AS (SELECT t.s, t.pos, p.pos - t.pos AS d, row_number() OVER (PARTITION BY t.s, t.pos ORDER BY abs(p.pos - t.pos), p.pos) AS r FROM ton t JOIN pon p ON t.s = p.s)
SELECT s, pos, d AS "offset" FROM c WHERE r = 1 AND abs(d) <= 3""")
def d07(spark, sf):
    return A.nearest_event(*_onsets(spark, sf), ["s"], "pos", 3)


@query("d08_nearest_in_reach", f"""WITH {EV}, {ONSETS}, c AS (SELECT t.s, t.pos, p.pos - t.pos AS d, row_number() OVER (PARTITION BY t.s, t.pos ORDER BY abs(p.pos - t.pos), p.pos) AS r FROM ton t JOIN pon p ON t.s = p.s AND abs(p.pos - t.pos) <= 2)
SELECT s, pos, d AS "offset" FROM c WHERE r = 1""")
def d08(spark, sf):
    return A.nearest_in_reach(*_onsets(spark, sf), ["s"], "pos", 2)


@query("d09_matched_events", f"""WITH {EV}, {ONSETS}, t AS (SELECT s, count(*) AS n FROM ton GROUP BY s), p AS (SELECT s, count(*) AS n FROM pon GROUP BY s), m AS (SELECT s, count(*) AS n FROM ton JOIN pon USING (s, pos) GROUP BY s)
SELECT s, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(m.n, 0) AS n_matched FROM t FULL JOIN p USING (s) LEFT JOIN m USING (s)""")
def d09(spark, sf):
    return A.matched_events(*_onsets(spark, sf), ["s"], "pos", 0)


@query("d09b_matched_events_collar", f"""WITH RECURSIVE {EV}, {ONSETS}, t AS (SELECT s, pos, row_number() OVER (PARTITION BY s ORDER BY pos) AS i FROM ton), p AS (SELECT s, pos, row_number() OVER (PARTITION BY s ORDER BY pos) AS j FROM pon),
z AS (SELECT s, count(*) FILTER (WHERE ot) AS n_true, count(*) FILTER (WHERE op) AS n_pred FROM tr GROUP BY s),
g(s, i, j, m) AS (SELECT s, CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM z UNION ALL
SELECT g.s, CASE WHEN p.pos - t.pos >= -1 THEN g.i + 1 ELSE g.i END, CASE WHEN p.pos - t.pos <= 1 THEN g.j + 1 ELSE g.j END, CASE WHEN abs(p.pos - t.pos) <= 1 THEN g.m + 1 ELSE g.m END FROM g JOIN t ON t.s = g.s AND t.i = g.i JOIN p ON p.s = g.s AND p.j = g.j)
SELECT s, n_true, n_pred, (SELECT max(m) FROM g WHERE g.s = z.s) AS n_matched FROM z WHERE n_true + n_pred > 0""")
def d09b(spark, sf):
    return A.matched_events(*_onsets(spark, sf), ["s"], "pos", 1)


@query("d10_close_states", f"""WITH {EV} SELECT a.s, a.pos, bool_or(a.x <> b.x) AS ambiguous FROM ev a JOIN ev b ON a.s = b.s AND abs(a.pos - b.pos) >= 2 AND (a.k - b.k) * (a.k - b.k) + (a.v - b.v) * (a.v - b.v) <= 64.0 GROUP BY a.s, a.pos""")
def d10(spark, sf):
    return A.close_states(streams(spark, sf), ["s"], "k", "v", "pos", "x", 8.0, 2)


@query("d11_future_values", f"WITH {EV}, u AS (SELECT s, g, min(k) AS k FROM ev GROUP BY s, g) SELECT a.s, a.g, CAST(h AS BIGINT) AS horizon, b.k AS later FROM u a, (VALUES (1), (3)) AS t(h), u b WHERE b.s = a.s AND b.g = a.g + h")
def d11(spark, sf):
    return A.future_values(streams(spark, sf).groupBy("s", "g").agg(F.min("k").alias("k")), ["s"], "g", "k", [1, 3])


HELD_IV = "hg AS (SELECT s, pos, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS q FROM ev WHERE k >= 60), iv AS (SELECT s, min(pos) AS a, max(pos) + 1 AS b FROM hg GROUP BY s, q)"


@query("d12_in_intervals", f"WITH {EV}, {HELD_IV} SELECT s, pos, EXISTS (SELECT 1 FROM iv WHERE iv.s = ev.s AND ev.pos >= a AND ev.pos < b) AS inside FROM ev")
def d12(spark, sf):
    df = streams(spark, sf).withColumn("h", F.col("k") >= 60)
    return A.in_intervals(df.select("s", "pos"), S.flag_runs(df, ["s"], "pos", "h"), ["s"], "pos", "start", "end", 16)


@query("d13_offset_pairs", f"""WITH {EV}, {RUNS}, e AS (SELECT a.s, a.run_id, a.pos FROM ru a JOIN ru b ON a.s = b.s AND a.run_id = b.run_id AND b.pos = a.pos - 1)
SELECT a.s, a.run_id, a.pos AS target, b.pos AS observed FROM e a JOIN e b ON a.s = b.s AND a.run_id = b.run_id AND b.pos = a.pos + 1""")
def d13(spark, sf):
    return A.offset_pairs(S.contiguous_runs(streams(spark, sf), ["s"], "pos", "g"), ["s", "run_id"], "pos", 1)


@query("d14_common_support", f"""WITH {EV}, w AS (SELECT s, pos, count(*) OVER w AS n, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER w AS o FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) SELECT s, pos FROM w WHERE n = 4 AND o = 0""")
def d14(spark, sf):
    return A.common_support(streams(spark, sf), ["s"], "pos", "active", -2, 1).select("s", "pos")


@query("d15_ranked_references", """WITH r AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT r.vec_id AS cid, a.vec_id AS rid, round(list_sum(list_transform(list_zip(a.embedding, r.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) /
sqrt(list_sum(list_transform(a.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))) * list_sum(list_transform(r.embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))), 6) AS similarity FROM embeddings a, r WHERE a.vec_id <> r.vec_id)
SELECT * FROM (SELECT cid, rid, similarity, row_number() OVER (PARTITION BY cid ORDER BY similarity DESC, rid) AS "rank" FROM p) WHERE "rank" <= 3""")
def d15(spark, sf):
    """The query set is every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, sf, "embeddings")
    return A.ranked_references(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "cid"), e.withColumnRenamed("vec_id", "rid"), "cid", "rid", "embedding", 3)


@query("d16_precedence_merge", """WITH a AS (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS q FROM documents), b AS (SELECT doc_id, quality AS q FROM labels)
SELECT doc_id, coalesce(b.q, a.q) AS q, coalesce(a.q <> b.q, false) AS conflict FROM a FULL JOIN b USING (doc_id)""")
def d16(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("q"))
    return A.precedence_merge(left, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q")), ["doc_id"], "q")


@query("d17_linked_clusters", f"""WITH {EV}, sp AS (SELECT s, pos, pos + k % 3 AS e FROM ev), m AS (SELECT *, max(e) OVER (PARTITION BY s ORDER BY pos, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sp),
n AS (SELECT *, sum(CASE WHEN pos < r THEN 0 ELSE 1 END) OVER (PARTITION BY s ORDER BY pos) AS q FROM m) SELECT s, pos, min(pos) OVER (PARTITION BY s, q) AS cluster FROM n""")
def d17(spark, sf):
    spans = streams(spark, sf).select("s", "pos", (F.col("pos") + F.col("k") % 3).alias("e"))
    return A.linked_clusters(spans, ["s"], "pos", "e").select("s", "pos", "cluster")


#: A box of each order: price against day.
BOXES = """bx AS (SELECT o_custkey % 100 AS p, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS x0, CAST(floor(o_totalprice) AS BIGINT) + 4000 + o_orderkey % 8000 AS x1,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS y0, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 60 + o_orderkey % 150 AS y1 FROM orders),
lk AS (SELECT p, a.id AS a, b.id AS b FROM bx a JOIN bx b USING (p) WHERE a.id < b.id AND a.x0 < b.x1 + 30 AND b.x0 < a.x1 + 30 AND a.y0 < b.y1 + 30 AND b.y0 < a.y1 + 30)"""


def _boxes(spark, sf):
    x, y = F.floor("o_totalprice").cast("long"), F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long")
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("p"), k.alias("id"), x.alias("x0"), (x + 4000 + k % 8000).alias("x1"), y.alias("y0"), (y + 60 + k % 150).alias("y1"))


@query("d17b_overlap_pairs", f"WITH {BOXES} SELECT p, a, b FROM lk")
def d17b(spark, sf):
    return B.overlap_pairs(_boxes(spark, sf), ["p"], "id", "x0", "x1", "y0", "y1", 30, 4000, 120)


@query("d17c_linked_boxes", f"""WITH RECURSIVE {BOXES}, both_ AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
r AS (SELECT id, id AS cluster FROM bx UNION SELECT b, cluster FROM r JOIN both_ ON a = id WHERE cluster < b) SELECT p, id, min(cluster) AS cluster FROM r JOIN bx USING (id) GROUP BY ALL""")
def d17c(spark, sf):
    return B.linked_boxes(_boxes(spark, sf), ["p"], "id", "x0", "x1", "y0", "y1", 30, 600).select("p", "id", "cluster")


@query("d18_intersected", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN greatest(l_quantity, 10) < least(l_quantity + 20, 40) THEN greatest(l_quantity, 10) END AS low, CASE WHEN greatest(l_quantity, 10) < least(l_quantity + 20, 40) THEN least(l_quantity + 20, 40) END AS high FROM lineitem")
def d18(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("a1", F.col("l_quantity") + 20).withColumn("b0", F.lit(10.0)).withColumn("b1", F.lit(40.0))
    return A.intersected(df, ("l_quantity", "a1"), ("b0", "b1")).select("l_orderkey", "l_linenumber", "l_partkey", "low", "high")


@query("d19_shared_keys", "SELECT count(*) AS n_shared FROM (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def d19(spark, sf):
    o = table(spark, sf, "orders")
    return A.shared_keys(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["o_custkey"])


@query("d20_best_assignment", """WITH u AS (SELECT l_returnflag AS role, l_linenumber AS unit, [l_linenumber, l_linenumber % 3] AS m, CAST(count(*) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2)
SELECT a.unit AS unit_A, n.unit AS unit_N, r.unit AS unit_R, a.score + n.score + r.score AS total FROM u a, u n, u r WHERE a.role = 'A' AND n.role = 'N' AND r.role = 'R' AND NOT list_has_any(a.m, n.m) AND NOT list_has_any(list_concat(a.m, n.m), r.m)
ORDER BY total DESC, 1, 2, 3 LIMIT 1""")
def d20(spark, sf):
    """The limit is the feature: the best assignment over a handful of units."""
    units = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("role"), F.col("l_linenumber").alias("unit")).agg(F.count("*").alias("score")).withColumn("m", F.array(F.col("unit"), F.col("unit") % 3))
    return A.best_assignment(units, ["A", "N", "R"], "role", "unit", "m", "score")


@query("d21_agreed_verdicts", """WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS v, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS c FROM labels), b AS (SELECT doc_id, CASE WHEN toxic = 0 THEN 'good' ELSE 'bad' END AS v, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS c FROM labels)
SELECT doc_id, CASE WHEN a.v = b.v THEN a.v ELSE 'unknown' END AS v, CASE WHEN a.v <> b.v OR a.c = 'low' THEN 'low' WHEN b.c = 'medium' THEN 'medium' ELSE 'high' END AS c FROM a JOIN b USING (doc_id)""")
def d21(spark, sf):
    lab = table(spark, sf, "labels")
    a = lab.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("v"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low").alias("c"))
    b = lab.select("doc_id", F.when(F.col("toxic") == 0, "good").otherwise("bad").alias("v"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("medium").alias("c"))
    return A.agreed_verdicts(a, b, ["doc_id"], "v", "c", {"low": 0, "medium": 1, "high": 2})


@query("d22_adjacent_pairs", f"""WITH {EV}, n AS (SELECT s, pos AS a, lead(pos) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev) SELECT s, a, b FROM n WHERE b IS NOT NULL UNION SELECT s, min(pos), max(pos) FROM ev GROUP BY s HAVING min(pos) < max(pos)""")
def d22(spark, sf):
    return A.adjacent_pairs(streams(spark, sf), ["s"], "pos")
