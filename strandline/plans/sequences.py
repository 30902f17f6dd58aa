"""Queries over runs, transitions and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as S
from .base import EV, HELD, RUNS, query, streams, table


def _runs(spark, sf):
    return S.contiguous_runs(streams(spark, sf), ["s"], "pos", "g")


def _held(spark, sf):
    return S.flag_runs(streams(spark, sf), ["s"], "pos", "x")


@query("f01_contiguous_runs", f"WITH {EV}, {RUNS} SELECT s, run_id, min(g) AS first_g, count(*) AS n FROM ru GROUP BY s, run_id")
def f01(spark, sf):
    return _runs(spark, sf).groupBy("s", "run_id").agg(F.min("g").alias("first_g"), F.count("*").alias("n"))


@query("f02_continuity_runs", f"""WITH {EV}, b AS (SELECT *, CASE WHEN g - lag(g) OVER w = 1 AND key IS NOT DISTINCT FROM lag(key) OVER w THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)),
r AS (SELECT s, sum(b) OVER (PARTITION BY s ORDER BY pos) AS run_id FROM b) SELECT s, CAST(run_id AS BIGINT) AS run_id, count(*) AS n FROM r GROUP BY 1, 2""")
def f02(spark, sf):
    return S.contiguous_runs(streams(spark, sf), ["s"], "pos", "g", ["key"]).groupBy("s", "run_id").agg(F.count("*").alias("n"))


@query("f03_active_runs", f"""WITH {EV}, b AS (SELECT *, CASE WHEN g - lag(g) OVER w = 1 AND active AND lag(active) OVER w THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)),
r AS (SELECT *, sum(b) OVER (PARTITION BY s ORDER BY pos) AS run_id FROM b) SELECT s, CAST(run_id AS BIGINT) AS run_id, count(*) AS n FROM r WHERE active GROUP BY 1, 2""")
def f03(spark, sf):
    return S.active_runs(streams(spark, sf), ["s"], "pos", "g", "active").groupBy("s", "run_id").agg(F.count("*").alias("n"))


@query("f04_true_runs", f'WITH {EV}, {HELD} SELECT s, a AS "start", b AS "end" FROM held')
def f04(spark, sf):
    return _held(spark, sf)


@query("f04b_false_runs", f'WITH {EV}, q AS (SELECT s, pos, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS q FROM ev WHERE NOT x) SELECT s, min(pos) AS "start", max(pos) + 1 AS "end" FROM q GROUP BY s, q')
def f04b(spark, sf):
    return S.flag_runs(streams(spark, sf), ["s"], "pos", "x", False)


@query("f05_blocks", f"WITH {EV}, {RUNS}, n AS (SELECT s, run_id, (row_number() OVER (PARTITION BY s, run_id ORDER BY pos) - 1) // 4 AS block_id FROM ru) SELECT s, run_id, block_id, count(*) AS n FROM n GROUP BY ALL")
def f05(spark, sf):
    return S.blocks(_runs(spark, sf), ["s", "run_id"], "pos", 4).groupBy("s", "run_id", "block_id").agg(F.count("*").alias("n"))


@query("f06_transitions", f"""WITH {EV}, t AS (SELECT s, pos, x, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev)
SELECT s, pos, CASE WHEN x THEN 'onset' ELSE 'release' END AS kind FROM t WHERE x <> b""")
def f06(spark, sf):
    return S.transitions(streams(spark, sf), ["s"], "pos", "x")


@query("f07_valid_transitions", f"""WITH {EV}, t AS (SELECT s, pos, x, lag(x) OVER w AS b, g - lag(g) OVER w = 1 AND active AND lag(active) OVER w AS ok FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos))
SELECT s, pos, CASE WHEN x THEN 'onset' ELSE 'release' END AS kind FROM t WHERE ok AND x <> b""")
def f07(spark, sf):
    return S.valid_transitions(streams(spark, sf), ["s"], "pos", "g", "x", "active")


@query("f08_transition_targets", f"""WITH {EV}, t AS (SELECT s, pos, x, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN s % 2 = 0 THEN true END ELSE lag(x) OVER w END AS b FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos))
SELECT s, pos, b IS NOT NULL AS known, coalesce(x AND NOT b, false) AS onset, coalesce(NOT x AND b, false) AS release FROM t""")
def f08(spark, sf):
    df = streams(spark, sf).withColumn("carry", F.when(F.col("s") % 2 == 0, F.lit(True)))
    return S.transition_targets(df, ["s"], "pos", "x", "carry").select("s", "pos", "known", "onset", "release")


@query("f09_readable_alignment", f"""WITH {EV}, d AS (SELECT s, pos, CASE WHEN key <> 'view' THEN g END AS d FROM ev),
t AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN d IS NOT NULL THEN pos END) OVER (PARTITION BY s) AS f, max(CASE WHEN d IS NOT NULL THEN pos END) OVER (PARTITION BY s) AS l FROM d)
SELECT s, pos, CASE WHEN d IS NOT NULL THEN 'ok' WHEN f IS NULL OR pos < f OR pos > l THEN 'out_of_session' ELSE 'unreadable' END AS decode_status, coalesce(d = b, false) AS is_duplicate, CASE WHEN d - b - 1 > 0 THEN d - b - 1 ELSE 0 END AS preceded_by_drop_count FROM t""")
def f09(spark, sf):
    """With f10: duplicates and drops against the previous readable row, and the status of each row."""
    df = streams(spark, sf).withColumn("d", F.when(F.col("key") != "view", F.col("g")))
    return S.readable_alignment(df, ["s"], "pos", "d").select("s", "pos", "decode_status", "is_duplicate", "preceded_by_drop_count")


@query("f10_session_bounds", f"""WITH {EV} SELECT s, min(CASE WHEN key <> 'view' THEN pos END) AS first_ok, max(CASE WHEN key <> 'view' THEN pos END) AS last_ok, count(*) AS n FROM ev GROUP BY s""")
def f10(spark, sf):
    ok = F.when(F.col("key") != "view", F.col("pos"))
    return streams(spark, sf).groupBy("s").agg(F.min(ok).alias("first_ok"), F.max(ok).alias("last_ok"), F.count("*").alias("n"))


@query("f11_persistence", f"WITH {EV} SELECT s, pos, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS persisted FROM ev")
def f11(spark, sf):
    return S.persistence(streams(spark, sf), ["s"], "pos", "x").select("s", "pos", "persisted")


@query("f12_jitter", " UNION ALL ".join(f"SELECT {k} AS shift, count(*) AS n, CAST(sum(CASE WHEN x = b THEN 1 ELSE 0 END) AS BIGINT) AS agree FROM (WITH {EV} SELECT x, lag(x, {k}) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev) WHERE b IS NOT NULL" for k in (1, 2, 4)).replace("SELECT 1 AS", "SELECT CAST(1 AS BIGINT) AS").replace("SELECT 2 AS", "SELECT CAST(2 AS BIGINT) AS").replace("SELECT 4 AS", "SELECT CAST(4 AS BIGINT) AS"))
def f12(spark, sf):
    return S.jitter_agreement(streams(spark, sf), ["s"], "pos", "x", [1, 2, 4])


@query("f13_window_starts", f"""WITH {EV}, {RUNS}, n AS (SELECT s, run_id, pos, row_number() OVER w - 1 AS rp, count(*) OVER (PARTITION BY s, run_id) AS rl, lead(pos, 1) OVER w AS t FROM ru WINDOW w AS (PARTITION BY s, run_id ORDER BY pos))
SELECT s, run_id, pos AS "start", t AS target FROM n WHERE rp + 3 <= rl AND rp % 2 = 0""")
def f13(spark, sf):
    return S.window_starts(_runs(spark, sf), ["s", "run_id"], "pos", 3, 2)


@query("f14_segments", f"""WITH {EV}, st AS (SELECT s, pos FROM ev WHERE active), i AS (SELECT s, pos, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS q FROM st),
n AS (SELECT *, (row_number() OVER (PARTITION BY s, q ORDER BY pos) - 1) // 3 AS k FROM i) SELECT s, min(pos) AS "first", max(pos) AS "last" FROM n GROUP BY s, q, k HAVING count(*) = 3""")
def f14(spark, sf):
    return S.segments(streams(spark, sf).where("active").select("s", "pos"), ["s"], "pos", 3)


@query("f15_history", f"""WITH {EV}, h AS (SELECT s, pos, list(k) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS h FROM ev)
SELECT s, pos, array_to_string(CASE len(coalesce(h, [])) WHEN 0 THEN [-1, -1, -1, -1] WHEN 1 THEN [-1, -1, -1] || h WHEN 2 THEN [-1, -1] || h WHEN 3 THEN [-1] || h ELSE h END, ',') AS history FROM h""")
def f15(spark, sf):
    df = S.history(streams(spark, sf), ["s"], "pos", "k", 4, 1, F.lit(-1).cast("long"))
    return df.select("s", "pos", F.array_join("history", ",").alias("history"))


TAILED = "wn AS (SELECT s, a, b, unnest(list_distinct(list_concat(range(a, b - 2 + 1, 3), [b - 2]))) AS w FROM held WHERE b - a >= 2)"


@query("f16_tailed_windows", f'WITH {EV}, {HELD}, {TAILED} SELECT s, a AS "start", b AS "end", w AS window_start FROM wn')
def f16(spark, sf):
    return S.tailed_windows(_held(spark, sf), "start", "end", 2, 3)


@query("f17_first_wins", f"WITH {EV} SELECT s, g, k FROM (SELECT *, row_number() OVER (PARTITION BY s, g ORDER BY pos) AS r FROM ev) WHERE r = 1")
def f17(spark, sf):
    return S.first_wins(streams(spark, sf), ["s", "g"], ["pos"]).select("s", "g", "k")


@query("f18_decimate", f"WITH {EV}, {RUNS} SELECT s, pos FROM (SELECT *, row_number() OVER (PARTITION BY s, run_id ORDER BY pos) - 1 AS rp FROM ru) WHERE rp % 3 = 1")
def f18(spark, sf):
    return S.decimate(_runs(spark, sf), ["s", "run_id"], "pos", 3, 1).select("s", "pos")


@query("f19_decimation_loss", f"""WITH {EV}, {HELD}, k AS (SELECT ph, (SELECT count(*) FROM range(a, b) AS r(z) WHERE z % 3 = ph) AS kept FROM held, range(3) AS t(ph))
SELECT ph AS phase, count(*) AS runs, CAST(sum(CASE WHEN kept = 0 THEN 1 ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN kept = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single FROM k GROUP BY ph""")
def f19(spark, sf):
    return S.decimation_loss(_held(spark, sf), "start", "end", 3)


F20_SQL = f"""WITH RECURSIVE {EV}, e AS (SELECT s, pos, p, ((i * 37) % 100) / 100.0 AS o, ((i * 53) % 100) / 100.0 AS r FROM ev),
l(s, pos, held, n) AS (SELECT s, pos, p >= 0.5, 0 FROM e WHERE pos = 1 UNION ALL
SELECT s, pos, CASE WHEN c >= 3 THEN p >= 0.9 ELSE h END, CASE WHEN c >= 3 THEN 0 ELSE c END FROM (SELECT s, pos, p, h, CASE WHEN NOT ev AND ((NOT h AND p >= 0.9) OR (h AND p <= 0.1)) THEN n + 1 ELSE 0 END AS c FROM
(SELECT e.s, e.pos, e.p, l.n, (NOT l.held AND e.o >= 0.8) OR (l.held AND e.r >= 0.8) AS ev, CASE WHEN (NOT l.held AND e.o >= 0.8) OR (l.held AND e.r >= 0.8) THEN NOT l.held ELSE l.held END AS h FROM l JOIN e ON e.s = l.s AND e.pos = l.pos + 1)))
SELECT s, pos, held FROM l"""


@query("f20_latch", F20_SQL)
def f20(spark, sf):
    return S.latch(_signals(spark, sf), ["s"], "pos", "p", "o", "r", on=0.8, off=0.8)


def _signals(spark, sf):
    return streams(spark, sf).withColumn("o", ((F.col("i") * 37) % 100) / 100).withColumn("r", ((F.col("i") * 53) % 100) / 100)


@query("f20b_split_latch", F20_SQL)
def f20b(spark, sf):
    return S.split_latch(_signals(spark, sf), ["s"], "pos", "p", "o", "r", on=0.8, off=0.8).select("s", "pos", "held")


@query("k03_carried_latch", F20_SQL)
def k03(spark, sf):
    """Three segments of every stream, each from the states at the end of the one before."""
    df = _signals(spark, sf)
    out, carry = None, None
    for low, high in ((0, 20), (20, 45), (45, None)):
        segment = df.where((F.col("pos") > low) & (F.lit(True) if high is None else F.col("pos") <= high))
        latched = S.split_latch(segment, ["s"], "pos", "p", "o", "r", on=0.8, off=0.8, carry=carry)
        out = latched if out is None else out.unionByName(latched)
        ended = S.carried_states(latched, ["s"], "pos")
        # A stream without a row in this segment keeps the state it had.
        carry = ended if carry is None else ended.unionByName(carry.join(ended, "s", "left_anti"))
    return out.select("s", "pos", "held")


@query("f21_bridged", f"""WITH {EV}, {HELD}, j AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY s ORDER BY a) <= 1 THEN 0 ELSE 1 END AS n FROM held), q AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY a) AS q FROM j)
SELECT s, min(a) AS "start", max(b) AS "end" FROM q GROUP BY s, q HAVING max(b) - min(a) >= 3""")
def f21(spark, sf):
    return S.bridged(streams(spark, sf), ["s"], "pos", "x", 1, 3)


@query("f22_present_twice", f"WITH {EV} SELECT s, count(*) FILTER (WHERE v) AS valid_rows FROM (SELECT s, active AND lag(active, 1, false) OVER (PARTITION BY s ORDER BY pos) AS v FROM ev) GROUP BY s")
def f22(spark, sf):
    return S.present_twice(streams(spark, sf), ["s"], "pos", "active").groupBy("s").agg(F.count(F.when(F.col("valid"), 1)).alias("valid_rows"))


@query("f23_repeats", f"""WITH {EV}, d AS (SELECT s, pos, k % 4 AS d FROM ev), i AS (SELECT s, pos - row_number() OVER (PARTITION BY s ORDER BY pos) AS q FROM d WHERE d = 0), l AS (SELECT s, max(c) AS longest FROM (SELECT s, count(*) AS c FROM i GROUP BY s, q) GROUP BY s)
SELECT d.s, CAST(coalesce(max(longest), 0) AS BIGINT) AS longest, CAST(sum(CASE WHEN d > 0 AND d <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS near_rows FROM d LEFT JOIN l ON d.s = l.s GROUP BY d.s""")
def f23(spark, sf):
    return S.repeats(streams(spark, sf).withColumn("d", F.col("k") % 4), ["s"], "pos", "d", 1)


@query("f24_merged_chunks", f"""WITH {EV}, c AS (SELECT DISTINCT s, g FROM ev), b AS (SELECT *, CASE WHEN g - lag(g) OVER w = 1 AND (g % 5 < 4) = ((lag(g) OVER w) % 5 < 4) THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY s ORDER BY g)), r AS (SELECT *, sum(b) OVER (PARTITION BY s ORDER BY g) AS r FROM b)
SELECT s, min(g) AS "first", max(g) AS "last", count(*) AS n FROM r GROUP BY s, r""")
def f24(spark, sf):
    chunks = streams(spark, sf).select("s", "g").distinct().withColumn("rate", F.col("g") % 5 < 4)
    return S.merged_chunks(chunks, ["s"], "g", "rate")


@query("f25_gated_windows", f"""WITH {EV}, w AS (SELECT s, pos, count(*) OVER w AS n, sum(CASE WHEN k < 90 THEN 1 ELSE 0 END) OVER w AS c, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER w AS a FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT s, pos AS "start", CAST(a AS BIGINT) AS n_active FROM w WHERE n = 4 AND c = 4 AND a >= 3 AND pos % 2 = 0""")
def f25(spark, sf):
    return S.gated_windows(streams(spark, sf).withColumn("c", F.col("k") < 90), ["s"], "pos", "c", "active", 4, 2, 3)


@query("f26_lag_energy", f"""WITH {EV}, e AS (SELECT s, pos FROM ev WHERE key = 'click'), l AS (SELECT e.s, e.pos, CAST(t.lag AS BIGINT) AS lag FROM e, (VALUES (-2), (-1), (0), (1)) AS t(lag)),
j AS (SELECT l.lag, ev.k FROM l LEFT JOIN ev ON ev.s = l.s AND ev.pos = l.pos + l.lag) SELECT lag, count(*) AS n, round(avg(k), 6) AS energy FROM j GROUP BY lag HAVING count(*) = count(k)""")
def f26(spark, sf):
    df = streams(spark, sf)
    return S.lag_energy(df.where("key = 'click'"), df, ["s"], "pos", "k", [-2, -1, 0, 1]).withColumn("energy", F.round("energy", 6))


@query("f29_eligible_anchors", f"WITH {EV}, {RUNS} SELECT CAST(sum(greatest(n - 2, 0)) AS BIGINT) AS anchors FROM (SELECT count(*) AS n FROM ru GROUP BY s, run_id)")
def f29(spark, sf):
    return S.eligible_anchors(_runs(spark, sf).groupBy("s", "run_id").agg(F.count("*").alias("n")), "n", 1)


@query("f30_dense_violations", """WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS e FROM orders),
m AS (SELECT o_custkey, min(o_orderkey) AS "at" FROM t WHERE r <> e GROUP BY o_custkey) SELECT m.o_custkey, m."at", t.r AS found FROM m JOIN t ON m."at" = t.o_orderkey""")
def f30(spark, sf):
    """The first order of a customer whose place by date isn't its place by number."""
    dated = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return S.dense_violations(table(spark, sf, "orders").withColumn("idx", dated.cast("long")), ["o_custkey"], "o_orderkey", "idx", 1)


@query("f31_change_weights", f"WITH {EV} SELECT s, pos, CAST(CASE WHEN x <> lag(x) OVER (PARTITION BY s ORDER BY pos) THEN 5 ELSE 1 END AS DOUBLE) AS weight FROM ev")
def f31(spark, sf):
    return S.change_weights(streams(spark, sf), ["s"], "pos", "x", 5.0).select("s", "pos", "weight")


@query("f33_horizon_pairs", f"""WITH {EV}, {RUNS}, pr AS (SELECT a.s, a.run_id, a.pos, CAST(h AS BIGINT) AS horizon, abs(b.k - a.k) AS change FROM ru a, (VALUES (1), (2)) AS t(h), ru b WHERE b.s = a.s AND b.run_id = a.run_id AND b.pos = a.pos + h)
SELECT s, run_id, pos, horizon, change, change > (SELECT median(change) FROM pr) AS moving FROM pr""")
def f33(spark, sf):
    return S.horizon_pairs(_runs(spark, sf), ["s", "run_id"], "pos", "k", [1, 2])


@query("f34_missing_tails", f"WITH {EV}, {HELD} SELECT s, b - 2 AS window_start FROM held WHERE b - a >= 2 AND (b - a - 2) % 3 <> 0")
def f34(spark, sf):
    runs = _held(spark, sf)
    existing = runs.where("end - start >= 2").select("s", F.explode(F.sequence(F.col("start"), F.col("end") - 2, F.lit(3).cast("long"))).alias("window_start"))
    return S.missing_tails(runs, existing, ["s"], "start", "end", 2)


@query("f35_vector_change", """WITH w AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, vec_id, round(coalesce(list_sum(list_transform(list_zip(e, b), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(e), 0), 6) AS change FROM w""")
def f35(spark, sf):
    return S.vector_change(table(spark, sf, "embeddings"), ["label"], "vec_id", "embedding").select("label", "vec_id", F.round("change", 6).alias("change"))


@query("f36_order_check", f"WITH {EV}, w AS (SELECT s, g, lag(g) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev) SELECT s, count(*) AS n, count(*) FILTER (WHERE g < b) AS decreasing, count(*) FILTER (WHERE g = b) AS equal FROM w GROUP BY s")
def f36(spark, sf):
    return S.order_check(streams(spark, sf), ["s"], "pos", "g")


@query("f28_balanced_offsets", f"""WITH {EV}, t AS (SELECT s, pos, CASE WHEN x THEN 'onset' ELSE 'release' END AS head FROM (SELECT s, pos, x, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev) WHERE x <> b),
a AS (SELECT *, count(*) OVER (PARTITION BY s, head ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c FROM t),
z AS (SELECT a.s, a.pos, a.head, sha256('o' || chr(0) || a.pos) AS h FROM a WHERE c = 1 AND 5 = (SELECT count(*) FROM ev e WHERE e.s = a.s AND e.pos BETWEEN a.pos - 2 AND a.pos + 2 AND e.pos // 50 = a.pos // 50 AND e.active)),
o AS (SELECT s, head, o, row_number() OVER (PARTITION BY s, head ORDER BY sha256('o' || chr(0) || concat_ws(':', s, head, o))) - 1 AS turn FROM (SELECT DISTINCT s, head FROM t), (SELECT unnest([0, 1]::BIGINT[]) AS o)),
r AS (SELECT *, (row_number() OVER (PARTITION BY s, head ORDER BY h, pos) - 1) % 2 AS turn FROM z) SELECT s, pos, head, o AS "offset", pos - o - 1 AS crop_start FROM r JOIN o USING (s, head, turn)""")
def f28(spark, sf):
    """Onsets and releases in windows of two rows with a halo of one; runs break every 50 rows."""
    df = streams(spark, sf).withColumn("run", F.floor(F.col("pos") / 50))
    events = S.transitions(df, ["s"], "pos", "x").select("s", "pos", F.col("kind").alias("head"))
    return S.balanced_offsets(df, events, ["s"], "run", "pos", "active", "head", 2, 1, "o")
