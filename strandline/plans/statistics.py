"""Queries over thresholds, calibration, resampling and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import sequence as S
from ..operators import stats as T
from .base import EV, HELD, RUNS, query, streams, table
from .scores import _r


@query("m01_otsu_midgap", f"""WITH {EV}, t AS (SELECT key, v, count(*) AS c FROM ev GROUP BY 1, 2), u AS (SELECT key, v, sum(c) OVER w AS lo, sum(v * c) OVER w AS ls, sum(c) OVER (PARTITION BY key) AS n, sum(v * c) OVER (PARTITION BY key) AS t FROM t WINDOW w AS (PARTITION BY key ORDER BY v)),
b AS (SELECT key, v, lo * (n - lo) * (ls / lo - (t - ls) / (n - lo)) ** 2 AS b FROM u WHERE lo < n), s AS (SELECT key, v FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b DESC, v) AS r FROM b) WHERE r = 1)
SELECT ev.key, round((median(ev.v) FILTER (WHERE ev.v <= s.v) + median(ev.v) FILTER (WHERE ev.v > s.v)) / 2, 6) AS threshold FROM ev JOIN s ON ev.key = s.key GROUP BY ev.key""")
def m01(spark, sf):
    """With m02's guards for degenerate groups."""
    return _r(T.otsu_midgap(streams(spark, sf), ["key"], "v"), "threshold")


@query("m03_spread_threshold", f"""WITH {EV}, q AS (SELECT key, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.9) AS b, count(*) AS n FROM ev GROUP BY key), t AS (SELECT *, greatest(1, a + 0.35 * (b - a)) AS t FROM q),
o AS (SELECT ev.key, any_value(t) AS t, any_value(n) AS n, any_value(b - a) AS sp, count(*) FILTER (WHERE v < t) AS nl, count(*) FILTER (WHERE v >= t) AS nh, median(v) FILTER (WHERE v < t) AS ml, median(v) FILTER (WHERE v >= t) AS mh FROM ev JOIN t ON ev.key = t.key GROUP BY ev.key)
SELECT key, round(t, 6) AS threshold, round(mh - ml, 6) AS separation, nl >= greatest(20, ceil(0.05 * n)) AND nh >= greatest(20, ceil(0.05 * n)) AND sp >= 1 AND mh - ml >= 1 AS bimodal FROM o""")
def m03(spark, sf):
    return _r(T.spread_threshold(streams(spark, sf), ["key"], "v", 1.0, 0.35, 20, 0.05), "threshold", "separation")


@query("m04_bimodal_static", f"""WITH {EV}, r AS (SELECT s, min(k) AS lo, max(k) AS hi FROM ev GROUP BY s), o AS (SELECT ev.s, any_value(hi - lo) AS w, avg(CASE WHEN (k - lo) / (hi - lo) >= 0.5 THEN 1 ELSE 0 END) AS h, avg(CASE WHEN (k - lo) / (hi - lo) <= 0.25 OR (k - lo) / (hi - lo) >= 0.75 THEN 1 ELSE 0 END) AS p FROM ev JOIN r ON ev.s = r.s GROUP BY ev.s)
SELECT s, round(h, 6) AS high_share, round(p, 6) AS pure_share, w >= 10 AND p >= 0.5 AND h BETWEEN 0.3 AND 0.7 AS static FROM o""")
def m04(spark, sf):
    return _r(T.bimodal_static(streams(spark, sf), ["s"], "k", 10, 0.25, 0.5, (0.3, 0.7)), "high_share", "pure_share")


@query("m05_affine_calibration")
def m05(spark, sf):
    """An iterative fit: no SQL; the tests check the zero gradient at its result and a peer's optimum."""
    return _r(T.affine_fit(streams(spark, sf), ["key"], "x", "p"), "slope", "intercept", digits=4)


@query("m06_block_bootstrap")
def m06(spark, sf):
    """Hash-seeded draws: no SQL; the tests check counts and repeatability."""
    df = streams(spark, sf).groupBy((F.col("i") % 50).alias("block")).agg(F.sum("k").alias("a"), F.count("*").alias("n"))
    return _r(T.block_bootstrap(df, "block", "a", "n", 200, 7), "value")


@query("m07_block_ap_parts", f"WITH {EV}, r AS (SELECT s, key, x, row_number() OVER w AS r, count(*) FILTER (WHERE x) OVER w AS c FROM ev WINDOW w AS (PARTITION BY s ORDER BY p DESC, i)) SELECT s, key, count(*) FILTER (WHERE x) AS positives, round(coalesce(sum(CASE WHEN x THEN c / r END), 0), 6) AS precision_sum FROM r GROUP BY s, key")
def m07(spark, sf):
    """Each stream's ranking: a block is an event type of it."""
    return _r(T.block_ap_parts(streams(spark, sf), ["s"], "key", "x", "p", "i"), "precision_sum")


@query("m10_circular_null", f"""WITH {EV}, {RUNS}, n AS (SELECT s, run_id, x, k >= 50 AS h, row_number() OVER (PARTITION BY s, run_id ORDER BY pos) - 1 AS rp, count(*) OVER (PARTITION BY s, run_id) AS rl FROM ru)
SELECT CAST(t.sh AS BIGINT) AS shift, count(*) AS n, count(*) FILTER (WHERE a.x = b.h) AS agree FROM n a, (VALUES (1), (2), (5)) AS t(sh), n b WHERE a.s = b.s AND a.run_id = b.run_id AND b.rp = (a.rp + t.sh) % a.rl GROUP BY 1""")
def m10(spark, sf):
    df = S.run_positions(S.contiguous_runs(streams(spark, sf), ["s"], "pos", "g"), ["s", "run_id"], "pos").withColumn("h", F.col("k") >= 50)
    return T.circular_null(df, ["s", "run_id"], "run_pos", "run_len", "x", "h", [1, 2, 5])


@query("m11_fdr", f"""WITH {EV}, o AS (SELECT key, avg(v) AS o FROM ev GROUP BY key), p AS (SELECT s, (1 + count(*) FILTER (WHERE v >= o)) / (count(*) + 1) AS p FROM ev JOIN o USING (key) GROUP BY s), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM p), c AS (SELECT max(p) AS c FROM r WHERE p <= 0.9 * r / 2000)
SELECT s, round(p, 6) AS p, coalesce(p <= c, false) AS passed FROM p, c""")
def m11(spark, sf):
    """Every stream, in a family that was frozen at 2,000 before the streams were counted."""
    df = streams(spark, sf)
    null = df.join(df.groupBy("key").agg(F.avg("v").alias("o")), "key")
    return _r(T.fdr(T.upper_tail(null, ["s"], "v", "o"), "p", 2000, 0.9), "p")


@query("m11b_fdr_all", f"""WITH {EV}, o AS (SELECT key, avg(v) AS o FROM ev GROUP BY key), p AS (SELECT s, (1 + count(*) FILTER (WHERE v >= o)) / (count(*) + 1) AS p FROM ev JOIN o USING (key) GROUP BY s), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r FROM p), n AS (SELECT count(*) AS n FROM p), c AS (SELECT max(p) AS c FROM r, n WHERE p <= 0.5 * r / n)
SELECT s, round(p, 6) AS p, coalesce(p <= c, false) AS passed FROM p, c""")
def m11b(spark, sf):
    """m11 over every stream; the family is all of them."""
    df = streams(spark, sf)
    tails = T.upper_tail(df.join(df.groupBy("key").agg(F.avg("v").alias("o")), "key"), ["s"], "v", "o")
    return _r(T.fdr(tails, "p", tails.count(), 0.5), "p")


@query("m12_simultaneous_lower", f"""WITH {EV}, r AS (SELECT key, s, avg(k) AS v FROM ev GROUP BY 1, 2), m AS (SELECT key, avg(v) AS m FROM r GROUP BY 1), w AS (SELECT quantile_cont(d, 0.9) AS q FROM (SELECT s, max(v - m) AS d FROM r JOIN m USING (key) GROUP BY s)) SELECT key, round(m, 6) AS mean, round(m - q, 6) AS lower FROM m, w""")
def m12(spark, sf):
    reps = streams(spark, sf).groupBy("key", "s").agg(F.avg("k").alias("v"))
    return _r(T.simultaneous_lower(reps, "key", "v", "s", 0.9), "mean", "lower")


@query("m13_shuffled_events", f"WITH {EV} SELECT s, count(*) AS n FROM ev WHERE x GROUP BY s")
def m13(spark, sf):
    """Places are hashed, so what SQL can check is that each stream keeps its number of events."""
    return T.shuffled_events(streams(spark, sf), ["s"], "pos", "x", 3).groupBy("s").agg(F.count("*").alias("n"))


PLACES = f"""{EV}, t AS (SELECT s, pos, x, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev), e AS (SELECT s, pos, CASE WHEN x THEN 'onset' ELSE 'release' END AS kind FROM t WHERE x <> b),
n AS (SELECT s, kind, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT z.seed, ev.s, kind, pos, n, row_number() OVER (PARTITION BY ev.s, kind, z.seed ORDER BY CAST('0x' || left(sha256(z.seed || ':' || kind || ':' || ev.s || ':' || pos), 15) AS BIGINT)) AS r
    FROM ev JOIN n ON n.s = ev.s, (VALUES (1), (2), (5)) AS z(seed)), pl AS (SELECT seed, s, kind, pos FROM h WHERE r <= n)"""


def _changes(spark, sf):
    return S.transitions(streams(spark, sf), ["s"], "pos", "x").select("s", "pos", "kind")


@query("m13b_shuffled_places", f"WITH {PLACES} SELECT * FROM pl")
def m13b(spark, sf):
    return T.shuffled_places(_changes(spark, sf), streams(spark, sf), ["s"], "pos", "kind", [1, 2, 5])


@query("m13c_shuffled_scores", f"""WITH {PLACES}, m AS (SELECT pl.seed, kind, count(*) AS m FROM pl JOIN e USING (s, kind, pos) GROUP BY ALL), c AS (SELECT kind, sum(n) AS n FROM n GROUP BY kind), q AS (SELECT DISTINCT seed, kind FROM pl)
SELECT q.seed, q.kind, round(2.0 * coalesce(m, 0) / (2 * n), 6) AS f1 FROM q JOIN c USING (kind) LEFT JOIN m ON m.seed = q.seed AND m.kind = q.kind""")
def m13c(spark, sf):
    changes = _changes(spark, sf)
    return _r(T.shuffled_scores(changes, T.shuffled_places(changes, streams(spark, sf), ["s"], "pos", "kind", [1, 2, 5]), ["s"], "pos", "kind", 0), "f1")


@query("m14_analytic_chance", "SELECT conv_id, w AS width, round(list_sum([least(w - 1, i + 1) - greatest(0, i - 1) + 1 for i in range(w)]) / (w * w), 6) AS chance FROM (SELECT conv_id, count(*) AS w FROM conversations GROUP BY 1)")
def m14(spark, sf):
    """A guess of a turn of every conversation, right within one turn."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("width"))
    return _r(turns.withColumn("chance", T.analytic_chance(F.col("width"), 1)), "chance")


@query("m15_decision", f"WITH {EV}, d AS (SELECT s, avg(k) - 49 AS d FROM ev GROUP BY s) SELECT round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > 0) AS improved, round(min(d), 6) AS worst_delta, avg(d) >= 0.1 AND count(*) FILTER (WHERE d > 0) >= 10 AND min(d) >= -20 AS adopt FROM d")
def m15(spark, sf):
    return _r(T.decision(streams(spark, sf).groupBy("s").agg((F.avg("k") - 49).alias("d")), "s", "d", 0.1, 10, -20.0), "mean_delta", "worst_delta")


@query("m16_rate_gate", f"WITH {EV}, r AS (SELECT s, avg(CASE WHEN k >= 50 THEN 1 ELSE 0 END) / nullif(avg(CASE WHEN x THEN 1 ELSE 0 END), 0) AS r FROM ev GROUP BY s) SELECT s, round(r, 6) AS ratio, coalesce(r BETWEEN 0.5 AND 2, false) AS within FROM r")
def m16(spark, sf):
    return _r(T.rate_gate(streams(spark, sf), ["s"], "x", F.col("k") >= 50), "ratio")


@query("m18_most_alive", "SELECT l_returnflag, arg_max(l_linenumber, least(q, d, t) * 100 - l_linenumber) AS l_linenumber, max(least(q, d, t)) AS motion, max(least(q, d, t)) >= 2 AS alive FROM (SELECT l_returnflag, l_linenumber, max(l_quantity) AS q, count(DISTINCT l_discount)::DOUBLE AS d, count(DISTINCT l_tax)::DOUBLE AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def m18(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.countDistinct("l_discount").cast("double").alias("d"), F.countDistinct("l_tax").cast("double").alias("t"))
    return T.most_alive(per, ["l_returnflag"], "l_linenumber", ["q", "d", "t"], 2.0)


LAGS = "l AS (SELECT a.key, CAST(h AS BIGINT) AS lag, round(avg(b.k), 9) AS score FROM ev a, range(-3, 4) AS t(h), ev b WHERE b.s = a.s AND b.pos = a.pos + h GROUP BY 1, 2)"


def _lags(spark, sf):
    df = streams(spark, sf)
    a = df.select("key", "s", "pos", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))).alias("lag")).withColumn("at", F.col("pos") + F.col("lag"))
    return a.drop("pos").join(df.select("s", F.col("pos").alias("at"), "k"), ["s", "at"]).groupBy("key", "lag").agg(F.round(F.avg("k"), 9).alias("score"))


@query("g05_lag_verdict", f"WITH {EV}, {LAGS}, b AS (SELECT key, lag AS w, score AS top FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lag) AS r FROM l) WHERE r = 1) SELECT b.key, any_value(w) AS winner, round(any_value(top) - max(score) FILTER (WHERE abs(lag - w) > 1), 6) AS margin FROM b JOIN l ON l.key = b.key GROUP BY b.key")
def g05(spark, sf):
    return _r(T.lag_verdict(_lags(spark, sf), ["key"], "lag", "score", 1), "margin")


@query("m19_fold_lifts", f"WITH {EV}, {LAGS}, b AS (SELECT key, max(score) AS b FROM l WHERE lag < 0 GROUP BY key) SELECT key, lag, round(score - b, 6) AS lift FROM l JOIN b USING (key) WHERE lag >= 0")
def m19(spark, sf):
    return _r(T.fold_lifts(_lags(spark, sf), "key", "lag", "score"), "lift")


@query("m20_recomputed_verdicts", f"WITH {EV}, s AS (SELECT s, sum(k) AS m FROM ev WHERE active GROUP BY s), f AS (SELECT s, sum(k) + s % 2 AS m FROM ev WHERE active GROUP BY s) SELECT s, abs(s.m - f.m) <= 0.5 AS agrees FROM s JOIN f USING (s)")
def m20(spark, sf):
    stored = streams(spark, sf).where("active").groupBy("s").agg(F.sum("k").alias("m"))
    return T.recomputed_verdicts(stored, stored.withColumn("m", F.col("m") + F.col("s") % 2), ["s"], "m", 0.5)


@query("g06_oracle_threshold", f"""WITH {EV}, q AS (SELECT key, quantile_cont(p, [0.005 + 0.99 * z / 198 for z in range(199)]) AS q FROM ev GROUP BY key), c AS (SELECT DISTINCT key, unnest(list_append(q, 0.5)) AS t FROM q), u AS (SELECT key, p, count(*) FILTER (WHERE x) AS a, count(*) AS n FROM ev GROUP BY 1, 2),
z AS (SELECT c.key, c.t, 2 * sum(CASE WHEN p >= t THEN a ELSE 0 END) / (sum(CASE WHEN p >= t THEN n ELSE 0 END) + sum(a)) AS f FROM c JOIN u ON c.key = u.key GROUP BY 1, 2) SELECT key, round(max(f), 6) AS f1 FROM z GROUP BY key""")
def g06(spark, sf):
    return _r(T.oracle_threshold(streams(spark, sf), ["key"], "x", "p"), "f1").select("key", "f1")


@query("l01_range_violations", f"WITH {EV}, r AS (SELECT s, pos, pos + k % 3 AS e, lag(pos + k % 3) OVER (PARTITION BY s ORDER BY pos, pos + k % 3) AS b FROM ev), v AS (SELECT s, pos, CASE WHEN pos >= e THEN 'empty' WHEN pos < 4 OR e > 60 THEN 'outside' WHEN b > pos THEN 'overlap' END AS reason FROM r) SELECT s, pos, reason FROM v WHERE reason IS NOT NULL")
def l01(spark, sf):
    df = streams(spark, sf).withColumn("e", F.col("pos") + F.col("k") % 3)
    return I.range_violations(df, ["s"], "pos", "e", 4, 60)


@query("l03_runs_to_times", f"""WITH {EV}, {HELD}, d AS (SELECT s, median(d) AS dt FROM (SELECT s, i - lag(i) OVER (PARTITION BY s ORDER BY pos) AS d FROM ev) GROUP BY s)
SELECT held.s, a AS "start", b AS "end", CAST(least(greatest(x.i, 100), 9000) AS DOUBLE) AS t0, CAST(least(greatest(coalesce(y.i, z.i + dt), 100), 9000) AS DOUBLE) AS t1 FROM held JOIN ev x ON x.s = held.s AND x.pos = a LEFT JOIN ev y ON y.s = held.s AND y.pos = b JOIN ev z ON z.s = held.s AND z.pos = b - 1 JOIN d ON d.s = held.s""")
def l03(spark, sf):
    df = streams(spark, sf)
    return I.runs_to_times(S.flag_runs(df, ["s"], "pos", "x"), df, ["s"], "pos", "i", 100.0, 9000.0)


@query("l04_coverage_report", f"""WITH {EV}, {HELD}, t AS (SELECT s, count(*) AS n FROM ev GROUP BY s), r AS (SELECT s, count(*) AS c, sum(b - a) AS v, median(b - a) AS m, quantile_cont(b - a, 0.9) AS p FROM held GROUP BY s)
SELECT s, coalesce(c, 0) AS ranges, CAST(coalesce(v, 0) AS BIGINT) AS covered, round(coalesce(v, 0) / n, 6) AS share, m AS median_len, round(p, 6) AS p90_len, coalesce(v, 0) / n >= 0.4 AS passed FROM t LEFT JOIN r USING (s)""")
def l04(spark, sf):
    df = streams(spark, sf)
    return _r(I.coverage_report(S.flag_runs(df, ["s"], "pos", "x"), df.groupBy("s").agg(F.count("*").alias("n")), ["s"], "start", "end", "n", 0.4), "share", "p90_len")


@query("l05_shifted_labels", f"WITH {EV} SELECT a.s, a.pos, b.k FROM ev a JOIN ev b ON a.s = b.s AND b.pos = a.pos + 3")
def l05(spark, sf):
    df = streams(spark, sf)
    return I.shifted_labels(df.select("s", "pos"), df, ["s"], "pos", "k", 3)


@query("l06_resampled", f"""WITH {EV}, b AS (SELECT s, min(i) AS t0, max(i) AS t1 FROM ev GROUP BY s), g AS (SELECT s, t0, unnest(range(0, CAST(floor((t1 - t0) / 500) AS BIGINT) + 2)) AS slot FROM b), c AS (SELECT g.s, slot, k, row_number() OVER (PARTITION BY g.s, slot ORDER BY abs(i - (t0 + slot * 500)), i) AS r FROM g JOIN ev ON ev.s = g.s)
SELECT s, slot, k FROM c WHERE r = 1""")
def l06(spark, sf):
    return I.resampled(streams(spark, sf), ["s"], "i", "k", 500.0, 1)


@query("l07_bounded_parts", f"WITH {EV}, {HELD}, m AS (SELECT s, max(pos) AS m FROM ev GROUP BY s), c AS (SELECT s, a, least(b, m) AS b FROM held JOIN m USING (s) WHERE a < m), p AS (SELECT s, b, unnest(range(a, b, 3)) AS q FROM c) SELECT s, q AS part_start, least(q + 3, b) AS part_end FROM p WHERE least(q + 3, b) - q >= 2")
def l07(spark, sf):
    """With b04: parts of a bounded number of rows, short ones dropped. The media ends before a stream's last row."""
    df = streams(spark, sf)
    runs = S.flag_runs(df, ["s"], "pos", "x").join(df.groupBy("s").agg(F.max("pos").alias("m")), "s")
    return I.bounded_parts(runs, ["s"], "start", "end", "m", 3, 2)


def _event_lags(spark, sf):
    """One row per error, as an event, and lag: the value there."""
    df = streams(spark, sf)
    a = df.where("key = 'error'").select("s", F.col("pos").alias("e"), F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(2).cast("long"))).alias("lag")).withColumn("pos", F.col("e") + F.col("lag"))
    return a.join(df.select("s", "pos", "k"), ["s", "pos"]).select("s", "e", "lag", "k")


@query("m08_median_argmax")
def m08(spark, sf):
    """Hash-seeded draws: no SQL; the tests check one draw's winner and repeatability."""
    return T.median_argmax(_event_lags(spark, sf), ["s"], "e", "lag", "k", 20, 3)


@query("m09_block_agreement", f"""WITH {EV}, v AS (SELECT a.s, a.pos AS e, CAST(h AS BIGINT) AS lag, b.k FROM ev a, range(-2, 3) AS t(h), ev b WHERE a.key = 'error' AND b.s = a.s AND b.pos = a.pos + h),
c AS (SELECT s, e, ntile(3) OVER (PARTITION BY s ORDER BY e) AS b FROM (SELECT DISTINCT s, e FROM v)), m AS (SELECT s, b, lag, round(avg(k), 9) AS m FROM v JOIN c USING (s, e) GROUP BY ALL),
w AS (SELECT s, b, lag AS w FROM m QUALIFY row_number() OVER (PARTITION BY s, b ORDER BY m DESC, lag) = 1) SELECT s, min(w) AS lowest, max(w) AS highest, max(w) - min(w) <= 1 AS agrees FROM w GROUP BY s""")
def m09(spark, sf):
    return T.block_agreement(_event_lags(spark, sf), ["s"], "e", "lag", "k", 3, 1)


@query("m17_bind_confidence", f"""WITH {EV}, u AS (SELECT s, key, least(1.0, count(*) / 20.0) AS support, round(avg(p), 9) AS score FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS nx FROM u WINDOW w AS (PARTITION BY s ORDER BY score DESC, key))
SELECT s, key, round(support * (0.65 * score + 0.35 * (score - nx)), 6) AS confidence, support * (0.65 * score + 0.35 * (score - nx)) >= 0.2 AS trusted FROM r WHERE r = 1""")
def m17(spark, sf):
    units = streams(spark, sf).groupBy("s", "key").agg(F.least(F.lit(1.0), F.count("*") / 20.0).alias("support"), F.round(F.avg("p"), 9).alias("score"))
    return _r(T.bind_confidence(units, ["s"], "key", "support", "score", 0.2), "confidence")


@query("e38_cell_states", f"""WITH {EV}, x AS (SELECT key AS cell, CAST(v AS DOUBLE) AS v, key < 'm' AS hp FROM ev WHERE v IS NOT NULL AND NOT isnan(v)), e AS (SELECT cell, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1),
b AS (SELECT x.*, lo, hi, CAST(floor((v - lo) / greatest(hi - lo, 1e-9) * 255) AS BIGINT) AS bin FROM x JOIN e USING (cell)), h AS (SELECT cell, bin, count(*) AS c FROM b GROUP BY ALL),
u AS (SELECT cell, bin, sum(c) OVER w AS a, sum(bin * c) OVER w AS s, sum(c) OVER (PARTITION BY cell) AS n, sum(bin * c) OVER (PARTITION BY cell) AS t FROM h WINDOW w AS (PARTITION BY cell ORDER BY bin)),
o AS (SELECT cell, bin AS level FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN a < n THEN a * (n - a) * (s / a - (t - s) / (n - a)) ** 2 ELSE 0 END DESC, bin) AS r FROM u) WHERE r = 1),
m AS (SELECT cell, median(v) FILTER (WHERE v <= lo + level / 255 * (hi - lo)) AS l, median(v) FILTER (WHERE v > lo + level / 255 * (hi - lo)) AS h, median(v) AS m FROM b JOIN o USING (cell) GROUP BY 1),
t AS (SELECT cell, CASE WHEN h IS NULL THEN m ELSE l END AS low, CASE WHEN h IS NULL THEN m ELSE h END AS high FROM m)
SELECT cell, round(low, 6) AS low, round(high, 6) AS high, round((low + high) / 2, 6) AS threshold, round(high - low, 6) AS separation, least(count(*) FILTER (WHERE v >= (low + high) / 2), count(*) FILTER (WHERE v < (low + high) / 2)) AS minority,
count(*) FILTER (WHERE (v >= (low + high) / 2) = hp) AS pressed, minority >= 30 AND high - low >= 5 AS changing FROM x JOIN t USING (cell) GROUP BY cell, low, high""")
def e38(spark, sf):
    df = streams(spark, sf).select(F.col("key").alias("cell"), "v", (F.col("key") < "m").alias("hp"))
    return _r(T.cell_states(df, ["cell"], "v", "hp", 30, 5.0), "low", "high", "threshold", "separation")
