"""Queries over metrics. y is a held value, p a probability with many ties, groups are event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import sequence as S
from ..operators import align as A
from .base import EV, HELD, query, streams, table
from .alignment import ONSETS, _onsets


def _r(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("e01_summary", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity) / 3600, 6) AS hours FROM lineitem GROUP BY 1")
def e01(spark, sf):
    return _r(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"), (F.sum("l_quantity") / 3600).alias("hours")), "hours")


@query("e02_first_values", f"WITH {EV} SELECT s, arg_min(key, pos) AS first_key, arg_min(k, pos) AS first_k, count(*) AS n FROM ev GROUP BY s")
def e02(spark, sf):
    return streams(spark, sf).groupBy("s").agg(F.min_by("key", "pos").alias("first_key"), F.min_by("k", "pos").alias("first_k"), F.count("*").alias("n"))


AP = "c AS (SELECT key, p, count(*) FILTER (WHERE x) AS tp, count(*) AS n FROM ev GROUP BY key, p), u AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM c WINDOW w AS (PARTITION BY key ORDER BY p DESC))"


@query("e03_average_precision", f"WITH {EV}, {AP} SELECT key, CAST(sum(tp) AS BIGINT) AS positives, round(CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) END, 6) AS ap FROM u GROUP BY key")
def e03(spark, sf):
    return _r(M.average_precision(streams(spark, sf), ["key"], "x", "p"), "ap")


@query("e04_ordered_precision", f"""WITH {EV}, r AS (SELECT key, x, row_number() OVER w AS r, count(*) FILTER (WHERE x) OVER w AS c FROM ev WINDOW w AS (PARTITION BY key ORDER BY p DESC, i)), a AS (SELECT key, sum(CASE WHEN x THEN c / r END) / count(*) FILTER (WHERE x) AS ap, count(*) FILTER (WHERE x) / count(*) AS pr FROM r GROUP BY key)
SELECT key, round(ap, 6) AS ap, round(pr, 6) AS prevalence, round((ap - pr) / (1 - pr), 6) AS skill FROM a""")
def e04(spark, sf):
    return _r(M.ordered_precision(streams(spark, sf), ["key"], "x", "p", "i"), "ap", "prevalence", "skill")


@query("e05_prf", f"""WITH {EV}, c AS (SELECT key, count(*) FILTER (WHERE x AND k >= 50) AS tp, count(*) FILTER (WHERE NOT x AND k >= 50) AS fp, count(*) FILTER (WHERE x AND k < 50) AS fn FROM ev GROUP BY key)
SELECT key, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def e05(spark, sf):
    return _r(M.prf(streams(spark, sf), ["key"], "x", F.col("k") >= 50), "precision", "recall", "f1")


@query("e06_event_scores", f"""WITH {EV}, {ONSETS}, z AS (SELECT s, count(*) FILTER (WHERE ot) AS t, count(*) FILTER (WHERE op) AS p, count(*) FILTER (WHERE ot AND op) AS m FROM tr GROUP BY s)
SELECT s, round(2 * m / (t + p), 6) AS f1, round(CASE WHEN p = 0 THEN 0 ELSE m / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE m / t END, 6) AS recall FROM z WHERE t + p > 0""")
def e06(spark, sf):
    return _r(M.event_scores(A.matched_events(*_onsets(spark, sf), ["s"], "pos", 0), ["s"]), "f1", "precision", "recall")


@query("e06b_persistence_event_scores", f"""WITH {EV}, b AS (SELECT s, pos, x, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS q FROM ev), t AS (SELECT key, count(*) AS n FROM (SELECT 'all' AS key, x, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS w FROM b) WHERE x AND NOT w GROUP BY key)
SELECT key, CAST(0 AS DOUBLE) AS f1 FROM t""")
def e06b(spark, sf):
    """The known answer: persistence predicts no onset at its own frame, so event F1 at collar 0 is 0."""
    df = S.persistence(streams(spark, sf), ["s"], "pos", "x")
    true, pred = (S.transitions(df, ["s"], "pos", c).where("kind = 'onset'").select(F.lit("all").alias("key"), "s", "pos") for c in ("x", "persisted"))
    counts = A.matched_events(true, pred, ["key", "s"], "pos", 0).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "n_matched")])
    return M.event_scores(counts, ["key"]).select("key", "f1")


@query("e07_accuracy", f"""WITH {EV}, b AS (SELECT *, active AS y2, lag(x, 1, false) OVER w AS bx, lag(active, 1, false) OVER w AS ba FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)), c AS (SELECT CASE WHEN x = (k >= 50) THEN 1 ELSE 0 END AS r1, CASE WHEN active = (k >= 20) THEN 1 ELSE 0 END AS r2, * FROM b)
SELECT round(sum(r1 + r2) / (2 * count(*)), 6) AS micro, round(avg(CASE WHEN r1 + r2 = 2 THEN 1 ELSE 0 END), 6) AS joint, round(sum(CASE WHEN x THEN 0 ELSE 1 END + CASE WHEN active THEN 0 ELSE 1 END) / (2 * count(*)), 6) AS released,
round(sum(CASE WHEN x = bx THEN 1 ELSE 0 END + CASE WHEN active = ba THEN 1 ELSE 0 END) / (2 * count(*)), 6) AS persisted FROM c""")
def e07(spark, sf):
    df = streams(spark, sf).withColumn("p1", F.col("k") >= 50).withColumn("p2", F.col("k") >= 20)
    return _r(M.accuracy(df, ["s"], "pos", ["x", "active"], ["p1", "p2"]), "micro", "joint", "released", "persisted")


EDGES = [i / 10 for i in range(11)]
BIN = "least(" + " + ".join(f"CASE WHEN p >= CAST({e} AS DOUBLE) THEN 1 ELSE 0 END" for e in EDGES) + " - 1, 9)"


@query("e08_reliability", f"WITH {EV} SELECT key, CAST({BIN} AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN x THEN 1 ELSE 0 END), 6) AS rate FROM ev GROUP BY 1, 2")
def e08(spark, sf):
    return _r(M.reliability(streams(spark, sf), ["key"], "x", "p", EDGES), "mean_p", "rate")


@query("e08b_calibration_error", f"WITH {EV}, b AS (SELECT key, {BIN} AS bin, count(*) AS n, avg(p) AS a, avg(CASE WHEN x THEN 1 ELSE 0 END) AS r FROM ev GROUP BY 1, 2) SELECT key, round(sum(n * abs(a - r)) / sum(n), 6) AS ece FROM b GROUP BY key")
def e08b(spark, sf):
    return _r(M.expected_calibration_error(M.reliability(streams(spark, sf), ["key"], "x", "p", EDGES), ["key"]), "ece")


@query("e09_equal_mass_bins", f"WITH {EV}, t AS (SELECT key, p, x, ntile(8) OVER (PARTITION BY key ORDER BY p, i) AS bin FROM ev) SELECT key, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN x THEN 1 ELSE 0 END), 6) AS rate FROM t GROUP BY 1, 2")
def e09(spark, sf):
    return _r(M.equal_mass_bins(streams(spark, sf), ["key"], "x", "p", "i", 8), "mean_p", "rate")


@query("e10_losses", f"""WITH {EV}, c AS (SELECT key, x, p, greatest(least(p, 1 - 1e-7), 1e-7) AS c FROM ev), a AS (SELECT key, count(*) AS n, avg(CASE WHEN x THEN 1 ELSE 0 END) AS q, avg(CASE WHEN x THEN -ln(c) ELSE -ln(1 - c) END) AS nll, avg((p - CASE WHEN x THEN 1 ELSE 0 END) ** 2) AS brier FROM c GROUP BY key)
SELECT key, n, round(q, 6) AS prevalence, round(nll, 6) AS nll, round(brier, 6) AS brier, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 6) AS prior_nll, round(q * (1 - q), 6) AS prior_brier FROM a""")
def e10(spark, sf):
    """With e11: negative log-likelihood and Brier score beside those of the prior rate."""
    return _r(M.losses(streams(spark, sf), ["key"], "x", "p"), "prevalence", "nll", "brier", "prior_nll", "prior_brier")


@query("e12_macro", f"WITH {EV}, {AP}, a AS (SELECT key, CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / cn) / sum(tp) END AS ap FROM u GROUP BY key) SELECT 'all' AS scope, count(ap) AS n_defined, round(avg(ap), 6) AS mean, round(coalesce(stddev_samp(ap), 0), 6) AS spread FROM a")
def e12(spark, sf):
    ap = M.average_precision(streams(spark, sf), ["key"], "x", "p").withColumn("scope", F.lit("all"))
    return _r(M.macro(ap, ["scope"], "ap"), "mean", "spread")


@query("e13_weighted_and_equal", f"WITH {EV}, g AS (SELECT s, sum(v) AS t, count(v) AS n FROM ev GROUP BY s) SELECT round(sum(t) / sum(n), 6) AS row_mean, round(avg(t / n), 6) AS group_mean FROM g")
def e13(spark, sf):
    return _r(M.weighted_and_equal(streams(spark, sf), "s", "v"), "row_mean", "group_mean")


@query("e14_confusion_grid", f"WITH {EV}, c AS (SELECT * FROM (VALUES ('a'), ('b'), ('c')) AS t(actual), (VALUES ('a'), ('b'), ('c')) AS u(predicted)), o AS (SELECT CASE WHEN v < 20 THEN 'a' WHEN v < 60 THEN 'b' ELSE 'c' END AS actual, CASE WHEN k < 50 THEN 'a' ELSE 'b' END AS predicted, count(*) AS n FROM ev GROUP BY 1, 2) SELECT actual, predicted, coalesce(n, 0) AS n FROM c LEFT JOIN o USING (actual, predicted)")
def e14(spark, sf):
    df = streams(spark, sf).select(F.when(F.col("v") < 20, "a").when(F.col("v") < 60, "b").otherwise("c").alias("actual"), F.when(F.col("k") < 50, "a").otherwise("b").alias("predicted"))
    return M.confusion_grid(df, "actual", "predicted", ["a", "b", "c"])


@query("e15_offset_summary", f"""WITH {EV}, q AS (SELECT k % 3 AS t, [(k + 1) / (k + i + v + 3), (i + 1) / (k + i + v + 3), (v + 1) / (k + i + v + 3)] AS a FROM ev), b AS (SELECT t, a, list_position(a, list_max(a)) - 1 - t AS e, -ln(greatest(least(a[t + 1], 1 - 1e-7), 1e-7)) AS l, -list_sum(list_transform(a, lambda z: z * ln(z))) AS h FROM q)
SELECT count(*) AS n, round(avg(CASE WHEN e = 0 THEN 1 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN abs(e) <= 1 THEN 1 ELSE 0 END), 6) AS within1, round(avg(CASE WHEN abs(e) <= 2 THEN 1 ELSE 0 END), 6) AS within2, round(avg(l), 6) AS nll, round(avg(h), 6) AS entropy, round(avg(e), 6) AS signed FROM b""")
def e15(spark, sf):
    total = F.col("k") + F.col("i") + F.col("v") + 3
    df = streams(spark, sf).select((F.col("k") % 3).alias("t"), F.array((F.col("k") + 1) / total, (F.col("i") + 1) / total, (F.col("v") + 1) / total).alias("a"))
    return _r(M.offset_summary(df, "a", "t"), "exact", "within1", "within2", "nll", "entropy", "signed")


@query("e16_quartiles", f"WITH {EV}, t AS (SELECT key, v, k, ntile(4) OVER (PARTITION BY key ORDER BY v, i) AS q FROM ev) SELECT key, CAST(q AS BIGINT) AS quartile, count(*) AS n, round(avg(v), 6) AS mean_order, round(avg(k), 6) AS mean_value FROM t GROUP BY 1, 2")
def e16(spark, sf):
    return _r(M.quartiles(streams(spark, sf), ["key"], "v", "i", "k"), "mean_order", "mean_value")


@query("e17_run_statistics", f"WITH {EV}, {HELD} SELECT s, count(*) AS presses, median(b - a) AS median_run, round(avg(CASE WHEN b - a <= 1 THEN 1 ELSE 0 END), 6) AS burst_share, CAST(sum(b - a) AS BIGINT) AS rows_held FROM held GROUP BY s")
def e17(spark, sf):
    runs = S.flag_runs(streams(spark, sf), ["s"], "pos", "x").withColumn("n", F.col("end") - F.col("start"))
    return _r(M.run_statistics(runs, ["s"], "n", 1), "burst_share")


@query("e18_composite_statistics", f"WITH {EV}, {HELD}, r AS (SELECT s, count(*) AS n, avg(b - a) AS m, median(b - a) AS md FROM held GROUP BY s) SELECT s % 10 AS bucket, round(sum(n * m) / sum(n), 6) AS weighted, arg_max(md, n * 1000 + md) AS major_median FROM r GROUP BY 1")
def e18(spark, sf):
    runs = S.flag_runs(streams(spark, sf), ["s"], "pos", "x").withColumn("n", F.col("end") - F.col("start"))
    per = runs.groupBy("s").agg(F.count("*").alias("w"), F.avg("n").alias("m"), F.median("n").alias("md")).withColumn("bucket", F.col("s") % 10)
    return _r(M.composite_statistics(per, ["bucket"], "w", "m", "md"), "weighted")


@query("e19_duty", f"""WITH {EV}, c AS (SELECT s, pos, x, coalesce(x <> lag(x) OVER w, false) AS c, row_number() OVER w = 1 AS f FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos)), e AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY s ORDER BY pos), true) AND (c OR f) AS one FROM c)
SELECT s, count(*) AS n, round(avg(CASE WHEN x THEN 1 ELSE 0 END), 6) AS duty, count(*) FILTER (WHERE c) AS transitions, count(*) FILTER (WHERE one) AS singles FROM e GROUP BY s""")
def e19(spark, sf):
    return _r(M.duty(streams(spark, sf), ["s"], "pos", "x"), "duty")


@query("e20_robust_separation", f"""WITH {EV}, m AS (SELECT key, x, median(k) AS m FROM ev GROUP BY 1, 2), d AS (SELECT key, x, any_value(m.m) AS m, median(abs(k - m.m)) * 1.4826 AS d FROM ev JOIN m USING (key, x) GROUP BY 1, 2), o AS (SELECT key, max(m) FILTER (WHERE NOT x) AS low, max(m) FILTER (WHERE x) AS high, max(d) AS spread FROM d GROUP BY key)
SELECT key, low, high, round(spread, 6) AS spread, round(CASE WHEN spread > 0 THEN (high - low) / spread END, 6) AS separation FROM o""")
def e20(spark, sf):
    return _r(M.robust_separation(streams(spark, sf), ["key"], "x", "k"), "spread", "separation")


@query("e21_cadence", f"""WITH {EV}, d AS (SELECT key, i - lag(i) OVER (PARTITION BY key ORDER BY i) AS d FROM ev), m AS (SELECT key, count(*) AS n, median(d) AS md, quantile_cont(d, 0.01) AS a, quantile_cont(d, 0.99) AS b FROM d WHERE d IS NOT NULL GROUP BY key)
SELECT d.key, any_value(n) AS n, any_value(md) AS median_dt, round(any_value(a), 6) AS p01, round(any_value(b), 6) AS p99, count(*) FILTER (WHERE d > 3 * md) AS gaps FROM d JOIN m USING (key) WHERE d IS NOT NULL GROUP BY d.key""")
def e21(spark, sf):
    return _r(M.cadence(streams(spark, sf), ["key"], "i", 3), "p01", "p99")


@query("e22_positive_weights", f"WITH {EV} SELECT key, round(greatest(1, least(50, coalesce(count(*) FILTER (WHERE NOT x) / nullif(count(*) FILTER (WHERE x), 0), 50))), 6) AS weight FROM ev GROUP BY key")
def e22(spark, sf):
    return _r(M.positive_weights(streams(spark, sf), ["key"], "x", 50.0), "weight")


@query("e23_duration_histogram", f"WITH {EV}, {HELD} SELECT CASE WHEN b - a >= 5 THEN 3 WHEN b - a >= 3 THEN 2 WHEN b - a >= 2 THEN 1 ELSE 0 END::BIGINT AS bucket, count(*) AS n FROM held GROUP BY 1")
def e23(spark, sf):
    runs = S.flag_runs(streams(spark, sf), ["s"], "pos", "x").withColumn("n", F.col("end") - F.col("start"))
    return M.duration_histogram(runs, [], "n", [1, 2, 3, 5])


@query("e24_votes", f"WITH {EV}, c AS (SELECT s, g, count(*) FILTER (WHERE key = 'view') AS y, count(*) FILTER (WHERE key = 'click') AS n, count(*) AS a FROM ev GROUP BY s, g) SELECT s, g, CASE WHEN y > 0 AND n > 0 THEN 'mixed' WHEN y > 0 THEN 'yes' WHEN n = a THEN 'no' ELSE 'unknown' END AS outcome FROM c")
def e24(spark, sf):
    return M.votes(streams(spark, sf), ["s", "g"], "key", "view", "click")


@query("e25_unseen_rate", f"WITH {EV}, c AS (SELECT s, k * 8 + CASE WHEN x THEN 1 ELSE 0 END + CASE WHEN active THEN 2 ELSE 0 END AS c FROM ev), t AS (SELECT DISTINCT c FROM c WHERE s % 7 = 0), e AS (SELECT c FROM c WHERE s % 7 <> 0) SELECT (SELECT count(*) FROM t) AS known, count(*) FILTER (WHERE c NOT IN (SELECT c FROM t)) AS unseen_rows, round(count(*) FILTER (WHERE c NOT IN (SELECT c FROM t)) / count(*), 6) AS rate FROM e")
def e25(spark, sf):
    """A seventh of the streams against all others: every row is in one of the two."""
    df = streams(spark, sf).withColumn("c", F.col("k") * 8 + M.joint_code(["x", "active"]))
    return _r(M.unseen_rate(df.where("s % 7 = 0"), df.where("s % 7 <> 0"), "c"), "rate")


@query("e26_rank_auc", f"WITH {EV}, r AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY p, x DESC, i) AS r FROM ev), c AS (SELECT key, sum(r) FILTER (WHERE x) AS r, count(*) FILTER (WHERE x) AS a, count(*) FILTER (WHERE NOT x) AS b FROM r GROUP BY key) SELECT key, round((r - a * (a + 1) / 2) / (a * b), 6) AS auc FROM c")
def e26(spark, sf):
    return _r(M.rank_auc(streams(spark, sf), ["key"], "x", "p", "i"), "auc")


@query("e27_uniform_metadata", "SELECT 'lang' AS \"column\", count(DISTINCT lang) AS kinds, count(DISTINCT lang) = 1 AS uniform FROM documents UNION ALL SELECT 'source', count(DISTINCT source), count(DISTINCT source) = 1 FROM documents")
def e27(spark, sf):
    return M.uniform_metadata(table(spark, sf, "documents"), ["lang", "source"])


@query("e28_dimension_scales", "WITH x AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT dim, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END, 6) AS scale FROM x GROUP BY dim")
def e28(spark, sf):
    return _r(M.dimension_scales(table(spark, sf, "embeddings"), "embedding"), "mean", "scale")


@query("e29_mean_pair_cosine", "WITH n AS (SELECT label, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) AS m FROM embeddings), u AS (SELECT label, unnest(range(0, 64)) AS d, unnest(e)::DOUBLE / m AS u FROM n), q AS (SELECT label, d, sum(u) AS u, count(*) AS n FROM u GROUP BY 1, 2) SELECT label, max(n) AS n, round((sum(u * u) - max(n)) / (max(n) * (max(n) - 1)), 6) AS cosine FROM q GROUP BY label")
def e29(spark, sf):
    return _r(M.mean_pair_cosine(table(spark, sf, "embeddings"), ["label"], "embedding"), "cosine")


@query("e30_counts_as_map", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts FROM c GROUP BY lang")
def e30(spark, sf):
    return M.counts_as_map(table(spark, sf, "documents"), ["lang"], "source")


@query("e31_coverage_audit", "WITH c AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT count(*) FILTER (WHERE n > 0) AS \"unique\", count(*) FILTER (WHERE n = 0) AS missing, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS repeats, max(n) AS most FROM c")
def e31(spark, sf):
    return M.coverage_audit(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf, "customer"), "c_custkey")


@query("e33_leak_scan", f"WITH {EV}, c AS (SELECT s, avg(k) FILTER (WHERE x) - avg(k) FILTER (WHERE NOT x) AS d, count(*) FILTER (WHERE x) AS a, count(*) FILTER (WHERE NOT x) AS b FROM ev GROUP BY s) SELECT s, round(d, 6) AS difference, coalesce(a >= 5 AND b >= 5 AND abs(d) > 4, false) AS leaks FROM c")
def e33(spark, sf):
    return _r(M.leak_scan(streams(spark, sf), ["s"], "x", "k", 4.0, 5), "difference")


@query("e34_version_changes", "SELECT count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS compared, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL AND d.q <> l.quality) AS changed, count(*) FILTER (WHERE d.doc_id IS NULL) AS added, count(*) FILTER (WHERE l.doc_id IS NULL) AS removed FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS q FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id")
def e34(spark, sf):
    old = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("q"))
    return M.version_changes(old, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q")), "doc_id", "q")


@query("e35_calibrated_event_summary", f"""WITH {EV}, {ONSETS}, z AS (SELECT s, count(*) FILTER (WHERE ot) AS t, count(*) FILTER (WHERE op) AS p, count(*) FILTER (WHERE ot AND op) AS m FROM tr GROUP BY s)
SELECT 'all' AS scope, count(f) AS n_defined, round(avg(f), 6) AS mean, round(coalesce(stddev_samp(f), 0), 6) AS spread FROM (SELECT 2 * m / (t + p) AS f FROM z WHERE t + p > 0)""")
def e35(spark, sf):
    f1 = M.event_scores(A.matched_events(*_onsets(spark, sf), ["s"], "pos", 0), ["s"]).withColumn("scope", F.lit("all"))
    return _r(M.macro(f1, ["scope"], "f1"), "mean", "spread")


@query("e36_status_grid", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'none') AS none FROM orders GROUP BY 1")
def e36(spark, sf):
    return M.status_grid(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["O", "F", "none"])


@query("e37_stable_positions", "WITH x AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT dim, quantile_cont(x, 0.25) AS q FROM x GROUP BY dim), t AS (SELECT quantile_cont(q, 0.97) AS t FROM q) SELECT dim, round(q, 6) AS q25, round(CASE WHEN t > 0 THEN least(q / t, 1) ELSE 0 END, 6) AS scaled FROM q, t")
def e37(spark, sf):
    return _r(M.stable_positions(table(spark, sf, "embeddings"), "embedding"), "q25", "scaled")


@query("c13_unpivot_pivot", f"WITH {EV} SELECT s, pos, 'x' AS key, x AS y FROM ev UNION ALL SELECT s, pos, 'active', active FROM ev")
def c13(spark, sf):
    long = M.unpivot_keys(streams(spark, sf).select("s", "pos", "x", "active"), ["s", "pos"], ["x", "active"])
    wide = M.pivot_keys(long, ["s", "pos"], "key", "y", ["x", "active"])
    return M.unpivot_keys(wide, ["s", "pos"], ["x", "active"])


@query("c14_joint_code", f"WITH {EV} SELECT CAST(CASE WHEN x THEN 1 ELSE 0 END + CASE WHEN active THEN 2 ELSE 0 END + CASE WHEN k >= 50 THEN 4 ELSE 0 END AS BIGINT) AS code, count(*) AS n FROM ev GROUP BY 1")
def c14(spark, sf):
    return streams(spark, sf).withColumn("h", F.col("k") >= 50).groupBy(M.joint_code(["x", "active", "h"]).alias("code")).agg(F.count("*").alias("n"))


@query("e29b_effective_rank", """WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), d AS (SELECT CAST(j AS BIGINT) AS j FROM range(1, (SELECT max(len(e)) FROM v) + 1) AS t(j)),
c AS (SELECT a.j AS a, b.j AS b, covar_pop(e[a.j], e[b.j]) AS c FROM v, d AS a, d AS b GROUP BY ALL) SELECT (SELECT count(*) FROM v) AS n, round(sum(c) FILTER (WHERE a = b) ** 2 / sum(c * c), 6) AS rank FROM c""")
def e29b(spark, sf):
    return _r(M.effective_rank(table(spark, sf, "embeddings"), "embedding"), "rank")


NEAREST = """u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings),
nn AS (SELECT a.vec_id, max(struct_pack(s := round(list_inner_product(a.v, b.v), 9), i := -b.vec_id)) AS best FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"""


@query("e29c_nearest_neighbours", f"WITH {NEAREST} SELECT vec_id, -best.i AS neighbour, round(best.s, 6) AS similarity FROM nn")
def e29c(spark, sf):
    return _r(N.nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding").drop("compared"), "similarity")


@query("e29d_neighbour_uniqueness", f"WITH {NEAREST} SELECT count(*) AS n, round(count(DISTINCT best.i) / count(*), 6) AS \"unique\" FROM nn")
def e29d(spark, sf):
    return _r(N.neighbour_uniqueness(N.nearest_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding")), "unique")


def _bind_sql(group: str) -> str:
    """Scores of event types as units, in groups of this expression."""
    fits = "CASE WHEN d > 0 THEN exp(-abs(ln(d / 45.0))) ELSE 0 END AS jf, CASE WHEN NOT d > 0 THEN 0 WHEN d <= 30 THEN 1 WHEN d <= 48 THEN 1 - 0.6 * (d - 30) / 18.0 ELSE 0.4 * exp(-(d - 48) / 6.0) END AS df, CASE WHEN d > 0 THEN least(1.0, d / 60.0) ELSE 0 END AS gf"
    return f"""WITH {EV}, st AS (SELECT {group} AS q, key, count(*) AS n, median(k)::DOUBLE AS d, avg(CASE WHEN k <= 8 THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN x THEN 1.0 ELSE 0 END) AS r, avg(CASE WHEN v > 50 THEN 1.0 ELSE 0 END) AS u FROM ev GROUP BY 1, 2),
m AS (SELECT *, n / max(n) OVER (PARTITION BY q) AS f, least(1.0, n / 12.0) AS p, {fits} FROM st),
sc AS (SELECT q, 'jump' AS action, key, least(1.0, p * (0.50 * f + 0.40 * jf + 0.10 * b) + CASE WHEN key = 'click' THEN 0.05 ELSE 0 END) AS score FROM m
UNION ALL SELECT q, 'dash', key, least(1.0, p * (0.25 * f + 0.30 * df + 0.40 * r + 0.05 * b)) FROM m UNION ALL SELECT q, 'grab', key, least(1.0, p * (0.15 * f + 0.45 * gf + 0.30 * u + 0.10 * (1 - b))) FROM m)"""


def _bind_scores(spark, sf, group):
    df = streams(spark, sf).withColumn("q", group)
    share = lambda c: F.avg(c.cast("double"))
    stats = df.groupBy("q", "key").agg(F.count("*").alias("n"), F.median("k").alias("d"), share(F.col("k") <= 8).alias("b"), share(F.col("x")).alias("r"), share(F.col("v") > 50).alias("u"))
    return M.bind_scores(stats, ["q"], "key", "n", "d", "b", "r", "u", 45, 30, 48, 60, 12, {"jump": ["click"]}, 0.05)


@query("i12_bind_scores", _bind_sql("s") + " SELECT q AS s, action, key, round(score, 6) AS score FROM sc")
def i12(spark, sf):
    return _r(_bind_scores(spark, sf, F.col("s")), "score").withColumnRenamed("q", "s")


@query("i12b_best_binding", _bind_sql("0") + """ SELECT j.key AS unit_jump, d.key AS unit_dash, g.key AS unit_grab, round(j.score + d.score + g.score, 6) AS total FROM sc j, sc d, sc g
WHERE j.action = 'jump' AND d.action = 'dash' AND g.action = 'grab' AND j.key <> d.key AND j.key <> g.key AND d.key <> g.key ORDER BY j.score + d.score + g.score DESC, 1, 2, 3 LIMIT 1""")
def i12b(spark, sf):
    """The assignment of event types to actions of the highest total of these scores."""
    scores = _bind_scores(spark, sf, F.lit(0)).withColumn("members", F.array("key"))
    return _r(A.best_assignment(scores, ["jump", "dash", "grab"], "action", "key", "members", "score"), "total")
