"""Statistics that draw by hashes: what has to hold for any draw."""

import statistics

import numpy as np
from strandline.operators import stats


def test_median_argmax(spark):
    """One event leaves one draw; with several, a winner is a lag whose median may be the highest of some draw."""
    rows = [("a", 0, lag, v) for lag, v in ((-1, 1.0), (0, 5.0), (1, 5.0))]
    rows += [("b", e, lag, float((e * 7 + lag * 3) % 11)) for e in range(9) for lag in (0, 1, 2)]
    df = spark.createDataFrame(rows, "g string, e int, lag int, v double")
    got = stats.median_argmax(df, ["g"], "e", "lag", "v", 30, 1).collect()
    assert sorted(r.replicate for r in got if r.g == "b") == list(range(30))
    assert {r.winner for r in got if r.g == "a"} == {0}
    whole = {lag: statistics.median(r[3] for r in rows if r[0] == "b" and r[2] == lag) for lag in (0, 1, 2)}
    assert max(whole, key=whole.get) in {r.winner for r in got if r.g == "b"}


def test_block_ap_parts_add_up_to_average_precision(spark):
    rows = [("a", b, (i * 5) % 3 == 0, (i * 7) % 13 / 13, i) for i, b in enumerate("xyzxyzxyzxy")]
    df = spark.createDataFrame(rows, "g string, b string, y boolean, p double, i int")
    parts = stats.block_ap_parts(df, ["g"], "b", "y", "p", "i").collect()
    ranked = [r[2] for r in sorted(rows, key=lambda r: (-r[3], r[4]))]
    want = sum(sum(ranked[: k + 1]) / (k + 1) for k, y in enumerate(ranked) if y)
    assert abs(sum(r.precision_sum for r in parts) - want) < 1e-9 and sum(r.positives for r in parts) == sum(ranked)


def test_fdr_ranks_without_one_window_over_all_rows(spark):
    values = [((i * 37) % 101 / 101) ** 2 for i in range(400)]
    for parts in (256, 3):
        for family, q in ((400, 0.5), (1000, 0.9), (400, 0.0001)):
            rows = [(i, v) for i, v in enumerate(values)] + [(-1, None), (-2, float("nan"))]
            done = stats.fdr(spark.createDataFrame(rows, "i int, p double"), "p", family, q, parts)
            ranked = sorted(values)
            cut = max((p for r, p in enumerate(ranked, 1) if p <= q * r / family), default=-1)
            assert {r.i: r.passed for r in done.collect()} == {i: v is not None and v <= cut for i, v in rows}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    assert stats.fdr(spark.createDataFrame([(1, None)], "i int, p double"), "p", 5, 0.9).collect()[0].passed is False


def test_whole_table_fdr_holds_every_stream(spark):
    from strandline import plans

    sf = "/root/testdata/sf0.001"
    users = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    assert {r.s for r in plans.QUERIES["m11b_fdr_all"](spark, sf).collect()} == users


def _optimum(rows):
    """Slope and intercept of least loss by Newton steps with halving in numpy, slope at least 1e-8."""
    z = np.log(np.clip([r[2] for r in rows], 1e-6, 1 - 1e-6) / (1 - np.clip([r[2] for r in rows], 1e-6, 1 - 1e-6)))
    t = np.array([float(r[1]) for r in rows])

    def loss(x):
        return np.sum(np.logaddexp(0, x[0] * z + x[1]) - t * (x[0] * z + x[1]))

    best = np.array([1.0, 0.0])
    for _ in range(200):
        q = 1 / (1 + np.exp(-(best[0] * z + best[1])))
        g, h = np.array([np.sum((q - t) * z), np.sum(q - t)]), q * (1 - q)
        if best[0] <= 1e-8 and g[0] > 0:
            move = np.array([0.0, -g[1] / h.sum()])
        else:
            move = -np.linalg.solve([[np.sum(h * z * z), np.sum(h * z)], [np.sum(h * z), h.sum()]], g)
        size = 1.0
        while size > 1e-9 and loss(np.array([max(best[0] + size * move[0], 1e-8), best[1] + size * move[1]])) > loss(best):
            size /= 2
        best = np.array([max(best[0] + size * move[0], 1e-8), best[1] + size * move[1]])
    return best, loss(best), loss(np.array([1.0, 0.0]))


def test_affine_fit_ends_at_the_optimum(spark):
    draw = np.random.default_rng(3)
    rows = []
    for group, slope, shift in (("good", 2.0, -1.0), ("flat", 0.0, 0.3), ("wrong", -1.5, 0.0), ("steep", 6.0, 2.0)):
        p = np.round(draw.random(800), 2)
        z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        rows += [(group, bool(y), float(x)) for x, y in zip(p, draw.random(800) < 1 / (1 + np.exp(-(slope * z + shift))), strict=True)]
    rows += [("null", None, 0.5), ("null", True, None)]
    got = {r.g: r for r in stats.affine_fit(spark.createDataFrame(rows, "g string, y boolean, p double"), ["g"], "y", "p").collect()}
    assert set(got) == {"good", "flat", "wrong", "steep", "null"}
    for group in ("good", "flat", "wrong", "steep"):
        best, loss, before = _optimum([r for r in rows if r[0] == group])
        assert got[group].converged and np.allclose((got[group].slope, got[group].intercept), best, atol=1e-4), (group, best, got[group])
        assert loss < before or np.isclose(loss, before)
    assert got["wrong"].slope == 1e-8 and (got["null"].slope, got["null"].intercept) == (1.0, 0.0)


def test_affine_query_has_a_zero_gradient(spark):
    from strandline import plans
    from strandline.plans.base import streams

    sf = "/root/testdata/sf0.01"
    events = streams(spark, sf).select("key", "x", "p").collect()
    for r in plans.QUERIES["m05_affine_calibration"](spark, sf).collect():
        own = [(e.key, e.x, e.p) for e in events if e.key == r.key]
        best, _, _ = _optimum(own)
        assert r.converged and np.allclose((r.slope, r.intercept), best, atol=1e-3)


def test_oracle_threshold_on_continuous_scores(spark):
    draw = np.random.default_rng(1)
    rows = [("a", bool(y), float(p)) for p, y in zip(draw.random(500), draw.random(500) < 0.4, strict=True)] + [("b", True, 0.2), ("b", False, 0.9), ("c", False, 0.1)]
    got = {r.g: r for r in stats.oracle_threshold(spark.createDataFrame(rows, "g string, y boolean, p double"), ["g"], "y", "p").collect()}
    for group in "abc":
        y, p = np.array([r[1] for r in rows if r[0] == group]), np.array([r[2] for r in rows if r[0] == group])
        quantiles = {0.5, *np.percentile(p, [100 * (0.005 + 0.99 * i / 198) for i in range(199)])}
        scored = [(2 * (y & (p >= t)).sum() / d, t) for t in quantiles if (d := (p >= t).sum() + y.sum())]
        assert abs(got[group].f1 - max(scored)[0]) < 1e-9 and (group != "a" or abs(got[group].threshold - max(scored)[1]) < 1e-9)
