"""Grids and nearest events on one long part: right, and in frames that grow."""

import bisect

from strandline.operators import align, intervals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_resampled_long_part(spark):
    times = sorted({(i * i * 7919) % 400_009 for i in range(20_000)})
    df = spark.createDataFrame([(1, t, t % 97) for t in times], "s long, i long, k long")
    got = intervals.resampled(df, ["s"], "i", "k", 50.0, 1)
    assert "unboundedfollowing" not in plan(got)  # quadratic before

    def nearest(t):
        j = bisect.bisect_left(times, t)
        return min(times[max(0, j - 1) : j + 1], key=lambda u: (abs(u - t), u)) % 97

    last = (times[-1] - times[0]) // 50 + 1
    assert sorted((r.slot, r.k) for r in got.collect()) == [(n, nearest(times[0] + 50 * n)) for n in range(last + 1)]


def test_nearest_event_long_part(spark):
    true, seen = list(range(0, 60_000, 3)), [(i * i * 31) % 60_013 for i in range(5_000)]
    got = align.nearest_event(spark.createDataFrame([(1, t) for t in true], "s long, t long"), spark.createDataFrame([(1, t) for t in seen], "s long, t long"), ["s"], "t", 4)
    assert "unboundedfollowing" not in plan(got)
    order, want = sorted(set(seen)), []
    for t in true:
        j = bisect.bisect_left(order, t)
        u = min(order[max(0, j - 1) : j + 1], key=lambda u: (abs(u - t), u))
        want += [(t, u - t)] if abs(u - t) <= 4 else []
    assert sorted((r.t, r.offset) for r in got.collect()) == want
