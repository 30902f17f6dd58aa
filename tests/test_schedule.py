"""Schedules: any range of steps equals that range of the whole, quotas and mixtures are exact, permutations whole."""

from collections import Counter
from math import gcd

import pytest
from pyspark.sql import functions as F

from strandline.operators import schedule


def test_coprime_strides():
    for size in range(1, 60):
        for seed in (0, 1, 5, 10**17):
            stride = schedule.coprime_stride(seed, size)
            assert size == 1 and stride == 0 or gcd(stride, size) == 1 and 1 <= stride <= size
            assert sorted((3 + k * stride) % size for k in range(size)) == list(range(size))


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 4, "c": 3, "d": 2, "e": 1}, {"a": 1, "b": 97}, {"a": 7, "b": 7, "c": 7}])
def test_weighted_plan_stays_within_one_draw(weights):
    total, plan, counts = sum(weights.values()), schedule.weighted_plan(weights, "s"), Counter()
    for n, (source, before, weight) in enumerate(plan * 3, 1):
        assert before == counts[source] % weights[source] and weight == weights[source]
        behind = {s: n * w - total * counts[s] for s, w in weights.items()}
        assert behind[source] == max(behind.values())  # the greedy rule holds over all periods, not only the first
        counts[source] += 1
        assert all(abs(counts[s] * total - n * w) <= total for s, w in weights.items())
    assert counts == {s: 3 * w for s, w in weights.items()}
    with pytest.raises(ValueError):
        schedule.weighted_plan({"a": 0}, "s")


@pytest.fixture(scope="module")
def items(spark):
    """Buckets of unequal sizes; one holds most rows."""
    return spark.range(3000).select((F.col("id") * 3).alias("id"), F.when(F.col("id") % 50 > 10, "a").when(F.col("id") % 50 > 3, "b").otherwise("c").alias("source"), (F.col("id") % 7 > 4).cast("string").alias("cell"))


def test_counter_schedule(spark, items):
    weights = {"a": 3, "b": 2, "c": 1}

    def steps(first, last):
        return sorted(tuple(r) for r in schedule.counter_schedule(items, "cell", "source", "id", weights, 8, first, last, "x").collect())

    whole = steps(0, 90)
    assert steps(17, 40) == [r for r in whole if 17 <= r[0] < 40]
    assert Counter((r[0], r[1]) for r in whole) == {(t, c): 8 for t in range(90) for c in ("false", "true")}
    sizes = {(r.cell, r.source): r["count"] for r in items.groupBy("cell", "source").count().collect()}
    bucket = {r.id: (r.cell, r.source) for r in items.collect()}
    for key, size in sizes.items():
        drawn = sorted((r[4], r[5]) for r in whole if (r[1], r[3]) == key)
        assert [d for d, _ in drawn] == list(range(len(drawn)))
        assert all(bucket[i] == key for _, i in drawn)
        for at in range(0, len(drawn), size):  # a pass gives no item twice
            part = [i for _, i in drawn[at : at + size]]
            assert len(set(part)) == len(part)
    with pytest.raises(ValueError, match="no items"):
        schedule.counter_schedule(items, "cell", "source", "id", weights | {"z": 1}, 8, 0, 1, "x")


def test_mixture_and_receipt(spark, items):
    cycle = [{"a": 5, "b": 2, "c": 1}, {"a": 4, "b": 4, "c": 0}]

    def steps(first, last):
        return schedule.mixture(items, "source", "id", cycle, first, last, "m")

    whole = sorted(tuple(r) for r in steps(0, 500).collect())
    resumed = sorted(tuple(r) for r in steps(0, 203).union(steps(203, 500)).collect())
    assert resumed == whole
    assert Counter((r[0], r[2]) for r in whole) == {(t, s): n for t in range(500) for s, n in cycle[t % 2].items() if n}
    assert Counter((r[0], r[1]) for r in whole) == {(t, i): 1 for t in range(500) for i in range(8)}
    sizes = Counter(r.source for r in items.collect())
    for source, size in sizes.items():
        passes = {}
        for r in whole:
            if r[2] == source:
                passes.setdefault(r[4], []).append((r[3], r[5]))
        orders = [[i for _, i in sorted(p)] for p in passes.values()]
        assert all(len(set(p)) == len(p) for p in orders) and all(len(p) == size for p in orders[:-1])
        assert len(orders) < 3 or orders[0] != orders[1]
    receipt = {r.source: r for r in schedule.mixture_receipt(items, steps(0, 500), "source", "id", cycle, 500).collect()}
    for source, size in sizes.items():
        r, drawn = receipt[source], Counter(x[5] for x in whole if x[2] == source)
        assert (r["items"], r.scheduled, r.actual, r.unique_items, r.passes, r.most, r.complete) == (size, drawn.total(), drawn.total(), len(drawn), drawn.total() // size, max(drawn.values()), True)
    short = schedule.mixture_receipt(items, steps(0, 499), "source", "id", cycle, 500)
    assert not any(r.complete for r in short.collect() if r.source != "c")
    with pytest.raises(ValueError, match="differ"):
        schedule.mixture(items, "source", "id", [{"a": 1}, {"a": 2}], 0, 1, "m")
