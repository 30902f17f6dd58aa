"""Quantiles by rank over ranges equal Spark's own; dense cells of close states against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import align, ranges, selection


@pytest.fixture(autouse=True, params=[0, ranges.FEW_ROWS], ids=["ranges", "whole"])
def few(request, monkeypatch):
    """Every test by ranges, and by a whole window as small tables get it."""
    monkeypatch.setattr(ranges, "FEW_ROWS", request.param)


@pytest.mark.parametrize("probs", [{"a": 0.5}, {"a": 0.0, "b": 0.1, "c": 0.37, "d": 0.9, "e": 1.0}])
def test_quantiles(spark, probs):
    draw = random.Random(3)
    rows = [(g, draw.choice([None, 1.5, 2.0, draw.gauss(0, 9), -7.0])) for g, n in (("a", 900), ("b", 2), ("c", 1), ("d", 301)) for _ in range(n)] + [("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: tuple(r)[1:] for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()}
    got = {r.g: tuple(r)[1:] for r in ranges.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert got == {g: v for g, v in want.items() if v[0] is not None}
    assert tuple(ranges.exact_quantiles(df, [], "v", probs).first()) == tuple(df.agg(*[F.percentile("v", F.lit(p)) for p in probs.values()]).first())
    assert ranges.exact_quantiles(df.limit(0), ["g"], "v", probs).collect() == []


def test_quantiles_of_one_large_group(spark):
    """A group that holds all rows, most of them distinct, is many tasks' work."""
    df = spark.range(400_000).select(F.lit(1).alias("g"), ((F.col("id") * 7919) % 400_009).alias("v"))
    assert ranges.exact_quantiles(df, ["g"], "v", {"m": 0.5}).first().m == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


@pytest.mark.parametrize("width, radius, gap", [(30, 4.0, 2), (3, 4.0, 5), (200, 9.0, 1), (1, 0.25, 2)])
def test_close_states(spark, width, radius, gap):
    draw = random.Random(width)
    rows = [(draw.choice("ab"), i, draw.choice([draw.uniform(0, width), float(draw.randrange(width + 1))]), draw.uniform(-width, width), draw.choice("xxxyz") if width > 3 else "x" if i else "y") for i in range(350)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and abs(a[1] - b[1]) >= gap and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= radius * radius:
                want[a[0], a[1]] = want.get((a[0], a[1]), False) or a[4] != b[4]
    df = spark.createDataFrame([*rows, ("a", 999, None, 1.0, "x")], "s string, pos long, x double, y double, act string")
    got = align.close_states(df, ["s"], "x", "y", "pos", "act", radius, gap)
    assert {(r.s, r.pos): r.ambiguous for r in got.collect()} == want


def test_proportional_over_many_groups(spark):
    draw = random.Random(1)
    counts = {f"g{i:04d}": draw.randrange(1, 50) for i in range(1500)}
    total, every = 10_007, sum(counts.values())
    floors = {g: total * n // every for g, n in counts.items()}
    order = sorted(counts, key=lambda g: (-(total * counts[g] - floors[g] * every), g))
    for g in order[: total - sum(floors.values())]:
        floors[g] += 1
    df = spark.createDataFrame(list(counts.items()), "g string, n long").repartition(7)
    assert {r.g: r.allocated for r in selection.proportional(df, ["g"], "n", total).collect()} == floors
