"""A grid on few rows far apart: slots are not shuffled, are stored in few bytes and go to their nearest row."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals


def brute(rows, step, most_tail):
    out = []
    for s in {r[0] for r in rows}:
        known = sorted((t, k) for p, t, k in rows if p == s and t is not None)
        slots = range(int((known[-1][0] - known[0][0]) // step) + most_tail + 1) if known else ()
        out += [(s, n, min(known, key=lambda r: (abs(r[0] - (known[0][0] + n * step)), r[0]))[1]) for n in slots]
    return sorted(out)


@pytest.mark.parametrize("step, most_tail, row_slots", [(500.0, 1, 1024), (3.0, 0, 1), (0.25, 2, 7), (40.0, 1, 3)])
def test_resampled_equals_brute_force(spark, monkeypatch, step, most_tail, row_slots):
    monkeypatch.setattr(intervals, "ROW_SLOTS", row_slots, raising=False)
    draw = random.Random(3)
    rows = [(s, s * 10**12 + t, draw.randrange(9)) for s in range(6) for t in draw.sample(range(-90 * (s + 1), 90 * (s + 1)), 1 + 4 * s)] + [(6, None, 1), (3, None, 2)]
    got = intervals.resampled(spark.createDataFrame(rows, "s long, i long, k long"), ["s"], "i", "k", step, most_tail).collect()
    assert sorted((r.s, r.slot, r.k) for r in got) == brute(rows, step, most_tail)


def test_few_rows_with_many_slots(spark, tmp_path):
    """3,000 rows and 2,042,394 slots: 1.23 bytes a slot; all slots were shuffled before, and stored in 2.23 bytes."""
    rows = spark.range(3000).select((F.col("id") % 300).alias("s"), (F.col("id") * 7_919_317 % 12_000_000).alias("i"), (F.col("id") * 7 % 100).alias("k"))
    rows.write.parquet(f"{tmp_path}/rows")
    made = intervals.resampled(spark.read.parquet(f"{tmp_path}/rows"), ["s"], "i", "k", 500.0, 1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    shuffles = [at for at, line in enumerate(plan.splitlines()) if "RepartitionByExpression" in line or "Join" in line or "Union" in line]
    slots = [at for at, line in enumerate(plan.splitlines()) if "Generate explode" in line]
    assert len(shuffles) == 1 and max(slots) < shuffles[0]  # every explode is above the only shuffle
    made.write.parquet(f"{tmp_path}/slots")
    n = spark.read.parquet(f"{tmp_path}/slots").count()
    bounds = spark.read.parquet(f"{tmp_path}/rows").groupBy("s").agg((F.floor((F.max("i") - F.min("i")) / 500) + 2).alias("n"))
    assert n == bounds.agg(F.sum("n")).first()[0]
    size = sum(f.stat().st_size for f in (tmp_path / "slots").glob("*.parquet"))
    assert size < 1.7 * n, (size, n)
