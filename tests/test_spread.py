"""Spread rows by ranges, and edge similarity whose cost is that of its entries."""

import re
import time

from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import selection


def test_spread_rows(spark):
    rows = [(None if i % 50 == 0 else i % 3, (i * 7919) % 10_007) for i in range(9_000)] + [(9, i) for i in range(4)]
    df = spark.createDataFrame(rows, "g long, o long").repartition(5)
    got = selection.spread_rows(df, ["g"], "o", 9, 0.02, 0.98)
    assert re.search(r"row_number\(\) windowspecdefinition\(g#\d+L?, __range", got._jdf.queryExecution().optimizedPlan().toString())  # a whole group was numbered before
    want = []
    for g in (0, 1, 2, 9):
        held = sorted(o for k, o in rows if k == g)
        at = range(len(held)) if len(held) <= 9 else sorted({round((0.02 + i * 0.12) * (len(held) - 1)) for i in range(9)})
        want += [(g, held[i]) for i in at]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_edge_similarity_of_long_arrays(spark):
    df = spark.range(4).select(*[F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.pmod(F.xxhash64(i, F.col("id") * m), F.lit(1000)).cast("double")).alias(c) for c, m in (("a", 1), ("b", 2))], "id")
    df = df.select("id", "a", F.when(F.col("id") == 3, F.col("a")).otherwise(F.col("b")).alias("b")).localCheckpoint()
    began = time.time()
    got = {r.id: r.e for r in df.select("id", scalars.edge_similarity(F.col("a"), F.col("b")).alias("e")).collect()}
    assert time.time() - began < 30  # arrays were sorted anew for each entry
    assert tuple(got[0]) == tuple(got[3]) == (1.0, 1.0, 1.0) and abs(got[1].correlation) < 0.1
