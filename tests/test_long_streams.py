"""Streams and texts of scalar rules that the tables at hand don't hold."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F
from strandline.functions import scalars
from strandline.operators import align, sequence


def test_latch_of_a_long_stream(spark):
    """A million rows of one stream, in order, with a state carried over batches."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("s"), F.col("id").alias("pos"), F.lit(0.5).alias("p"), (F.col("id") % 10 == 3).cast("double").alias("o"), (F.col("id") % 10 == 7).cast("double").alias("r"))
    began = time.time()
    got = sequence.latch(df, ["s"], "pos", "p", "o", "r").groupBy().agg(F.count("*"), F.sum(F.col("held").cast("int"))).first()
    # Held from the first row to 6, then 3 to 6 of every ten.
    assert tuple(got) == (n, 7 + (n // 10 - 1) * 4) and time.time() - began < 60


def test_latch_against_a_loop(spark):
    draw = random.Random(8)
    level = [None, 0.0, 0.05, 0.3, 0.5, 0.7, 0.95, 1.0]
    rows = [(s, i, *(draw.choice(level) for _ in range(3))) for s in ("a", "b", None) for i in range(400)]
    want = set()
    for s in ("a", "b", None):
        held, against = None, 0
        for _, i, p, o, r in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]):
            if held is None:
                held = None if p is None else p >= 0.5
            else:
                signal = r if held else o
                event = None if signal is None else signal >= 0.5
                if event:
                    held = not held
                against = against + 1 if event is False and p is not None and (held and p <= 0.1 or not held and p >= 0.9) else 0
                if against >= 2:
                    held, against = p >= 0.9, 0
            want.add((s, i, held))
    df = spark.createDataFrame(rows, "s string, pos int, p double, o double, r double").repartition(5)
    assert {tuple(x) for x in sequence.latch(df, ["s"], "pos", "p", "o", "r", patience=2).collect()} == want


def test_in_intervals_keeps_each_point_once(spark):
    draw = random.Random(2)
    spans = [(s, a, a + draw.choice([0.0, 1.0, 7.5, 40.0])) for s in "ab" for a in (draw.uniform(-50, 50) for _ in range(60))]
    points = [(s, draw.uniform(-70, 70), i) for s in "abc" for i in range(300)] + [("a", None, -1), ("a", spans[0][1], -2), ("a", spans[0][1], -2)]
    got = align.in_intervals(spark.createDataFrame(points, "s string, t double, i int"), spark.createDataFrame(spans, "s string, start double, end double"), ["s"], "t", "start", "end", 10.0).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.inside == (r.t is not None and any(s == r.s and a <= r.t < b for s, a, b in spans))


def test_scalar_rules(spark):
    texts = [("90", 90.0), (".5", 0.5), ("1e3", 1000.0), ("5.", 5.0), ("1h02m03.5s", 3723.5), ("-1", None), ("1x", None), ("", None), ("h", None), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", scalars.seconds(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == dict(texts)
    texts = [('{"a": 1}', 1), ('{"a":1} trailing', None), ('{"a": 1}, {"a": 2}', None), ('{"a": 1, "b": 2}', None), ('{"b": 1}', None), ('{"a": "x"}', None), ('{"a": null}', None), ("[1]", None), ("{", None), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", scalars.strict_json(F.col("t"), {"a": "bigint"})["a"].alias("x")).collect()
    assert {r.t: r.x for r in got} == dict(texts)
    ids = [("one", True), ("Untouched-3", True), ("two", False), (None, False)]
    got = spark.createDataFrame([(t,) for t, _ in ids], "t string").select("t", scalars.embargoed(F.col("t"), ["one"], "untouched").alias("x")).collect()
    assert {r.t: r.x for r in got} == dict(ids)


def test_matched_events_of_a_long_stream(spark):
    """A million events of one stream; every true event at 10 i meets the predicted one at 10 i + 2."""
    n = 500_000
    true = spark.range(n).select(F.lit("a").alias("s"), (F.col("id") * 10).alias("t"))
    predicted = true.select("s", (F.col("t") + 2).alias("t"))
    began = time.time()
    assert [tuple(r) for r in align.matched_events(true, predicted, ["s"], "t", 3).collect()] == [("a", n, n, n)]
    assert [tuple(r) for r in align.matched_events(true, predicted, ["s"], "t", 1).collect()] == [("a", n, n, 0)]
    assert time.time() - began < 60


def test_matched_events_against_two_pointers(spark):
    draw = random.Random(9)
    streams = {f"s{i}": [sorted(draw.sample(range(60), draw.randrange(1, 30))) for _ in range(2)] for i in range(40)}
    true, predicted = (spark.createDataFrame([(s, t) for s, lists in streams.items() for t in lists[side]] + [("s0", None)], "s string, t long") for side in (0, 1))
    for collar in (1, 2, 5):
        want = {}
        for s, (a, b) in streams.items():
            i = j = met = 0
            while i < len(a) and j < len(b):
                if abs(a[i] - b[j]) <= collar:
                    i, j, met = i + 1, j + 1, met + 1
                elif a[i] < b[j]:
                    i += 1
                else:
                    j += 1
            want[s] = (len(a) + (s == "s0"), len(b) + (s == "s0"), met)
        found = align.matched_events(true, predicted, ["s"], "t", collar).collect()
        assert {r["s"]: (r["n_true"], r["n_pred"], r["n_matched"]) for r in found} == want


def test_ranked_references_against_a_loop(spark):
    draw = random.Random(10)
    vectors = {i: [draw.choice([-1.0, 0.5, 2.0]) for _ in range(4)] for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "i long, v array<double>")
    found = align.ranked_references(df.where("i % 10 = 0").withColumnRenamed("i", "c"), df.withColumnRenamed("i", "r"), "c", "r", "v", 5)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for c in range(0, 60, 10):
        near = sorted((-round(dot(vectors[c], v) / (dot(v, v) * dot(vectors[c], vectors[c])) ** 0.5, 6), r) for r, v in vectors.items() if r != c)[:5]
        assert [(-r["similarity"], r["r"]) for r in found.where(F.col("c") == c).orderBy("rank").collect()] == near


def test_split_latch_equals_latch(spark):
    """Ranges of long streams, cut anywhere, and segments with carried states, give the latch of the whole stream."""
    draw = random.Random(5)
    level = [None, 0.0, 0.05, 0.3, 0.5, 0.7, 0.95, 1.0]
    rows = [(s, i, *(draw.choice(level) for _ in range(3))) for s, n in (("a", 3000), ("b", 40), (None, 500), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, pos int, p double, o double, r double")
    want = Counter(tuple(x) for x in sequence.latch(df, ["s"], "pos", "p", "o", "r", patience=2).collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sequence.split_latch(df, ["s"], "pos", "p", "o", "r", patience=2)
        assert Counter((x.s, x.pos, x.held) for x in got.collect()) == want
        first = sequence.split_latch(df.where("pos < 777 AND s IS NOT NULL"), ["s"], "pos", "p", "o", "r", patience=2)
        second = sequence.split_latch(df.where("pos >= 777 AND s IS NOT NULL"), ["s"], "pos", "p", "o", "r", patience=2, carry=sequence.carried_states(first, ["s"], "pos"))
        assert Counter((x.s, x.pos, x.held) for x in first.union(second).collect()) == Counter({k: n for k, n in want.items() if k[0] is not None})
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_split_latch_deals_one_stream_to_many_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("a").alias("s"), F.col("id").alias("pos"), F.lit(0.5).alias("p"), (F.col("id") % 10 == 3).cast("double").alias("o"), (F.col("id") % 10 == 7).cast("double").alias("r"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sequence.split_latch(df, ["s"], "pos", "p", "o", "r")
        tasks = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.col("held").cast("int")).alias("held")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(tasks) >= 4 and max(t.n for t in tasks) < n / 2 and sum(t.held for t in tasks) == 7 + (n // 10 - 1) * 4
