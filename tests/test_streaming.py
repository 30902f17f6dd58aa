"""Streams cut into batches give what the table operators give on all rows at once."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import sequence
from strandline.plans.base import streams
from strandline.streaming import stateful, windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    df = streams(spark, SF).where("s <= 6").withColumn("o", ((F.col("i") * 37) % 100) / 100).withColumn("r", ((F.col("i") * 53) % 100) / 100)
    return df.select("s", "pos", "g", "x", "p", "o", "r").cache()


def batches(spark, df, folder, cuts=(0, 9, 31, 10**9)):
    """A stream of files: the rows of each stretch of pos, and once more those of the second."""
    for number, (a, b) in enumerate([*zip(cuts, cuts[1:]), (cuts[1], cuts[2])]):
        df.where((F.col("pos") > a) & (F.col("pos") <= b)).coalesce(1).write.json(f"{folder}/in/{number}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{folder}/in")


def run(out, folder):
    target = f"{folder}/out"
    query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    return sorted(tuple(r) for r in out.sparkSession.read.parquet(target).collect())


def test_latch(spark, rows, tmp_path):
    got = run(stateful.latch_stream(batches(spark, rows, tmp_path), "s", "pos", "p", "o", "r", on=0.8, off=0.8), tmp_path)
    assert got == sorted(tuple(r) for r in sequence.latch(rows, ["s"], "pos", "p", "o", "r", on=0.8, off=0.8).collect())


def test_transitions(spark, rows, tmp_path):
    got = run(stateful.transition_stream(batches(spark, rows, tmp_path), "s", "pos", "x"), tmp_path)
    assert got == sorted(tuple(r) for r in sequence.transitions(rows, ["s"], "pos", "x").select("s", "pos", "kind").collect())


def test_runs(spark, rows, tmp_path):
    got = run(stateful.run_stream(batches(spark, rows, tmp_path), "s", "pos", "g"), tmp_path)
    want = sequence.contiguous_runs(rows, ["s"], "pos", "g").select("s", "pos", F.col("run_id").cast("long"))
    assert got == sorted(tuple(r) for r in want.collect())


def test_late_rows_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1), (2, 1800, 1), (3, 9000, 1), (4, 9100, 1), (5, 100, 1)], "pos long, t long, k long").select("pos", F.timestamp_seconds("t").alias("ts"), "k")
    stream = batches(spark, df, tmp_path, cuts=(0, 2, 3, 4, 9))
    got = run(windows.tumbling(stream, ["k"], "ts", "1 hour", [F.count("*").alias("n")], late="10 minutes").select(F.unix_seconds("start").alias("start"), "n"), tmp_path)
    assert got == [(0, 2)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def repeats_of(frames, near):
    pairs = list(zip(frames, frames[1:]))
    run = longest = 0
    for a, b in pairs:
        run = run + 1 if a == b else 0
        longest = max(longest, run)
    gaps = [sum(abs(x - y) for x, y in zip(a, b)) / len(a) for a, b in pairs]
    return len(frames), len(pairs), sum(a == b for a, b in pairs), sum(g <= near for g in gaps), longest


@pytest.mark.parametrize("seed", [1, 2])
def test_frames_in_any_chunks(spark, tmp_path, seed):
    """Chunks late, twice and cut at random, and a restart from the checkpoint after each, give the counts of the whole stream."""
    import random

    draw = random.Random(seed)
    streams_ = {s: [[float(draw.choice([0, 0, 1])), 2.0] for _ in range(30)] for s in ("a", "b")}
    rows = [(s, i, f) for s, frames in streams_.items() for i, f in enumerate(frames)]
    chunks = []
    for s in streams_:
        cuts = sorted(draw.sample(range(1, 30), 4))
        chunks += [[r for r in rows if r[0] == s and a <= r[1] < b] for a, b in zip([0, *cuts], [*cuts, 30])]
    chunks += draw.sample(chunks, 3)
    draw.shuffle(chunks)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "s string, pos long, frame array<double>"
    seen = []
    try:
        for number, some in enumerate([chunks[:5], chunks[5:]]):  # the second query goes on from the checkpoint of the first
            for i, chunk in enumerate(some):
                spark.createDataFrame(chunk, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}-{i}")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
            out = stateful.frame_repeats(source, "s", "pos", "frame", 0.5)
            query = out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
            assert query.awaitTermination(150)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    last = {s: max(r for r in seen if r[0] == s)[1:] for s in streams_}
    assert last == {s: repeats_of(frames, 0.5) for s, frames in streams_.items()}
