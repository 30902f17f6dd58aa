"""Exact nearest neighbours by cosine in blocks, of which groups meet, pruned by distances to pivots.

Vectors become unit vectors. A few pivots (the rows of the smallest hashes) are known everywhere; a row's distances to
them bound its distance to any other row from below, by the triangle inequality. Rows are dealt by ranges of (nearest pivot,
distance to it) into blocks, so that blocks are compact. Every block finds neighbours within itself first. Then blocks in order
form groups, a task holds one group, and the blocks that some row of it may still need pass by; a block is compared only with
those rows for which the least distance that its ranges of pivot distances allow is within what the row has found so far. No pairs
of rows are put out, only each row's best of a task.

What is shuffled is GROUPS + PARTS times the vectors, whatever their number, up to GROUPS * GROUP_BLOCKS * block rows (a million);
beyond, groups stay as large as one task should hold and their number grows. What is compared depends on how well the vectors cluster, and is
the square of their number at worst, in matrix products spread over GROUPS * PARTS tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cut

#: Slack of bounds, far above rounding; similarities are told apart by nine digits.
SLACK, DIGITS = 1e-4, 9
#: Groups of blocks, blocks of a group at most, and tasks that share the blocks passing by a group.
GROUPS, GROUP_BLOCKS, PARTS = 16, 128, 4


def _best(own: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of own its largest similarity and the smallest id that has it, its own id apart."""
    similar = own @ others.T
    if ids.min() <= other_ids.max() and other_ids.min() <= ids.max():
        similar[ids[:, None] == other_ids[None, :]] = -2.0
    # Only what may round to the top is rounded.
    row, at = np.nonzero(similar >= (similar.max(axis=1, initial=-2.0) - 10.0**-DIGITS)[:, None])
    near = np.round(similar[row, at], DIGITS)
    top = np.full(len(own), -2.0)
    np.maximum.at(top, row, near)
    best = near == top[row]
    other = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(other, row[best], other_ids[at[best]])
    return top, other


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * similarity))


def nearest_neighbours(df: DataFrame, ident: str, vector: str, pivots: int = 16, block: int = 512) -> DataFrame:
    """ident, neighbour, similarity (nine digits), compared (rows it was compared with): the nearest other row of every row, the
    smallest id on ties. ident is a whole number, unique; vectors are of one length. Rows with a NULL or zero vector are left
    out. A single row has no neighbour and isn't returned."""
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = df.select(F.col(ident).cast("long").alias("id"), numbers.alias("v")).withColumn("size", size).where("id IS NOT NULL AND size > 0").select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"))
    chosen = np.array([r.v for r in unit.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(pivots).collect()], float)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").to_pylist(), float)
            far = _distance(v @ chosen.T)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in far], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far.min(axis=1))],
                names=["id", "v", "far", "cell", "near"],
            )

    placed = unit.mapInArrow(place, "id long, v binary, far binary, cell int, near double")
    dealt = placed.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id").withColumn("range", F.spark_partition_id())

    def build(batches):
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                ids = some.column("id").to_numpy()
                v, far = (np.frombuffer(b"".join(some.column(c).to_pylist())).reshape(len(ids), -1) for c in ("v", "far"))
                top, other = _best(v, ids, v, ids)
                need = _distance(np.where(top > -2, top, -1.0)) + SLACK
                number += 1
                columns = [[(some.column("range")[0].as_py() << 32) + number], *[[x.tobytes()] for x in (ids, v, far, top, other, need)], [far.min(axis=0).tolist()], [far.max(axis=0).tolist()], [float(need.max())]]
                kinds = [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "ids", "v", "far", "top", "other", "need", "low", "high", "reach"])

    blocks = cut(dealt.mapInArrow(build, "block long, ids binary, v binary, far binary, top binary, other binary, need binary, low array<double>, high array<double>, reach double"))
    out = "id long, neighbour long, similarity double, compared long"

    def within(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, top, other = (np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("top", float), ("other", np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(other), pa.array(top), pa.array(np.full(len(ids), len(ids) - 1))], names=["id", "neighbour", "similarity", "compared"])

    def across(batches):
        held = None  # (group, part), and what is known of the group's rows

        def told():
            if held and not held["joining"] and (asked := held["compared"] > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(held[c][asked]) for c in ("ids", "other", "top", "compared")], names=["id", "neighbour", "similarity", "compared"])

        for batch in batches:
            for row in batch.to_pylist():
                key, ids = (row["group"], row["part"]), np.frombuffer(row["ids"], np.int64)
                v = np.frombuffer(row["v"]).reshape(len(ids), -1)
                if held is None or held["key"] != key:
                    yield from told()
                    held = {"key": key, "joining": []}
                if not row["passing"]:
                    far, need = np.frombuffer(row["far"]).reshape(len(ids), -1), np.frombuffer(row["need"])
                    held["joining"].append((ids, v, far, need, np.full(len(ids), row["block"])))
                    continue
                if held["joining"]:
                    held |= {c: np.concatenate(x) for c, x in zip(("ids", "v", "far", "need", "block"), zip(*held["joining"], strict=True), strict=True)}
                    held |= {"joining": [], "top": np.full(len(held["ids"]), -2.0), "other": np.full(len(held["ids"]), np.iinfo(np.int64).max), "compared": np.zeros(len(held["ids"]), np.int64)}
                low, high = np.array(row["low"]), np.array(row["high"])
                asks = np.nonzero((np.maximum(low - held["far"], held["far"] - high).max(axis=1) <= held["need"]) & (held["block"] != row["block"]))[0]
                for at in range(0, len(asks), 4096):
                    some = asks[at : at + 4096]
                    top, other = _best(held["v"][some], held["ids"][some], v, ids)
                    better = (top > held["top"][some]) | ((top == held["top"][some]) & (other < held["other"][some]))
                    held["top"][some[better]], held["other"][some[better]] = top[better], other[better]
                    held["need"][some] = np.minimum(held["need"][some], _distance(top) + SLACK)
                    held["compared"][some] += len(ids)
        yield from told()

    narrow = blocks.select("block", "low", "high", "reach")
    many = narrow.count()
    groups = max(min(GROUPS, many), -(-many // GROUP_BLOCKS))
    # A row a block; their order puts compact groups side by side.
    number = (F.row_number().over(Window.orderBy("block")) - 1).cast("long")
    grouped = narrow.withColumn("group", F.floor(number * groups / max(many, 1)).cast("int"))
    each = range(len(chosen))
    boxes = grouped.groupBy("group").agg(F.array(*[F.min(F.get("low", F.lit(i))) for i in each]).alias("g_low"), F.array(*[F.max(F.get("high", F.lit(i))) for i in each]).alias("g_high"), F.max("reach").alias("g_reach"))
    gap = F.array_max(F.zip_with(F.zip_with("low", "g_high", lambda a, b: a - b), F.zip_with("g_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    sides = ["group", "part", "passing", "block", "ids", "v", "far", "need", "low", "high"]
    holding = blocks.join(F.broadcast(grouped.select("block", "group")), "block").withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)]))).withColumn("passing", F.lit(False))
    passing = blocks.join(F.broadcast(boxes), gap <= F.col("g_reach")).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int")).withColumn("passing", F.lit(True))
    none = F.lit(None).cast("binary")
    met = holding.select(sides).unionByName(passing.withColumns({"far": none, "need": none}).select(sides)).repartition(max(groups, 1) * PARTS, "group", "part").sortWithinPartitions("group", "part", "passing", "block")
    found = blocks.mapInArrow(within, out).unionByName(met.mapInArrow(across, out))
    best = F.max_by("neighbour", F.struct("similarity", -F.col("neighbour")))
    return found.groupBy("id").agg(best.alias("neighbour"), F.max("similarity").alias("similarity"), F.sum("compared").alias("compared")).where("similarity > -2").withColumnRenamed("id", ident)


def neighbour_uniqueness(neighbours: DataFrame) -> DataFrame:
    """n, unique (distinct neighbours as a share of n; near 0 where a few rows are near to all)."""
    return neighbours.agg(F.count("*").alias("n"), F.try_divide(F.count_distinct("neighbour"), F.count("*")).alias("unique"))
