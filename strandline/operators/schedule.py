"""Schedules of draws that can be computed for any range of steps on its own: permutations without a sort, weighted
source plans of bounded error, exact mixtures of pools that cycle at their own pace, and receipts.

Sources, cells and cycles are declared and few; items are any table. Items are numbered once in their
bucket by ranges; a draw then finds its item by a join on (bucket, number), which spreads evenly.
"""

from __future__ import annotations

import hashlib
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import numbered


def seed_of(*parts) -> int:
    """A number of 60 bits from the parts."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def seed_column(*parts: Column) -> Column:
    """seed_of() of columns."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def coprime_stride(seed: int, size: int) -> int:
    """The first number from 1 + seed % size on that shares no factor with size (wrapping to 1); 0 for a size of 1."""
    if size == 1:
        return 0
    return next(c for i in range(size) if gcd(c := 1 + (seed + i) % size, size) == 1)


def permuted(place: Column, offset: Column, stride: Column, size: Column) -> Column:
    """Number place of a permutation of 0 .. size - 1. Exact for sizes below 2 ** 31."""
    return (offset + (place % size) * stride) % size


def weighted_plan(weights: dict[str, int], salt: str) -> list[tuple[str, int, int]]:
    """(source, draws of it before this one, its weight) for one period of sum(weights) draws.

    Each draw goes to the source that is furthest behind its share, ties in salted order. After a
    period all shares are met exactly, so the endless sequence repeats it and no source is ever a whole draw off."""
    if not weights or min(weights.values()) < 1:
        raise ValueError("weights must be positive whole numbers")
    total, counts, plan = sum(weights.values()), dict.fromkeys(weights, 0), []
    first = sorted(weights, key=lambda s: seed_of(salt, "tie", s), reverse=True)
    for n in range(1, total + 1):
        source = max(first, key=lambda s: (n * weights[s] - total * counts[s], first.index(s)))
        plan.append((source, counts[source], weights[source]))
        counts[source] += 1
    return plan


def dealt_sequence(items: DataFrame, order: str, weights: dict[str, int], salt: str, source: str = "source") -> DataFrame:
    """items, turn and source: rows in order of a number take the draws of weighted_plan(), period after period. Each turn finds its
    source by its place in the period, so a sequence of any length is made by as many tasks as its rows fill."""
    total = sum(weights.values())
    plan = items.sparkSession.createDataFrame([(i, s) for i, (s, _, _) in enumerate(weighted_plan(weights, salt))], f"__turn long, `{source}` string")
    turns = numbered(items, [], order, "turn").withColumn("__turn", F.col("turn") % total)
    return turns.join(F.broadcast(plan), "__turn").drop("__turn")


def counter_schedule(items: DataFrame, cell: str, source: str, ident: str, weights: dict[str, int], quota: int, first: int, last: int, salt: str) -> DataFrame:
    """step, cell, slot, source, draw, ident for steps first .. last - 1: quota draws of every cell in every step, sources in
    each cell by weighted_plan(), items of each (cell, source) by a permutation with coprime stride, again and again.

    Everything is a function of the step, so any range of steps equals that range of the whole. ident is a number."""
    sizes = {(r[0], r[1]): r[2] for r in items.groupBy(cell, source).count().collect()}  # declared buckets
    cells = sorted({c for c, _ in sizes})
    empty = [(c, s) for c in cells for s in weights if (c, s) not in sizes]
    if empty:
        raise ValueError(f"no items in {empty}")
    total = sum(weights.values())
    plan = []
    for c in cells:
        for turn, (s, before, weight) in enumerate(weighted_plan(weights, f"{salt}:{c}")):
            size, seed = sizes[c, s], f"{salt}:{c}:{s}"
            plan.append((c, turn, s, before, weight, size, seed_of(seed, "offset") % size, coprime_stride(seed_of(seed, "stride"), size)))
    spark = items.sparkSession
    kinds = {n: items.schema[n].dataType.simpleString() for n in (cell, source)}
    table = spark.createDataFrame(plan, f"`{cell}` {kinds[cell]}, __turn long, `{source}` {kinds[source]}, __before long, __weight long, __size long, __offset long, __stride long")
    draws = spark.range(first * quota, last * quota).select(F.col("id").alias("__id"), (F.col("id") % total).alias("__turn"))
    taken = draws.join(F.broadcast(table), "__turn").withColumn("draw", F.floor(F.col("__id") / total) * F.col("__weight") + F.col("__before"))
    taken = taken.withColumn("__n", permuted(F.col("draw"), F.col("__offset"), F.col("__stride"), F.col("__size")))
    rows = numbered(items.select(cell, source, ident), [cell, source], ident, "__n")
    return taken.join(rows, [cell, source, "__n"]).select(F.floor(F.col("__id") / quota).alias("step"), cell, (F.col("__id") % quota).alias("slot"), source, "draw", ident)


def mixture(items: DataFrame, source: str, ident: str, cycle: list[dict[str, int]], first: int, last: int, salt: str, strides: int = 8) -> DataFrame:
    """step, slot, source, draw, pass, ident for steps first .. last - 1: in step t exactly cycle[t % len(cycle)][source] items of
    each source. A pool gives each item once a pass, in an order of that pass, and starts again when it is used up.

    The step is the cursor: to resume, ask for the steps from there on. ident is a number, unique in its source."""
    names = sorted({s for row in cycle for s in row})
    if any(set(row) != set(names) or min(row.values()) < 0 for row in cycle):
        raise ValueError("every step names every source with a count")
    if len({sum(row.values()) for row in cycle}) != 1:
        raise ValueError("steps differ in size")
    sizes = {r[0]: r[1] for r in items.groupBy(source).count().collect()}  # declared sources
    if missing := [s for s in names if not sizes.get(s) or not sum(row[s] for row in cycle)]:
        raise ValueError(f"sources without items or draws: {missing}")
    plan = []
    for turn, row in enumerate(cycle):
        slot = 0
        for s in names:
            steps = [coprime_stride(seed_of(salt, s, "stride", i), sizes[s]) for i in range(strides)]
            plan.append((turn, s, row[s], slot, sum(r[s] for r in cycle[:turn]), sum(r[s] for r in cycle), sizes[s], steps))
            slot += row[s]
    spark = items.sparkSession
    table = spark.createDataFrame(plan, f"__turn long, `{source}` {items.schema[source].dataType.simpleString()}, __count long, __slot long, __before long, __all long, __size long, __strides array<long>")
    steps = spark.range(first, last).select(F.col("id").alias("__id"), (F.col("id") % len(cycle)).alias("__turn")).join(F.broadcast(table.where("__count > 0")), "__turn")
    drawn = steps.withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1)))
    drawn = drawn.withColumn("draw", F.floor(F.col("__id") / len(cycle)) * F.col("__all") + F.col("__before") + F.col("__j")).withColumn("pass", F.floor(F.col("draw") / F.col("__size")))
    of_pass = lambda what: seed_column(F.lit(salt), F.col(source), F.lit(what), F.col("pass"))
    stride = F.get("__strides", (of_pass("which") % strides).cast("int"))
    drawn = drawn.withColumn("__n", permuted(F.col("draw"), of_pass("offset") % F.col("__size"), stride, F.col("__size")))
    rows = numbered(items.select(source, ident), [source], ident, "__n")
    return drawn.join(rows, [source, "__n"]).select(F.col("__id").alias("step"), (F.col("__slot") + F.col("__j")).alias("slot"), source, "draw", "pass", ident)


def mixture_receipt(items: DataFrame, draws: DataFrame, source: str, ident: str, cycle: list[dict[str, int]], steps: int) -> DataFrame:
    """source, items, scheduled, actual, unique_items, repeats, passes, least, most, complete: what draws took from each pool,
    counted from the draws themselves. complete: as many as the cycle schedules, and no item twice more often than another."""
    wanted = [(s, steps // len(cycle) * sum(r[s] for r in cycle) + sum(r[s] for r in cycle[: steps % len(cycle)])) for s in sorted(cycle[0])]
    scheduled = items.sparkSession.createDataFrame(wanted, f"`{source}` {items.schema[source].dataType.simpleString()}, scheduled long")
    taken = draws.groupBy(source, ident).agg(F.count("*").alias("__n"))
    each = items.select(source, ident).join(taken, [source, ident], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    facts = each.groupBy(source).agg(F.count("*").alias("items"), F.sum("__n").alias("actual"), F.sum((F.col("__n") > 0).cast("long")).alias("unique_items"), F.min("__n").alias("least"), F.max("__n").alias("most"))
    told = facts.join(F.broadcast(scheduled), source)
    return told.select(
        source, "items", "scheduled", "actual", "unique_items", (F.col("actual") - F.col("unique_items")).alias("repeats"), F.floor(F.col("actual") / F.col("items")).alias("passes"), "least", "most",
        ((F.col("actual") == F.col("scheduled")) & (F.col("most") - F.col("least") <= 1)).alias("complete"),
    )
