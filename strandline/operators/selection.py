"""Filters, top rows, set checks, samples and allocations.

Sequential ones (balanced, mixed_sequence, nearest_sum) fold over a whole group, so a group is a pool of
units to be dealt (files, sources), not of rows; all others work row by row, by shuffle or by window.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.scalars import salted_key
from .ranges import cut, exact_quantiles, over_ranges


def four_directions(x: Column, y: Column, pads: dict[str, Column], limit: float) -> dict[str, Column]:
    """left, right, up, down: a pad button or a stick strictly beyond the limit."""
    stick = {"left": x < -limit, "right": x > limit, "up": y < -limit, "down": y > limit}
    return {name: pads[name] | beyond for name, beyond in stick.items()}


def bound_actions(long: DataFrame, binds: DataFrame, rows: list[str], group: str, button: str, pressed: str, action: str) -> DataFrame:
    """rows, action, held: whether any button bound to the action in the row's group is pressed; an action without a
    button is never held. binds: (group, action, button), button NULL for an action without one."""
    wanted = binds.select(group, action).distinct()
    frames = long.select(group, *rows).distinct().join(wanted, group)
    held = long.where(pressed).join(binds, [group, button]).select(group, *rows, action).distinct().withColumn("held", F.lit(True))
    return frames.join(held, [group, *rows, action], "left").select(group, *rows, action, F.coalesce("held", F.lit(False)).alias("held"))


def above_thresholds(df: DataFrame, thresholds: DataFrame, key: str, p: str, threshold: str, default: float) -> DataFrame:
    """df and predicted: p >= the key's threshold, or the default's."""
    return df.join(thresholds.select(key, F.col(threshold).alias("__t")), key, "left").withColumn("predicted", F.col(p) >= F.coalesce("__t", F.lit(default))).drop("__t")


def usable_rows(df: DataFrame, status: str, duplicate: str, numbers: list[str]) -> DataFrame:
    """The rows of status ok that repeat no other and hold none of the sentinels (NULL or NaN) in their numbers."""
    whole = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in numbers]
    return df.where(reduce(lambda a, b: a & b, whole, (F.col(status) == "ok") & ~F.coalesce(F.col(duplicate), F.lit(False))))


def near_activity(df: DataFrame, part: list[str], pos: str, flag: str, radius: int) -> DataFrame:
    """df and near: whether a row within radius rows has the flag."""
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(-radius, radius)
    return df.withColumn("near", F.coalesce(F.max(F.col(flag)).over(w), F.lit(False)))


def cascade(rules: list[tuple[Column, str]], default: str) -> Column:
    """The class of the first rule that holds."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def failures(rules: dict[str, Column]) -> Column:
    """The names of all rules that fail; a rule that is NULL fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def only_value(column: str, prefix: str = "mixed:") -> Column:
    """A group's single value, or the prefix and its sorted values."""
    values = F.array_sort(F.collect_set(column))
    return F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit(prefix), F.array_join(values, ",")))


def first_valid(df: DataFrame, by: list[str], attempt: str, valid: str, value: str) -> DataFrame:
    """by, attempt, value: the first valid attempt, else the first one."""
    order = F.struct((~F.coalesce(F.col(valid), F.lit(False))).alias("bad"), F.col(attempt))
    return df.groupBy(*by).agg(F.min_by(F.struct(attempt, value), order).alias("x")).select(*by, f"x.{attempt}", f"x.{value}")


def sets_of_actions(df: DataFrame, part: list[str], pos: str, actions: list[str]) -> DataFrame:
    """df and kind: none, solo or several actions at the row."""
    n = sum((F.coalesce(F.col(a), F.lit(False)).cast("int") for a in actions), F.lit(0))
    return df.withColumn("kind", F.when(n == 0, "none").when(n == 1, "solo").otherwise("several"))


def top_row(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in an order without ties. The planner keeps n rows a group in each task before
    the shuffle, so a hot group moves n rows a task."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def until_weight(df: DataFrame, part: list[str], order: list[Column], weight: str, target: float) -> DataFrame:
    """The rows of each part up to and with the one that reaches the target."""
    before = F.sum(weight).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__b", F.coalesce(before, F.lit(0))).where(F.col("__b") < target).drop("__b")


def typical_rows(df: DataFrame, by: list[str], value: str, ident: str) -> DataFrame:
    """by, ident: the row nearest to its group's median, the smallest id on ties."""
    middle = exact_quantiles(df, by, value, {"__m": 0.5})
    near = F.struct(F.abs(F.col(value) - F.col("__m")).alias("d"), F.col(ident))
    return df.join(middle, by).groupBy(*by).agg(F.min_by(ident, near).alias(ident))


def spread_positions(count: Column, picks: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Sorted positions (from 0) of up to picks rows between two fractions of count, half-even rounding."""
    step = (high - low) / max(picks - 1, 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda i: F.bround((F.lit(low) + i * step) * (count - 1)).cast("long"))
    return F.when(count <= picks, F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).otherwise(F.array_distinct(at))


def spread_rows(df: DataFrame, by: list[str], order: str, picks: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Evenly spread rows of each group in an order without ties.

    Rows are dealt by ranges of (by, order) and written once, so give them narrow. From the number of each group's rows in each
    range follows in which one a wanted position lies, and only those ranges are numbered; no group is one task's work."""
    ranged = cut(df.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__m"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__n", F.sum("__m").over(group))
    wanted = counts.select(*by, "__range", "__before", "__m", F.explode(spread_positions(F.col("__n"), picks, low, high)).alias("__p")).where("__p >= __before AND __p < __before + __m")
    near = ranged.join(F.broadcast(wanted.groupBy(*by, "__range").agg(F.collect_set(F.col("__p") - F.col("__before")).alias("__own"))), [*by, "__range"])
    at = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order)) - 1
    return near.withColumn("__at", at.cast("long")).where(F.array_contains("__own", F.col("__at"))).select(*df.columns)


def merged_identical(frames: list[DataFrame], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Union with identical rows collapsed, and the keys that have rows that differ."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    rows = every.distinct()
    conflicts = rows.groupBy(*key).agg(F.count("*").alias("versions")).where("versions > 1")
    return rows.join(conflicts, key, "left_anti"), conflicts


def coverage(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """key, problem: keys that are missing, unexpected or repeated among those found."""
    counted = found.groupBy(*key).agg(F.count("*").alias("__n"))
    both = expected.select(*key).distinct().withColumn("__e", F.lit(True)).join(counted, key, "full")
    problem = F.when(F.col("__n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__n") > 1, "repeated")
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")


def partition_proof(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row: shared (keys in several parts), lost and foreign keys; all zero if the parts are a partition."""
    tagged = whole.select(key, F.lit(-1).alias("part"))
    for number, part in enumerate(parts):
        tagged = tagged.unionByName(part.select(key, F.lit(number).alias("part")))
    seen = tagged.groupBy(key).agg(F.max(F.col("part") == -1).alias("w"), F.countDistinct(F.when(F.col("part") >= 0, F.col("part"))).alias("n"))
    one = F.lit(1)
    return seen.agg(F.count(F.when(F.col("n") > 1, one)).alias("shared"), F.count(F.when(F.col("n") == 0, one)).alias("lost"), F.count(F.when(~F.col("w"), one)).alias("foreign"))


def balanced(df: DataFrame, pool: list[str], ident: str, weight: str, shards: int, retry: str | None = None, loads: DataFrame | None = None) -> DataFrame:
    """pool, ident, shard: units dealt longest first to the least loaded shard, the lowest one on ties.

    Units with a retry (an order) come last, in that order, each to another shard: a pool with more of them than shards
    raises. loads (pool, shard, weight) are what shards hold before; a pool is folded in one task by a heap, in
    time n log n: it lists units to schedule. Weights are numbers without NULLs."""
    columns = [F.col(ident).alias("id"), F.col(weight).alias("w"), (F.col(retry).cast("long") if retry else F.lit(None).cast("long")).alias("retry"), F.lit(None).cast("int").alias("held")]
    units = df.select(*pool, *columns)
    if loads is not None:
        held = loads.select(*pool, F.lit(None).cast(df.schema[ident].dataType).alias("id"), F.col(weight).cast(df.schema[weight].dataType).alias("w"), F.lit(None).cast("long").alias("retry"), F.col("shard").cast("int").alias("held"))
        units = units.unionByName(held)
    keys = StructType([df.schema[k] for k in pool])
    out = StructType([*keys.fields, StructField(ident, df.schema[ident].dataType), StructField("shard", IntegerType())])

    def deal(frame):
        given, load = frame["held"].notna(), [0] * shards
        for shard, w in zip(frame.loc[given, "held"].astype(int), frame.loc[given, "w"], strict=True):
            load[shard] += w
        rows, again = frame[~given & frame["retry"].isna()], frame[~given & frame["retry"].notna()]
        rows, again = rows.sort_values(["w", "id"], ascending=[False, True]), again.sort_values(["retry", "id"])
        if len(again) > shards:
            raise ValueError("more retries than shards")
        heap, picks = [(w, s) for s, w in enumerate(load)], []
        heapq.heapify(heap)
        for w in rows["w"]:
            held, shard = heap[0]
            heapq.heapreplace(heap, (held + w, shard))
            picks.append(shard)
        picks += [heapq.heappop(heap)[1] for _ in range(len(again))]
        done = pd.concat([rows, again])
        return pd.DataFrame({**{k: done[k] for k in pool}, ident: done["id"], "shard": pd.Series(picks, index=done.index, dtype="int32")})

    return units.groupBy(*pool).applyInPandas(deal, out)


def proportional(df: DataFrame, by: list[str], count: str, total: int) -> DataFrame:
    """by, allocated: total dealt in proportion to count by largest remainders (ties: first by); exact, in integers."""
    everything = df.crossJoin(F.broadcast(df.agg(F.sum(count).alias("__all"))))
    share = F.lit(total).cast("decimal(38,0)") * F.col(count)
    floors = everything.withColumn("__f", F.floor(share / F.col("__all")).cast("long")).withColumn("__rest", (share - F.col("__f") * F.col("__all")).cast("decimal(38,0)"))
    left = floors.agg((F.lit(total) - F.sum("__f")).alias("__left"))

    def count(rows):
        return sum(1 for _ in rows)

    def number(key, state, rows):
        for at, row in enumerate(rows, (state or 0) + 1):
            yield (*row[1 : 1 + len(by)], row[-1], at)

    # Remainders are ranked in ranges, each counted first, so no task sorts all groups.
    fields = [df.schema[c] for c in by] + [StructField("__f", LongType()), StructField("__r", LongType())]
    ranked = over_ranges(floors.withColumn("__least", -F.col("__rest")), [], ["__least", *by], ["__f"], None, count, lambda state, n: (state or 0) + n, number, StructType(fields))
    return ranked.crossJoin(F.broadcast(left)).select(*by, (F.col("__f") + F.when(F.col("__r") <= F.col("__left"), 1).otherwise(0)).alias("allocated"))


def systematic(df: DataFrame, by: list[str], order: str, every: int, phase: int) -> DataFrame:
    """Every so manieth row of each group's order, from the phase on."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return df.withColumn("__p", at).where(F.col("__p") % every == phase).drop("__p")


def mixed_sequence(weights: DataFrame, pool: list[str], source: str, weight: str, length: int) -> DataFrame:
    """pool, turn, source: at each turn the source with the largest deficit against its weight, the first name on
    ties. Weights are whole numbers; a pool holds the sources of one mixture."""
    sources = weights.groupBy(*pool).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("name"), F.col(weight).cast("long").alias("w")))).alias("src"), F.sum(weight).cast("long").alias("all"))
    begin = F.struct(F.transform("src", lambda s: F.lit(0).cast("long")).alias("used"), F.array().cast("array<int>").alias("out"))

    def turn(acc: Column, t: Column) -> Column:
        lack = F.zip_with(F.col("src"), acc["used"], lambda s, u: s["w"] * (t + 1) - u * F.col("all"))
        pick = F.array_position(lack, F.array_max(lack)).cast("int") - 1
        used = F.transform(acc["used"], lambda u, i: F.when(i == pick, u + 1).otherwise(u))
        return F.struct(used.alias("used"), F.array_append(acc["out"], pick).alias("out"))

    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long")), begin, turn, lambda acc: acc["out"])
    out = sources.select(*pool, "src", F.posexplode(picks).alias("turn", "pick"))
    return out.select(*pool, F.col("turn").cast("long").alias("turn"), F.col("src")[F.col("pick")]["name"].alias(source))


def hashed_sample(df: DataFrame, by: list[str], ident: str, salt: str, n: int) -> DataFrame:
    """n rows of each group without replacement, the same ones for the same salt."""
    return top_row(df.withColumn("__h", salted_key(F.col(ident), salt)), by, [F.col("__h"), F.col(ident)], n).drop("__h")


def fold_of(group: Column, salt: str, folds: int) -> Column:
    """A fold from the group's hash, so that rows of one group never part."""
    return F.conv(F.substring(salted_key(group, salt), 1, 8), 16, 10).cast("long") % folds


def ranked_batches(df: DataFrame, ident: str, salt: str, batch: int, ranks: int) -> DataFrame:
    """df, batch, rank: rows dealt to batches by their hashed order inside hashed slices, so that no task sorts all:
    each slice is a rank's own sequence."""
    out = df.withColumn("rank", fold_of(F.col(ident), salt, ranks)).withColumn("__h", salted_key(F.col(ident), salt))
    at = F.row_number().over(Window.partitionBy("rank").orderBy("__h", ident)) - 1
    return out.withColumn("batch", F.floor(at / batch).cast("long")).drop("__h")


def gated_events(df: DataFrame, events: DataFrame, part: list[str], pos: str, active: str) -> DataFrame:
    """Events whose row is active. Events are found on all rows first: dropping rows before would make new ones."""
    return events.join(df.where(active).select(*part, pos), [*part, pos], "left_semi")


def key_problems(mapping: Column, wanted: list[str]) -> Column:
    """The sorted keys that a map lacks or has beyond those wanted; empty if it has exactly these. NULL lacks all."""
    keys, want = F.coalesce(F.map_keys(mapping), F.array().cast("array<string>")), F.array(*map(F.lit, wanted))
    return F.array_sort(F.concat(F.array_except(want, keys), F.array_except(keys, want)))


def stratified_panel(df: DataFrame, strata: list[str], ident: str, salt: str, quota: int) -> DataFrame:
    """df and turn: quota rows of each stratum in hashed order, dealt so that each turn holds one row of each stratum.
    A stratum of fewer rows starts again with its first row until its quota is full."""
    w = Window.partitionBy(*strata).orderBy("__h", ident)
    ranked = top_row(df.withColumn("__h", salted_key(F.col(ident), salt)), strata, [F.col("__h"), F.col(ident)], quota).withColumn("__p", F.row_number().over(w) - 1)
    n = F.count("*").over(Window.partitionBy(*strata))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(quota) - 1 - F.col("__p")) / F.col("__n")).cast("long")), lambda c: F.col("__p") + c * F.col("__n"))
    return ranked.withColumn("__n", n).withColumn("turn", F.explode(turns)).drop("__h", "__p", "__n")


def cycled(df: DataFrame, pool: list[str], ident: str, salt: str, draws: int) -> DataFrame:
    """pool, draw, pass, ident: draws from each pool, every row once a pass and each pass in an order of its own."""
    n = df.groupBy(*pool).agg(F.count("*").alias("__n"))
    passes = n.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(draws) - 1) / F.col("__n")).cast("long"))))
    order = Window.partitionBy(*pool, "pass").orderBy(F.sha2(F.concat(F.lit(salt), F.char(F.lit(0)), F.col("pass").cast("string"), F.char(F.lit(0)), F.col(ident).cast("string")), 256), ident)
    dealt = df.select(*pool, ident).join(passes, pool).withColumn("draw", F.row_number().over(order) - 1 + F.col("pass") * F.col("__n"))
    return dealt.where(F.col("draw") < draws).select(*pool, "draw", "pass", ident)


def eligible(df: DataFrame, count: str, rate: str, floors: dict[str, tuple[int, float]], shapes: dict[str, Column]) -> DataFrame:
    """df and action: a row for each action that the candidate may serve: its count and its hourly rate reach the action's
    floors and its shape, where the action has one, holds (NULL doesn't)."""
    tests = [F.when((F.col(count) >= n) & (F.col(rate) >= r) & shapes.get(a, F.lit(True)), F.lit(a)) for a, (n, r) in floors.items()]
    return df.withColumn("action", F.explode(F.array_compact(F.array(*tests))))


def systematic_windows(runs: DataFrame, by: list[str], order: list[str], length: str, count: str, phase: float) -> DataFrame:
    """by, order, draw, offset: count evenly spaced places, from a phase in [0, 1), over the runs of a group laid end to end.
    Each run finds its own draws from the length before it, so nothing is joined by range. A count over the length
    raises: places would repeat."""
    w = Window.partitionBy(*by).orderBy(*order)
    laid = runs.where(F.col(length) > 0).withColumn("__end", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(length).over(Window.partitionBy(*by)))
    n = F.when(F.col(count) > F.col("__all"), F.raise_error(F.lit("more places than rows")).cast("long")).otherwise(F.col(count).cast("long"))
    laid = laid.withColumn("__n", n).withColumn("__start", F.col("__end") - F.col(length)).where("__n > 0")
    draw = lambda at: F.floor(at * F.col("__n") / F.col("__all") - phase)
    first, last = F.greatest(draw(F.col("__start")) - 1, F.lit(0)).cast("long"), F.least(draw(F.col("__end")) + 1, F.col("__n") - 1).cast("long")
    drawn = laid.withColumn("draw", F.explode(F.sequence(first, F.greatest(first, last))))
    place = F.floor((F.col("draw") + F.lit(phase)) * F.col("__all") / F.col("__n")).cast("long")
    drawn = drawn.withColumn("__place", place).where("draw < __n AND __place >= __start AND __place < __end")
    return drawn.select(*by, *order, "draw", (F.col("__place") - F.col("__start")).cast("long").alias("offset"))


def epoch_batches(df: DataFrame, ident: str, salt: str, epoch: int, batch: int, ranks: int) -> DataFrame:
    """df, step, rank: an epoch in hashed order of its own, padded from its start to whole batches, each dealt in equal
    slices to the ranks. Places are numbered inside 4,096 ranges of the hash, so no task sorts all rows."""
    if batch % ranks:
        raise ValueError("a batch must be a multiple of the ranks")
    x = df.withColumn("__h", salted_key(F.col(ident), f"{salt}:{epoch}")).withColumn("__b", F.substring("__h", 1, 3))
    counts = x.groupBy("__b").agg(F.count("*").alias("__n"))
    before = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy("__h", ident)) - 1 + F.col("__before")
    placed = x.join(F.broadcast(before), "__b").withColumn("__at", at.cast("long"))
    most = F.ceil(F.col("__all") / batch).cast("long") * batch - 1
    copies = placed.withColumn("__p", F.explode(F.sequence(F.col("__at"), most, F.col("__all"))))
    return copies.select(*df.columns, F.floor(F.col("__p") / batch).cast("long").alias("step"), F.floor(F.col("__p") % batch / (batch // ranks)).cast("int").alias("rank"))


#: No item reaches a sum.
NEVER = -2


def first_items(units: list[int]) -> np.ndarray:
    """For each sum of the positive whole units, which may each be taken once, the first item in order that reaches it; -1 for 0
    and NEVER where none does.

    Once there is a run of sums without a gap, longer than any unit, later items add sums only below and above it, and make it
    longer; so an item costs what lies outside the run and its unit, not all sums so far."""
    entered = np.full(sum(units) + 1, NEVER, np.int32)
    entered[0] = -1
    total, low, high, widest = 0, 0, -1, max(units, default=0)
    for item, w in enumerate(units):
        # The sums that are new lie from w to total + w, and outside low .. high.
        for start, end in [(w, low), (max(w, high + 1), total + w + 1)] if high >= low else [(w, total + w + 1)]:
            if start < end:
                new = (entered[start - w : end - w] > NEVER) & (entered[start:end] == NEVER)
                new = np.nonzero(new)[0] + start
                entered[new] = item
        total += w
        if high >= low:
            high += w
        elif total >= 2 * widest:
            gaps = np.concatenate(([-1], np.nonzero(entered[: total + 1] == NEVER)[0], [total + 1]))
            at = int(np.diff(gaps).argmax())
            if gaps[at + 1] - gaps[at] - 1 >= widest:
                low, high = int(gaps[at]) + 1, int(gaps[at + 1]) - 1
    return entered


def nearest_sum(df: DataFrame, by: list[str], ident: str, weight: str, target: str, salt: str) -> DataFrame:
    """by, ident: the whole items of each group whose positive integer weights add up nearest to its target. Items enter in
    salted order and the first way to reach a sum stays; of two sums as near, the smaller hash of the chosen ids
    wins. A group is a pool of items, folded in one task with one number for each reachable multiple of the
    weights' common divisor (first_items())."""
    keys = StructType([df.schema[k] for k in by])
    out = StructType([*keys.fields, df.schema[ident]])
    items = df.select(*by, F.col(ident).alias("id"), F.col(weight).cast("long").alias("w"), F.col(target).cast("double").alias("t"), salted_key(F.col(ident), salt).alias("h"))

    def choose(frame):
        frame = frame.sort_values(["h", "id"], ignore_index=True)
        unit = reduce(gcd, (int(w) for w in frame["w"]))
        units = [int(w) // unit for w in frame["w"]]
        entered = first_items(units)

        def members(total):
            while total:
                yield entered[total]
                total -= units[entered[total]]

        goal = float(frame["t"].iloc[0])
        sums = np.nonzero(entered > NEVER)[0]
        away = np.abs(sums * unit - goal)
        ids = frame["id"].astype(str).tolist()
        sets = [sorted(ids[i] for i in members(int(s))) for s in sums[away == away.min()]]
        best = set(min(sets, key=lambda ids: hashlib.sha256("\0".join([salt, *ids]).encode()).hexdigest()))
        chosen = frame[frame["id"].astype(str).isin(best)]
        return pd.DataFrame({**{k: chosen[k] for k in by}, ident: chosen["id"]})

    return items.groupBy(*by).applyInPandas(choose, out)
