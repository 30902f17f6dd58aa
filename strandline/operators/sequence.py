"""Runs, transitions and windows over ordered, gap-aware streams.

A stream is the rows of one partition key (part), in the order of a position column (pos). All ranges
are half-open. Every window here is partitioned by the stream, so a stream is one task's work; cut very
long streams by a block column in part.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import salted_key
from .ranges import cut, exact_quantiles, over_ranges


def _w(part: list[str], pos: str | list[str]):
    return Window.partitionBy(*part).orderBy(*([pos] if isinstance(pos, str) else pos))


def contiguous_runs(df: DataFrame, part: list[str], pos: str, idx: str, also: list[str] = (), out: str = "run_id") -> DataFrame:
    """A run breaks where idx doesn't step by exactly 1 (a gap, a reset or a repeat) or a column of also changes."""
    w = _w(part, pos)
    broken = F.coalesce(F.col(idx) - F.lag(idx).over(w) != 1, F.lit(True))
    for c in also:
        broken = broken | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("__b", broken.cast("long")).withColumn(out, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def active_runs(df: DataFrame, part: list[str], pos: str, idx: str, active: str, out: str = "run_id") -> DataFrame:
    """Runs that are both consecutive and active; inactive rows are dropped and break runs."""
    w = _w(part, pos)
    broken = F.coalesce((F.col(idx) - F.lag(idx).over(w) != 1) | ~F.col(active) | ~F.lag(active).over(w), F.lit(True))
    marked = df.withColumn("__b", broken.cast("long")).withColumn(out, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(active).drop("__b")


def flag_runs(df: DataFrame, part: list[str], pos: str, flag: str, value: bool = True) -> DataFrame:
    """part, start, end of each maximal run of rows with flag = value; pos must be dense."""
    held = df.where(F.col(flag) == F.lit(value))
    island = F.col(pos) - F.row_number().over(_w(part, pos))
    return held.withColumn("__g", island).groupBy(*part, "__g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__g")


def blocks(df: DataFrame, part: list[str], pos: str, size: int, out: str = "block_id") -> DataFrame:
    """Fixed-length blocks inside each run (part must hold the run): block number, the last may be short."""
    return df.withColumn(out, F.floor((F.row_number().over(_w(part, pos)) - 1) / size).cast("long"))


def transitions(df: DataFrame, part: list[str], pos: str, state: str) -> DataFrame:
    """part, pos, kind ('onset' or 'release'): the first row of a stream is an onset if held; a hold that
    reaches the end has no release."""
    before = F.lag(state, 1, False).over(_w(part, pos))
    kind = F.when(F.col(state) & ~before, "onset").when(~F.col(state) & before, "release")
    return df.withColumn("kind", kind).where("kind IS NOT NULL").select(*part, pos, "kind")


def valid_transitions(df: DataFrame, part: list[str], pos: str, idx: str, state: str, active: str) -> DataFrame:
    """Transitions with a valid predecessor only: the row before is consecutive and both are active."""
    w = _w(part, pos)
    ok = (F.col(idx) - F.lag(idx).over(w) == 1) & F.col(active) & F.lag(active).over(w)
    before = F.lag(state).over(w)
    kind = F.when(ok & F.col(state) & ~before, "onset").when(ok & ~F.col(state) & before, "release")
    return df.withColumn("kind", kind).where("kind IS NOT NULL").select(*part, pos, "kind")


def transition_targets(df: DataFrame, part: list[str], pos: str, state: str, carry: str | None = None) -> DataFrame:
    """Adds onset, release and known: whether the row before is known, which for a stream's first row needs carry,
    a column with the state carried in (null if there is none)."""
    w = _w(part, pos)
    first = F.row_number().over(w) == 1
    before = F.when(first, F.col(carry) if carry else F.lit(None).cast("boolean")).otherwise(F.lag(state).over(w))
    out = df.withColumn("__p", before)
    return out.withColumn("known", F.col("__p").isNotNull()).withColumn("onset", F.coalesce(F.col(state) & ~F.col("__p"), F.lit(False))).withColumn("release", F.coalesce(~F.col(state) & F.col("__p"), F.lit(False))).drop("__p")


def readable_alignment(df: DataFrame, part: list[str], pos: str, decoded: str) -> DataFrame:
    """Adds decode_status, is_duplicate and preceded_by_drop_count. A row without a decoded index is
    'unreadable' between readable ones and 'out_of_session' before the first or after the last; repeats and
    drops are counted against the previous readable row."""
    whole = Window.partitionBy(*part)
    ok = F.col(decoded).isNotNull()
    first, last = F.min(F.when(ok, F.col(pos))).over(whole), F.max(F.when(ok, F.col(pos))).over(whole)
    before = F.last(decoded, ignorenulls=True).over(_w(part, pos).rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(ok, "ok").when(first.isNull() | (F.col(pos) < first) | (F.col(pos) > last), "out_of_session").otherwise("unreadable")
    return (
        df.withColumn("decode_status", status)
        .withColumn("is_duplicate", F.coalesce(F.col(decoded) == before, F.lit(False)))
        .withColumn("preceded_by_drop_count", F.coalesce(F.greatest(F.col(decoded) - before - 1, F.lit(0)), F.lit(0)).cast("long"))
    )


def persistence(df: DataFrame, part: list[str], pos: str, state: str, out: str = "persisted") -> DataFrame:
    """The baseline that predicts the state of the row before, false at the start."""
    return df.withColumn(out, F.lag(state, 1, False).over(_w(part, pos)))


def jitter_agreement(df: DataFrame, part: list[str], pos: str, state: str, shifts: list[int]) -> DataFrame:
    """shift, n, agree: how many rows agree with the row shift places before, over all streams."""
    w = _w(part, pos)
    cols = [F.struct(F.lit(k).cast("long").alias("shift"), F.lag(state, k).over(w).alias("was")) for k in shifts]
    rows = df.withColumn("__x", F.array(*cols)).select(F.col(state).alias("now"), F.explode("__x").alias("__y")).select("now", "__y.*").where("was IS NOT NULL")
    return rows.groupBy("shift").agg(F.count("*").alias("n"), F.sum((F.col("now") == F.col("was")).cast("long")).alias("agree"))


def run_positions(df: DataFrame, part: list[str], pos: str) -> DataFrame:
    """Adds run_pos (from 0) and run_len; part must hold the run."""
    return df.withColumn("run_pos", (F.row_number().over(_w(part, pos)) - 1).cast("long")).withColumn("run_len", F.count("*").over(Window.partitionBy(*part)))


def window_starts(df: DataFrame, part: list[str], pos: str, length: int, stride: int = 1, dilation: int = 1, past_only: bool = False) -> DataFrame:
    """part, start, target: each stride-th start whose length rows, dilation apart, fit into the run; target
    is the middle row, or the last one if past_only."""
    span = (length - 1) * dilation + 1
    offset = (length - 1 if past_only else length // 2) * dilation
    rows = run_positions(df, part, pos).withColumn("__t", F.lead(pos, offset).over(_w(part, pos)))
    return rows.where((F.col("run_pos") + span <= F.col("run_len")) & (F.col("run_pos") % stride == 0)).select(*part, F.col(pos).alias("start"), F.col("__t").alias("target"))


def segments(starts: DataFrame, part: list[str], start: str, size: int) -> DataFrame:
    """part, segment, first, last: groups of size consecutive starts, without partial ones."""
    w = _w(part, start)
    island = starts.withColumn("__i", F.col(start) - F.row_number().over(w))
    inside = Window.partitionBy(*part, "__i").orderBy(start)
    numbered = island.withColumn("__k", F.floor((F.row_number().over(inside) - 1) / size))
    full = numbered.groupBy(*part, "__i", "__k").agg(F.count("*").alias("n"), F.min(start).alias("first"), F.max(start).alias("last")).where(F.col("n") == size)
    return full.select(*part, "first", "last")


def history(df: DataFrame, part: list[str], pos: str, value: str, length: int, gap: int, pad: Column) -> DataFrame:
    """Adds history: the length values that end gap rows before the row, padded on the left."""
    seen = F.collect_list(value).over(_w(part, pos).rowsBetween(-(gap + length), -(gap + 1)))
    return df.withColumn("__h", seen).withColumn("history", F.concat(F.array_repeat(pad, F.lit(length) - F.size("__h")), F.col("__h"))).drop("__h")


def tailed_windows(runs: DataFrame, start: str, end: str, length: int, stride: int) -> DataFrame:
    """Adds window_start, a row each: every stride-th start, and the one that ends with the run. Shorter runs give none."""
    last = F.col(end) - length
    all_starts = F.array_distinct(F.concat(F.sequence(F.col(start), last, F.lit(stride).cast("long")), F.array(last)))
    return runs.where(last >= F.col(start)).withColumn("window_start", F.explode(all_starts))


def missing_tails(runs: DataFrame, existing: DataFrame, keys: list[str], start: str, end: str, length: int) -> DataFrame:
    """keys, window_start: the tail start of each run that existing (keys, window_start) lacks."""
    tails = runs.where(F.col(end) - F.col(start) >= length).select(*keys, (F.col(end) - length).alias("window_start"))
    return tails.join(existing, [*keys, "window_start"], "left_anti")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def decimate(df: DataFrame, part: list[str], pos: str, every: int, phase: int) -> DataFrame:
    """Each every-th row of a run, from phase; part must hold the run."""
    return run_positions(df, part, pos).where(F.col("run_pos") % every == phase).drop("run_pos", "run_len")


def decimation_loss(runs: DataFrame, start: str, end: str, every: int) -> DataFrame:
    """phase, runs, lost, single: how many runs would keep no row, or one, if each every-th row from phase is kept."""
    def kept(bound: str, phase: Column) -> Column:
        return F.ceil((F.col(bound) - phase) / every)

    phases = runs.select(start, end, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(every - 1).cast("long"))).alias("phase"))
    counted = phases.withColumn("kept", kept(end, F.col("phase")) - kept(start, F.col("phase")))
    return counted.groupBy("phase").agg(F.count("*").alias("runs"), F.sum((F.col("kept") == 0).cast("long")).alias("lost"), F.sum((F.col("kept") == 1).cast("long")).alias("single"))


def latch_step(on: float, off: float, start: float, resync_on: float, resync_off: float, patience: int) -> Callable:
    """step(held, against, state, onset, release) of the hysteresis latch: the next held and count of rows against it."""

    def step(held, against, p, o, r):
        if held is None:
            return (None if p is None else p >= start), 0
        event = r if held else o
        event = None if event is None else event >= (off if held else on)
        held = not held if event else held
        contrary = event is False and p is not None and (p <= resync_off if held else p >= resync_on)
        against = against + 1 if contrary else 0
        return (p >= resync_on, 0) if against >= patience else (held, against)

    return step


def latch(df: DataFrame, part: list[str], pos: str, state_p: str, onset_p: str, release_p: str, on: float = 0.5, off: float = 0.5, start: float = 0.5, resync_on: float = 0.9, resync_off: float = 0.1, patience: int = 3) -> DataFrame:
    """part, pos, held: a hysteresis latch. The first row takes the state's threshold; then an onset while
    released or a release while held switches it, and patience rows in a row of confident disagreement
    without an event resynchronise it.

    Each state needs the one before, so a stream is read in order: streams are dealt and sorted by Spark (which spills),
    and pass through their task batch by batch with two values carried, however long they are."""
    fields = [df.schema[c] for c in (*part, pos)]
    ordered = df.select(*part, pos, *[F.col(c).cast("double").alias(f"__{n}") for n, c in enumerate((state_p, onset_p, release_p))]).repartition(*part).sortWithinPartitions(*part, pos, "__0", "__1", "__2")

    step = latch_step(on, off, start, resync_on, resync_off, patience)

    def run(batches):
        stream, held, against = None, None, 0
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in range(len(part))], strict=True) if part else iter([()] * batch.num_rows)
            out = []
            for key, p, o, r in zip(keys, *[batch.column(n).to_pylist() for n in range(-3, 0)], strict=True):
                if key != stream:
                    stream, held, against = key, None, 0
                held, against = step(held, against, p, o, r)
                out.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(part) + 1], pa.array(out, pa.bool_())], names=[*part, pos, "held"])

    return ordered.mapInArrow(run, T.StructType([*fields, T.StructField("held", T.BooleanType())]))


def split_latch(
    df: DataFrame, part: list[str], pos: str, state_p: str, onset_p: str, release_p: str, on: float = 0.5, off: float = 0.5, start: float = 0.5, resync_on: float = 0.9, resync_off: float = 0.1, patience: int = 3, carry: DataFrame | None = None
) -> DataFrame:
    """part, pos, held, against: latch() with a long stream cut into ranges that are read in parallel, from a carried state.

    A latch has 2 * patience + 2 states (no row read, none known; held or released with fewer than patience rows against it), so a
    range is a map from its entry state to its exit state; rows quickly send most states to one. Maps of ranges are
    combined in order and give every range its entry state. `against` beside the last row of a stream is, with `held`, what the
    next segment of that stream needs. carry (part, held, against): states at the end of the segments before; a stream without one begins anew."""
    step = latch_step(on, off, start, resync_on, resync_off, patience)
    begun = [(held, against) for held in (False, True) for against in range(patience)]
    inputs = df.select(*part, pos, *[F.col(c).cast("double").alias(f"__{n}") for n, c in enumerate((state_p, onset_p, release_p))])
    none = {"__held": F.lit(None).cast("boolean"), "__against": F.lit(0)}
    if carry is None:
        inputs = inputs.withColumns(none)
    else:
        known = carry.select(*part, F.col("held").alias("__held"), F.col("against").cast("int").alias("__against"))
        inputs = inputs.join(known, part, "left").withColumn("__against", F.coalesce("__against", F.lit(0)))
    at = len(part) + 1

    def summarise(rows):
        images, carried = {s: s for s in (None, (None, 0), *begun)}, None
        for row in rows:
            p, o, r, held, against = row[at:]
            if carried is None:
                carried = (held, against)
            after = {s: step(*(carried if s is None else s), p, o, r) for s in set(images.values())}
            images = {s: after[t] for s, t in images.items()}
        return images

    def run(key, state, rows):
        for row in rows:
            p, o, r, held, against = row[at:]
            state = step(*((held, against) if state is None else state), p, o, r)
            yield (*key, row[at - 1], *state)

    out = T.StructType([*(df.schema[c] for c in (*part, pos)), T.StructField("held", T.BooleanType()), T.StructField("against", T.IntegerType())])
    return over_ranges(inputs, part, [pos, "__0", "__1", "__2"], ["__held", "__against"], None, summarise, lambda state, images: images[state], run, out)


def carried_states(latched: DataFrame, part: list[str], pos: str) -> DataFrame:
    """part, held, against: the states at the end of split_latch()'s streams, to carry into the next segment."""
    last = latched.groupBy(*part).agg(F.max_by(F.struct("held", "against"), pos).alias("__s"))
    return last.select(*part, "__s.held", "__s.against")


def bridged(df: DataFrame, part: list[str], pos: str, flag: str, most_gap: int, least_run: int) -> DataFrame:
    """part, start, end: runs of flag after gaps of up to most_gap rows inside a stream are bridged and runs under
    least_run rows dropped; pos must be dense."""
    runs = flag_runs(df, part, pos, flag)
    w = _w(part, "start")
    joined = runs.withColumn("__n", F.coalesce((F.col("start") - F.lag("end").over(w) > most_gap).cast("long"), F.lit(1))).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy(*part, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")
    return out.where(F.col("end") - F.col("start") >= least_run)


def present_twice(df: DataFrame, part: list[str], pos: str, present: str, out: str = "valid") -> DataFrame:
    """Motion counts only where the row and the one before are present."""
    return df.withColumn(out, F.col(present) & F.lag(present, 1, False).over(_w(part, pos)))


def repeats(df: DataFrame, part: list[str], pos: str, difference: str, near: float) -> DataFrame:
    """part, longest (rows in the longest run of zero difference), near_rows (0 < difference <= near)."""
    flagged = df.withColumn("__z", F.coalesce(F.col(difference) == 0, F.lit(False)))
    longest = flag_runs(flagged, part, pos, "__z").groupBy(*part).agg(F.max(F.col("end") - F.col("start")).alias("longest"))
    counts = df.groupBy(*part).agg(F.sum(F.when((F.col(difference) > 0) & (F.col(difference) <= near), 1).otherwise(0)).alias("near_rows"))
    return counts.join(longest, part, "left").select(*part, F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), "near_rows")


def merged_chunks(chunks: DataFrame, part: list[str], chunk: str, rate: str) -> DataFrame:
    """part, first, last, n: consecutive chunk ids of one rate as one run."""
    runs = contiguous_runs(chunks, part, chunk, chunk, [rate])
    return runs.groupBy(*part, "run_id").agg(F.min(chunk).alias("first"), F.max(chunk).alias("last"), F.count("*").alias("n")).drop("run_id")


def gated_windows(df: DataFrame, part: list[str], pos: str, covered: str, active: str, span: int, stride: int, least_active: int) -> DataFrame:
    """part, start, n_active: full windows of span rows, all covered and with least_active active ones."""
    w = _w(part, pos).rowsBetween(0, span - 1)
    rows = df.withColumn("__n", F.count("*").over(w)).withColumn("__c", F.sum(F.col(covered).cast("long")).over(w)).withColumn("n_active", F.sum(F.col(active).cast("long")).over(w))
    return rows.where((F.col("__n") == span) & (F.col("__c") == span) & (F.col("n_active") >= least_active) & (F.col(pos) % stride == 0)).select(*part, F.col(pos).alias("start"), "n_active")


def lag_energy(events: DataFrame, signal: DataFrame, part: list[str], pos: str, value: str, lags: list[int]) -> DataFrame:
    """lag, n, energy: mean signal at event + lag. A lag at which any event finds no signal is left out."""
    shifted = events.select(*part, pos, F.explode(F.array(*[F.lit(x).cast("long") for x in lags])).alias("lag")).withColumn("__at", F.col(pos) + F.col("lag"))
    found = shifted.drop(pos).join(signal.select(*part, F.col(pos).alias("__at"), value), [*part, "__at"], "left")
    return found.groupBy("lag").agg(F.count("*").alias("n"), F.count(value).alias("found"), F.avg(value).alias("energy")).where("n = found").drop("found")


def eligible_anchors(runs: DataFrame, length: str, horizon: int) -> DataFrame:
    """anchors: the sum over runs of max(0, length - horizon - 1)."""
    return runs.agg(F.coalesce(F.sum(F.greatest(F.col(length) - horizon - 1, F.lit(0))), F.lit(0)).cast("long").alias("anchors"))


def dense_violations(df: DataFrame, part: list[str], pos: str, idx: str, first: int = 0) -> DataFrame:
    """part, at, found: the first row of a stream whose idx isn't the next number from first."""
    expected = F.row_number().over(_w(part, pos)) - 1 + first
    bad = df.withColumn("__e", expected).where(~F.col(idx).eqNullSafe(F.col("__e")))
    return bad.groupBy(*part).agg(F.min_by(F.struct(pos, idx), F.col(pos)).alias("x")).select(*part, F.col(f"x.{pos}").alias("at"), F.col(f"x.{idx}").alias("found"))


def change_weights(df: DataFrame, part: list[str], pos: str, state: str, weight: float, out: str = "weight") -> DataFrame:
    """weight where the state differs from the row before, else 1."""
    return df.withColumn(out, F.when(F.col(state) != F.lag(state).over(_w(part, pos)), F.lit(weight)).otherwise(F.lit(1.0)))


def horizon_pairs(df: DataFrame, part: list[str], pos: str, value: str, horizons: list[int]) -> DataFrame:
    """part, pos, horizon, change, moving: rows t and t + horizon of one run (part holds it) and whether their
    absolute change is above the median of all pairs."""
    left = df.select(*part, pos, F.col(value).alias("__v"), F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])).alias("horizon")).withColumn("__at", F.col(pos) + F.col("horizon"))
    pairs = left.join(df.select(*part, F.col(pos).alias("__at"), F.col(value).alias("__u")), [*part, "__at"]).withColumn("change", F.abs(F.col("__u") - F.col("__v")))
    pairs = cut(pairs.select(*part, pos, "horizon", "change"))
    middle = exact_quantiles(pairs, [], "change", {"__m": 0.5})
    return pairs.crossJoin(F.broadcast(middle)).select(*part, pos, "horizon", "change", (F.col("change") > F.col("__m")).alias("moving"))


def vector_change(df: DataFrame, part: list[str], pos: str, vector: str, out: str = "change") -> DataFrame:
    """Mean absolute difference to the vector of the row before; 0 in the first row."""
    before = F.lag(vector).over(_w(part, pos))
    diff = F.zip_with(vector, "__b", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return df.withColumn("__b", before).withColumn(out, F.coalesce(F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x) / F.size(vector), F.lit(0.0))).drop("__b")


def order_check(df: DataFrame, part: list[str], pos: str, value: str) -> DataFrame:
    """part, n, decreasing, equal: steps down and repeats of value along the stream."""
    before = F.lag(value).over(_w(part, pos))
    return df.withColumn("__b", before).groupBy(*part).agg(F.count("*").alias("n"), F.sum(F.when(F.col(value) < F.col("__b"), 1).otherwise(0)).alias("decreasing"), F.sum(F.when(F.col(value) == F.col("__b"), 1).otherwise(0)).alias("equal"))


def freeze_scores(df: DataFrame, events: DataFrame, part: list[str], pos: str, motion: str, event: str, lags: list[int], eps: float) -> DataFrame:
    """part, event, lag, score: how much a freeze of three rows follows a row: ln of the median motion of the three rows
    before it over the largest of the next three, plus ln of the fourth's over it. An event and
    lag without all seven rows has no score. df is dense in pos; a row's score is found once for all events."""
    w = Window.partitionBy(*part).orderBy(pos)
    before = F.sort_array(F.array(*[F.lag(motion, k).over(w) for k in (3, 2, 1)]))
    still = F.greatest(*[F.lead(motion, k).over(w) for k in (1, 2, 3)])
    after = F.lead(motion, 4).over(w)
    whole = F.lag(motion, 3).over(w).isNotNull() & after.isNotNull()
    score = F.when(whole, F.ln((before[1] + eps) / (still + eps)) + F.ln((after + eps) / (still + eps)))
    at = df.select(*part, F.col(pos).alias("__at"), score.alias("score")).where("score IS NOT NULL")
    asked = events.select(*part, event, F.explode(F.array(*[F.lit(x).cast("long") for x in lags])).alias("lag")).withColumn("__at", F.col(event) + F.col("lag"))
    return asked.join(at, [*part, "__at"]).select(*part, event, "lag", "score")


def balanced_offsets(rows: DataFrame, events: DataFrame, part: list[str], run: str, pos: str, active: str, head: str, width: int, halo: int, salt: str) -> DataFrame:
    """part, pos, head, offset, crop_start: where in a window of width rows each event is to lie. Kept are events around
    which every window with its halo lies in one run of active rows, and that have no other event of their head
    within a width. A stream's events of a head take its offsets in turn, both in hashed order, so the counts of
    offsets differ by one at most."""
    reach = width - 1 + halo
    around = Window.partitionBy(*part, run).orderBy(pos).rowsBetween(-reach, reach)
    safe = rows.withColumn("__n", F.count(F.when(F.col(active), 1)).over(around)).where(F.col("__n") == 2 * reach + 1).select(*part, pos)
    near = Window.partitionBy(*part, head).orderBy(pos).rangeBetween(-(width - 1), width - 1)
    alone = events.select(*part, pos, head).withColumn("__n", F.count("*").over(near)).where("__n = 1").drop("__n")
    task = lambda last: salted_key(F.concat_ws(":", *[F.col(c).cast("string") for c in (*part, head)], last.cast("string")), salt)
    turns = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda o: F.struct(task(o).alias("h"), o.cast("long").alias("o"))))
    turn = (F.row_number().over(Window.partitionBy(*part, head).orderBy("__h", pos)) - 1) % width
    dealt = alone.join(safe, [*part, pos]).withColumn("__h", salted_key(F.col(pos), salt)).withColumn("__t", turn).withColumn("offset", F.get(turns, F.col("__t"))["o"])
    return dealt.select(*part, pos, head, "offset", (F.col(pos) - F.col("offset") - halo).alias("crop_start"))
