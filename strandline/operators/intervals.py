"""Half-open intervals: validation, conversion, coverage, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_violations(df: DataFrame, part: list[str], start: str, end: str, low: float, high: float) -> DataFrame:
    """part, start, reason: empty ranges, ranges outside [low, high] and those that begin before the one before ends."""
    before = F.lag(end).over(Window.partitionBy(*part).orderBy(start, end))
    reason = F.when(F.col(start) >= F.col(end), "empty").when((F.col(start) < low) | (F.col(end) > high), "outside").when(before > F.col(start), "overlap")
    return df.withColumn("reason", reason).where("reason IS NOT NULL").select(*part, start, "reason")


def runs_to_times(runs: DataFrame, times: DataFrame, part: list[str], pos: str, t: str, low: float, high: float) -> DataFrame:
    """part, start, end, t0, t1: a run of positions as times: t1 is the time of the row after it, or at the end of the
    data the last time plus the median step; both clipped to [low, high]."""
    step = times.withColumn("__d", F.col(t) - F.lag(t).over(Window.partitionBy(*part).orderBy(pos))).groupBy(*part).agg(F.coalesce(F.median("__d"), F.lit(0.0)).alias("__dt"))
    at = times.select(*part, F.col(pos).alias("__p"), F.col(t).cast("double").alias("__t"))
    a = runs.join(at.withColumnRenamed("__p", "start").withColumnRenamed("__t", "t0"), [*part, "start"])
    b = a.join(at.withColumnRenamed("__p", "end").withColumnRenamed("__t", "__e"), [*part, "end"], "left")
    last = at.select(*part, (F.col("__p") + 1).alias("end"), F.col("__t").alias("__l"))
    c = b.join(last, [*part, "end"], "left").join(step, part)
    t1 = F.coalesce("__e", F.col("__l") + F.col("__dt"))
    clip = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return c.select(*part, "start", "end", clip(F.col("t0")).alias("t0"), clip(t1).alias("t1"))


def coverage_report(runs: DataFrame, totals: DataFrame, part: list[str], start: str, end: str, total: str, least_share: float) -> DataFrame:
    """part, ranges, covered, share, median_len, p90_len, passed; parts without a range count with 0."""
    n = F.col(end) - F.col(start)
    r = runs.groupBy(*part).agg(F.count("*").alias("ranges"), F.sum(n).alias("covered"), F.median(n).alias("median_len"), F.percentile(n, F.lit(0.9)).alias("p90_len"))
    share = F.coalesce(F.col("covered"), F.lit(0)) / F.col(total)
    return totals.join(r, part, "left").select(*part, F.coalesce("ranges", F.lit(0)).cast("long").alias("ranges"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), share.alias("share"), "median_len", "p90_len", (share >= least_share).alias("passed"))


def shifted_labels(frames: DataFrame, labels: DataFrame, part: list[str], pos: str, value: str, offset: int) -> DataFrame:
    """Frames with the label of pos + offset; frames without one are dropped."""
    return frames.join(labels.select(*part, (F.col(pos) - offset).alias(pos), value), [*part, pos])


#: Slots that a task of resampled writes, and slots of a part that are written in a row: Parquet stores the second's repeats in few bytes.
TASK_SLOTS, ROW_SLOTS = 50_000_000, 4096


def resampled(df: DataFrame, part: list[str], t: str, value: str, step: float, most_tail: int) -> DataFrame:
    """part, slot, value: a grid of step from each part's first time; a slot takes the nearest row, the earlier on
    ties. The grid ends at most most_tail slots after the last row.

    A row takes the slots between the middles to the rows before and after it, so only rows are shuffled and sorted. Slots, which may be
    many more, come last: by ROW_SLOTS of each part of a task, then the next ones of each, so that they repeat what came shortly before.
    Rows without a time have no slots."""
    at = F.col(t)
    slots = df.groupBy(*part).agg((F.floor((F.max(t) - F.min(t)) / step) + 1 + most_tail).alias("__n")).agg(F.sum("__n")).first()[0] or 0
    tasks = max(-(-int(slots) // TASK_SLOTS), df.sparkSession.sparkContext.defaultParallelism)
    ordered = Window.partitionBy(*part).orderBy(t, value)
    first = F.min(t).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    times = {"__a": F.lag(t).over(ordered) - first, "__t": at - first, "__b": F.lead(t).over(ordered) - first}
    rows = df.select(*part, t, value).where(at.isNotNull()).repartition(tasks, *part).select(*part, value, *[c.cast("double").alias(n) for n, c in times.items()])

    def held(a: str, b: str) -> Column:
        """The last slot that is no nearer to b than to a; a rounded quotient may be one off."""
        a, b = F.col(a), F.col(b)
        n = F.floor((a + b) / 2 / step)
        return F.when((n + 1) * step - a <= b - (n + 1) * step, n + 1).when(n * step - a <= b - n * step, n).otherwise(n - 1)

    low = F.coalesce(held("__a", "__t") + 1, F.lit(0))
    high = F.coalesce(held("__t", "__b"), F.floor(F.col("__t") / step) + most_tail)
    runs = rows.select(*part, value, low.alias("__low"), high.alias("__high")).where("__low <= __high")
    place = lambda c: F.floor(F.col(c) / ROW_SLOTS)
    pieces = runs.withColumn("__row", F.explode(F.sequence(place("__low"), place("__high")))).sortWithinPartitions("__row", *part, "__low")
    start = F.col("__row") * ROW_SLOTS
    return pieces.select(*part, F.explode(F.sequence(F.greatest("__low", start), F.least("__high", start + ROW_SLOTS - 1))).alias("slot"), value)


def bounded_parts(runs: DataFrame, part: list[str], start: str, end: str, media_end: str, size: int, least: int) -> DataFrame:
    """part, part_start, part_end: runs cut to the media's end and into parts of size rows; parts under least rows are dropped."""
    cut = runs.withColumn("__e", F.least(end, media_end)).where(F.col(start) < F.col("__e"))
    parts = cut.withColumn("part_start", F.explode(F.sequence(F.col(start), F.col("__e") - 1, F.lit(size).cast("long")))).withColumn("part_end", F.least(F.col("part_start") + size, F.col("__e")))
    return parts.where(F.col("part_end") - F.col("part_start") >= least).select(*part, "part_start", "part_end")
