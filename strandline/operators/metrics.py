"""Scores of predictions, in long form: one row per (group, key, ...) with y (truth), p (probability) and pos.

Undefined metrics are NULL here; a caller that wants NaN or 0 says so at the edge. Counts stay integers
until the last division, and divisions are try_divide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import credit_fit, growth_fit, ratio_fit
from .ranges import exact_quantiles, running_totals, tiles


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def unpivot_keys(df: DataFrame, ids: list[str], keys: list[str], out_key: str = "key", out_value: str = "y") -> DataFrame:
    return df.unpivot(ids, keys, out_key, out_value)


def pivot_keys(df: DataFrame, ids: list[str], key: str, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*ids).pivot(key, keys).agg(F.max(value))


def joint_code(keys: list[str]) -> Column:
    """Flags packed to a number, the first one lowest."""
    return sum((F.col(k).cast("long") * (2**i) for i, k in enumerate(keys)), F.lit(0).cast("long"))


def average_precision(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """by, positives, ap: tied scores enter together. One row per score is what is sorted, not one per row."""
    tied = df.groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("tp"), F.count("*").alias("n"))
    cum = running_totals(tied, by, p, {"ctp": F.col("tp"), "cn": F.col("n")}, down=True)
    out = cum.groupBy(*by).agg(F.sum("tp").alias("positives"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("s"))
    return out.select(*by, "positives", ratio(F.col("s"), F.when(F.col("positives") > 0, F.col("positives"))).alias("ap"))


def ordered_precision(df: DataFrame, by: list[str], y: str, p: str, pos: str) -> DataFrame:
    """by, ap, prevalence, skill: ties stay in stable order of pos; skill is (ap - prevalence) / (1 - prevalence)."""
    ranked = running_totals(df.select(*dict.fromkeys([*by, y, p, pos])), by, p, {"__r": F.lit(1), "__c": F.col(y).cast("long")}, ties=pos, down=True)
    out = ranked.groupBy(*by).agg(F.sum(F.when(F.col(y), F.col("__c") / F.col("__r"))).alias("s"), F.sum(F.col(y).cast("long")).alias("k"), F.count("*").alias("n"))
    ap, prev = ratio(F.col("s"), F.when(F.col("k") > 0, F.col("k"))), ratio(F.col("k"), F.col("n"))
    return out.select(*by, ap.alias("ap"), prev.alias("prevalence"), ratio(ap - prev, F.when(prev < 1, 1 - prev)).alias("skill"))


def confusion_counts(df: DataFrame, by: list[str], y: str, predicted: Column) -> DataFrame:
    one = F.lit(1)
    t = F.col(y)
    return df.groupBy(*by).agg(F.count(F.when(t & predicted, one)).alias("tp"), F.count(F.when(~t & predicted, one)).alias("fp"), F.count(F.when(t & ~predicted, one)).alias("fn"), F.count(F.when(~t & ~predicted, one)).alias("tn"))


def prf(df: DataFrame, by: list[str], y: str, predicted: Column) -> DataFrame:
    """by, precision, recall, f1 (NULL without positives in the truth)."""
    c = confusion_counts(df, by, y, predicted)
    has = (F.col("tp") + F.col("fn")) > 0
    return c.select(*by, ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.when(has, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def event_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """by, f1, precision, recall of n_true, n_pred, n_matched: f1 is NULL without any event; the others are 0 then."""
    zero = F.lit(0.0)
    return df.select(*by, ratio(2 * F.col("n_matched"), F.col("n_true") + F.col("n_pred")).alias("f1"), F.coalesce(ratio(F.col("n_matched"), F.col("n_pred")), zero).alias("precision"), F.coalesce(ratio(F.col("n_matched"), F.col("n_true")), zero).alias("recall"))


def reliability(df: DataFrame, by: list[str], y: str, p: str, edges: list[float]) -> DataFrame:
    """by, bin, n, mean_p, rate: a row falls into the last bin whose lower edge is at most p; the last bin is closed."""
    bin_ = F.least(sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1, F.lit(len(edges) - 2))
    return df.withColumn("bin", bin_.cast("long")).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def equal_mass_bins(df: DataFrame, by: list[str], y: str, p: str, pos: str, k: int) -> DataFrame:
    """by, bin, n, mean_p, rate of k bins of equal size, in order of (p, pos)."""
    ranked = running_totals(df.select(*dict.fromkeys([*by, y, p, pos])), by, p, {"__r": F.lit(1)}, ties=pos)
    return ranked.withColumn("bin", tiles(F.col("__r"), F.col("__r_all"), k)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def clipped(p: str | Column, eps: float = 1e-7) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps))


def losses(df: DataFrame, by: list[str], y: str, p: str, eps: float = 1e-7) -> DataFrame:
    """by, n, prevalence, nll, brier, prior_nll, prior_brier: the prior predicts each group's own rate."""
    c = clipped(p, eps)
    base = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("prevalence"), F.avg(F.when(F.col(y), -F.ln(c)).otherwise(-F.log1p(-c))).alias("nll"), F.avg((F.col(p) - F.col(y).cast("double")) ** 2).alias("brier"))
    q = clipped("prevalence", eps)
    return base.withColumn("prior_nll", -(F.col("prevalence") * F.ln(q) + (1 - F.col("prevalence")) * F.log1p(-q))).withColumn("prior_brier", F.col("prevalence") * (1 - F.col("prevalence")))


def macro(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n_defined, mean, spread: over keys with a value; sample deviation, 0 for one."""
    return df.groupBy(*by).agg(F.count(value).alias("n_defined"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("spread"))


def weighted_and_equal(df: DataFrame, group: str, value: str) -> DataFrame:
    """row_mean (all rows alike) and group_mean (all groups alike)."""
    by = df.groupBy(group).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return by.agg((F.sum("__s") / F.sum("__n")).alias("row_mean"), F.avg(F.col("__s") / F.col("__n")).alias("group_mean"))


def confusion_grid(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """actual, predicted, n: the full grid of declared classes, 0 where nothing fell."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"{actual} {df.schema[actual].dataType.simpleString()}, {predicted} {df.schema[predicted].dataType.simpleString()}")
    return grid.join(df.groupBy(actual, predicted).agg(F.count("*").alias("n")), [actual, predicted], "left").fillna(0, ["n"])


def accuracy(df: DataFrame, part: list[str], pos: str, keys: list[str], predicted: list[str]) -> DataFrame:
    """micro, joint, released, persisted: share of right key states, of rows with all keys right, of key states right
    if all are called released, and if each is called as in the row before."""
    w = Window.partitionBy(*part).orderBy(pos)
    right = [(F.col(k) == F.col(p)).cast("long") for k, p in zip(keys, predicted, strict=True)]
    before = df
    for i, k in enumerate(keys):
        before = before.withColumn(f"__b{i}", F.lag(k, 1, False).over(w))
    n = F.count("*") * len(keys)
    add = lambda xs: sum(xs[1:], xs[0])
    return before.agg(
        (F.sum(add(right)) / n).alias("micro"),
        F.avg((add(right) == len(keys)).cast("double")).alias("joint"),
        (F.sum(add([(~F.col(k)).cast("long") for k in keys])) / n).alias("released"),
        (F.sum(add([(F.col(k) == F.col(f"__b{i}")).cast("long") for i, k in enumerate(keys)])) / n).alias("persisted"),
    )


def rank_auc(df: DataFrame, by: list[str], y: str, score: str, pos: str) -> DataFrame:
    """by, auc by ordinal ranks without averaging ties: equal scores rank positives first, then by pos.

    Only the sum of the positives' ranks counts, which their order among themselves doesn't change: of a tie with a
    positives and n rows before it, it is a * n + a * (a + 1) / 2, so one row per score is what is sorted."""
    tied = df.groupBy(*by, score).agg(F.count(F.when(F.col(y), 1)).alias("a"), F.count(F.when(~F.col(y), 1)).alias("b"), F.count("*").alias("n"))
    ranks = running_totals(tied, by, score, {"upto": F.col("n")})
    rank_sum = F.col("a") * (F.col("upto") - F.col("n")) + F.col("a") * (F.col("a") + 1) / 2
    out = ranks.groupBy(*by).agg(F.sum(rank_sum).alias("r"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return out.select(*by, ratio(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("a") * F.col("b"))).alias("auc"))


def run_statistics(runs: DataFrame, by: list[str], length: str, burst: int) -> DataFrame:
    """by, presses, median_run, burst_share (runs of at most burst rows), rows_held."""
    return runs.groupBy(*by).agg(F.count("*").alias("presses"), F.median(length).alias("median_run"), F.avg((F.col(length) <= burst).cast("double")).alias("burst_share"), F.sum(length).alias("rows_held"))


def composite_statistics(df: DataFrame, by: list[str], weight: str, value: str, median: str) -> DataFrame:
    """by, weighted, major_median: the weighted mean of value, and the median column of the heaviest member."""
    return df.groupBy(*by).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("weighted"), F.max_by(median, F.struct(weight, median)).alias("major_median"))


def duty(df: DataFrame, part: list[str], pos: str, state: str) -> DataFrame:
    """part, n, duty, transitions, singles (runs of one row, of either state)."""
    w = Window.partitionBy(*part).orderBy(pos)
    changed = F.coalesce(F.col(state) != F.lag(state).over(w), F.lit(False))
    x = df.withColumn("__c", changed)
    edge = F.coalesce(F.lead("__c").over(w), F.lit(True)) & (F.col("__c") | (F.row_number().over(w) == 1))
    return x.withColumn("__s", edge).groupBy(*part).agg(F.count("*").alias("n"), F.avg(F.col(state).cast("double")).alias("duty"), F.sum(F.col("__c").cast("long")).alias("transitions"), F.sum(F.col("__s").cast("long")).alias("singles"))


def robust_separation(df: DataFrame, by: list[str], state: str, value: str) -> DataFrame:
    """by, low, high, spread, separation: medians of the two states, the larger 1.4826 MAD, and their ratio."""
    group = [*by, state]
    mids = exact_quantiles(df, group, value, {"__m": 0.5})
    away = exact_quantiles(df.join(mids, group), group, F.abs(F.col(value) - F.col("__m")), {"__d": 0.5})
    mads = mids.join(away.withColumn("__d", F.col("__d") * 1.4826), group)
    out = mads.groupBy(*by).agg(F.max(F.when(~F.col(state), F.col("__m"))).alias("low"), F.max(F.when(F.col(state), F.col("__m"))).alias("high"), F.max("__d").alias("spread"))
    return out.withColumn("separation", ratio(F.col("high") - F.col("low"), F.when(F.col("spread") > 0, F.col("spread"))))


def cadence(df: DataFrame, part: list[str], t: str, gap_factor: float) -> DataFrame:
    """part, n, median_dt, p01, p99, gaps: steps of a time column; a gap is over gap_factor medians."""
    d = df.withColumn("__d", F.col(t) - F.lag(t).over(Window.partitionBy(*part).orderBy(t))).where("__d IS NOT NULL")
    out = d.groupBy(*part).agg(F.count("*").alias("n"), F.median("__d").alias("median_dt"), F.percentile("__d", F.lit(0.01)).alias("p01"), F.percentile("__d", F.lit(0.99)).alias("p99"))
    gaps = d.join(out.select(*part, "median_dt"), part).groupBy(*part).agg(F.count(F.when(F.col("__d") > gap_factor * F.col("median_dt"), 1)).alias("gaps"))
    return out.join(gaps, part)


def positive_weights(df: DataFrame, by: list[str], y: str, most: float) -> DataFrame:
    """by, weight: negatives per positive, between 1 and most; most without positives."""
    neg, pos = F.count(F.when(~F.col(y), 1)), F.count(F.when(F.col(y), 1))
    return df.groupBy(*by).agg(F.greatest(F.lit(1.0), F.least(F.lit(most), F.coalesce(ratio(neg, pos), F.lit(most)))).alias("weight"))


def duration_histogram(df: DataFrame, by: list[str], length: str, edges: list[int]) -> DataFrame:
    """by, bucket, n: bucket i holds edges[i] <= length < edges[i + 1]; the last one is open."""
    bucket = sum((F.when(F.col(length) >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1
    return df.withColumn("bucket", bucket.cast("long")).groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def votes(df: DataFrame, by: list[str], verdict: str, yes: str, no: str) -> DataFrame:
    """by, outcome: 'yes' if some say yes and none no, 'no' if all say no, 'mixed' if both occur, else 'unknown'."""
    y, n = F.count(F.when(F.col(verdict) == yes, 1)), F.count(F.when(F.col(verdict) == no, 1))
    return df.groupBy(*by).agg(F.when((y > 0) & (n > 0), "mixed").when(y > 0, "yes").when(n == F.count("*"), "no").otherwise("unknown").alias("outcome"))


def unseen_rate(train: DataFrame, test: DataFrame, code: str) -> DataFrame:
    """known, unseen_rows, rate: test rows whose joint configuration the train rows lack."""
    seen = train.select(code).distinct()
    n = test.agg(F.count("*").alias("n"))
    miss = test.join(seen, code, "left_anti").agg(F.count("*").alias("unseen_rows"))
    return seen.agg(F.count("*").alias("known")).crossJoin(miss).crossJoin(n).select("known", "unseen_rows", ratio(F.col("unseen_rows"), F.col("n")).alias("rate"))


def offset_summary(df: DataFrame, probabilities: str, true_offset: str) -> DataFrame:
    """n, exact, within1, within2, nll, entropy, signed of a probability array over offsets and the true position (from 0)."""
    best = F.array_position(probabilities, F.array_max(probabilities)) - 1
    err = best - F.col(true_offset)
    entropy = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    hit = lambda k: F.avg((F.abs(err) <= k).cast("double"))
    return df.agg(F.count("*").alias("n"), hit(0).alias("exact"), hit(1).alias("within1"), hit(2).alias("within2"), F.avg(-F.ln(clipped(F.element_at(probabilities, (F.col(true_offset) + 1).cast("int"))))).alias("nll"), F.avg(entropy).alias("entropy"), F.avg(err.cast("double")).alias("signed"))


def quartiles(df: DataFrame, by: list[str], order: str, pos: str, value: str) -> DataFrame:
    """by, quartile, n, mean_order, mean_value of four parts of equal size."""
    ranked = running_totals(df.select(*dict.fromkeys([*by, order, pos, value])), by, order, {"__r": F.lit(1)}, ties=pos)
    return ranked.withColumn("quartile", tiles(F.col("__r"), F.col("__r_all"), 4)).groupBy(*by, "quartile").agg(F.count("*").alias("n"), F.avg(order).alias("mean_order"), F.avg(value).alias("mean_value"))


def dimension_scales(df: DataFrame, vector: str) -> DataFrame:
    """dim, mean, scale (population deviation, 1 where it is 0)."""
    x = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s")).select("dim", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("scale"))


def mean_pair_cosine(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, n, cosine: the mean over all pairs from the sum of unit vectors, without making the pairs."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = df.select(*by, F.posexplode(F.transform(vector, lambda x: x.cast("double") / norm)).alias("dim", "u"))
    sums = unit.groupBy(*by, "dim").agg(F.sum("u").alias("u"), F.count("*").alias("n"))
    out = sums.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("u") ** 2).alias("q"))
    return out.select(*by, "n", ratio(F.col("q") - F.col("n"), F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))).alias("cosine"))


def effective_rank(df: DataFrame, vector: str) -> DataFrame:
    """n, rank: the squared trace of the covariance over the sum of its squared entries; 0 if nothing varies. Each task adds up
    one matrix of products of dimensions (with a column of ones, for sums and count), so what is shuffled
    doesn't grow with the rows. NULL vectors are passed over."""

    def products(frames):
        total = None
        for frame in frames:
            if len(frame):
                x = np.vstack(frame[vector].to_numpy()).astype("float64")
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "ones": len(total) - 1, "v": total.ravel()})

    g = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(products, "i long, j long, ones long, v double").groupBy("i", "j", "ones").agg(F.sum("v").alias("v"))
    sums = g.where("j = ones AND i < ones")
    n = g.where("i = ones AND j = ones").select(F.col("v").alias("n"))
    cov = g.where("i < ones AND j < ones").join(F.broadcast(sums.select("i", F.col("v").alias("a"))), "i").join(F.broadcast(sums.select(F.col("i").alias("j"), F.col("v").alias("b"))), "j").crossJoin(F.broadcast(n)).withColumn("c", F.col("v") / F.col("n") - F.col("a") * F.col("b") / F.col("n") ** 2)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    return cov.agg(F.max("n").cast("long").alias("n"), F.coalesce(ratio(trace**2, F.sum(F.col("c") ** 2)), F.lit(0.0)).alias("rank"))


def counts_as_map(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, counts: 'key=n' of each key in order, comma-joined (a map in one string)."""
    c = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "n")))
    return c.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["k"], x["n"])), ",").alias("counts"))


def coverage_audit(drawn: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """unique, missing, repeats, most: how a sampler's draws cover its universe."""
    c = universe.select(key).join(drawn.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.agg(F.count(F.when(F.col("n") > 0, 1)).alias("unique"), F.count(F.when(F.col("n") == 0, 1)).alias("missing"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("repeats"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("most"))


def leak_scan(df: DataFrame, by: list[str], pressed: str, signal: str, threshold: float, least: int) -> DataFrame:
    """by, difference, leaks: mean signal pressed less released, and whether it is over threshold with enough of both."""
    a, b = F.count(F.when(F.col(pressed), 1)), F.count(F.when(~F.col(pressed), 1))
    d = F.avg(F.when(F.col(pressed), F.col(signal))) - F.avg(F.when(~F.col(pressed), F.col(signal)))
    return df.groupBy(*by).agg(d.alias("difference"), F.coalesce((a >= least) & (b >= least) & (F.abs(d) > threshold), F.lit(False)).alias("leaks"))


def version_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """compared, changed, added, removed."""
    j = old.select(key, F.col(value).alias("__o"), F.lit(1).alias("__a")).join(new.select(key, F.col(value).alias("__n"), F.lit(1).alias("__b")), key, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(F.count(F.when(both, 1)).alias("compared"), F.count(F.when(both & ~F.col("__o").eqNullSafe(F.col("__n")), 1)).alias("changed"), F.count(F.when(F.col("__a").isNull(), 1)).alias("added"), F.count(F.when(F.col("__b").isNull(), 1)).alias("removed"))


def status_grid(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """by and a count column for each declared status, 0 where there is none."""
    return df.groupBy(*by).pivot(status, values).count().fillna(0)


def uniform_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kinds, uniform: whether a column has one value, nulls counted as a value."""
    return df.agg(*[F.countDistinct(F.struct(c)).alias(c) for c in columns]).unpivot([], columns, "column", "kinds").withColumn("uniform", F.col("kinds") == 1)


def stable_positions(df: DataFrame, vector: str) -> DataFrame:
    """dim, q25, scaled: the lower quartile of each position over samples, divided by its 97th percentile over positions, at most 1."""
    x = df.select(F.posexplode(vector).alias("dim", "x")).groupBy(F.col("dim").cast("long").alias("dim")).agg(F.percentile(F.col("x").cast("double"), F.lit(0.25)).alias("q25"))
    top = x.agg(F.percentile("q25", F.lit(0.97)).alias("t"))
    return x.crossJoin(F.broadcast(top)).select("dim", "q25", F.when(F.col("t") > 0, F.least(F.col("q25") / F.col("t"), F.lit(1.0))).otherwise(0.0).alias("scaled"))


#: How much each measure of a unit speaks for each action.
BIND_WEIGHTS = {
    "jump": {"frequency": 0.50, "jump_fit": 0.40, "burst": 0.10},
    "dash": {"frequency": 0.25, "dash_fit": 0.30, "direction": 0.40, "burst": 0.05},
    "grab": {"frequency": 0.15, "grab_fit": 0.45, "upward": 0.30, "sustained": 0.10},
}


def bind_scores(stats: DataFrame, by: list[str], unit: str, presses: str, duration: str, burst: str, direction: str, upward: str, target: float, full: float, tolerated: float, long: float, least_presses: int, priors: dict[str, list[str]] | None = None, bonus: float = 0.0) -> DataFrame:
    """by, action, unit, score in [0, 1]: how well a unit (a button, or several pressed as one) fits each action.

    stats: one row a unit of a group, with its presses, median duration and shares of bursts, of presses with a
    direction and with up. Each action weighs curves of these (BIND_WEIGHTS); few presses (under least_presses) count in
    proportion, and units that priors name for an action get a bonus. All measures are read in one pass; the group's
    most pressed unit is a grouped maximum that is joined back, so a group of any size is no single task's work."""
    most = stats.groupBy(*by).agg(F.max(presses).alias("__most"))
    n, d = F.col(presses), F.col(duration).cast("double")
    measures = {
        "frequency": F.when(F.col("__most") > 0, F.least(F.lit(1.0), n / F.col("__most"))).otherwise(0.0), "jump_fit": ratio_fit(d, target), "dash_fit": credit_fit(d, full, tolerated), "grab_fit": growth_fit(d, long),
        "burst": F.col(burst), "sustained": 1.0 - F.col(burst), "direction": F.col(direction), "upward": F.col(upward),
    }
    support = F.least(F.lit(1.0), n / F.lit(float(max(least_presses, 1))))
    rows = []
    for action, weights in BIND_WEIGHTS.items():
        raw = sum((F.lit(w) * measures[m] for m, w in weights.items()), F.lit(0.0))
        extra = F.when(F.col(unit).isin(*(priors or {}).get(action, [])), F.lit(float(bonus))).otherwise(0.0) if (priors or {}).get(action) else F.lit(0.0)
        rows.append(F.struct(F.lit(action).alias("action"), F.least(F.lit(1.0), support * raw + extra).alias("score")))
    joined_rows = stats.join(most, by) if by else stats.crossJoin(F.broadcast(most))
    return joined_rows.select(*by, unit, F.explode(F.array(*rows)).alias("__x")).select(*by, "__x.action", unit, "__x.score")
