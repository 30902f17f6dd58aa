"""Unsupervised thresholds, calibration, resampling and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import matched_events
from .ranges import at_positions, cut, joined, numbered, ranked_values, running_totals
from .schedule import seed_column


def otsu_midgap(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, threshold: the two-cluster split of largest between-class variance over boundaries of distinct values
    (ties: the lowest), then the middle of the cluster medians. No finite value: 0; a range under 1e-3: max + 1."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = F.col("v")
    ranked = cut(ranked_values(x, by, value, {"s": F.col(value).cast("double")}))
    rest = F.col("n") - F.col("upto")
    gap = F.try_divide(F.col("s_upto"), F.col("upto")) - F.try_divide(F.col("s_all") - F.col("s_upto"), rest)
    between = F.when(rest > 0, F.col("upto") * rest * F.pow(gap, F.lit(2.0)))
    best = ranked.groupBy(*by).agg(F.max_by("upto", F.when(rest > 0, F.struct(between.alias("b"), (-v).alias("low")))).alias("below"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    mids = at_positions(joined(ranked, best, by), by, {"a": (F.col("below") - 1) / 2, "b": F.col("below") + (F.col("n") - F.col("below") - 1) / 2})
    groups = df.select(*by).distinct()
    out = groups.join(best, by, "left").join(mids, by, "left")
    return out.select(*by, F.when(F.col("hi").isNull(), 0.0).when(F.col("hi") - F.col("lo") < 1e-3, F.col("hi") + 1.0).otherwise((F.col("a") + F.col("b")) / 2).alias("threshold"))


def cell_states(df: DataFrame, by: list[str], value: str, high_pressed: str, least_rows: int, least_gap: float) -> DataFrame:
    """by, low, high, threshold, separation, minority, pressed, changing of each cell's values.

    A provisional cut is the Otsu level of 256 bins between the cell's extremes (the lowest bin on ties), so a cell of any
    length sorts 256 counts; the threshold is the middle of the medians on both sides. minority counts the rarer state.
    high_pressed tells whether high values are the pressed state. NULL and NaN values don't count."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"), high_pressed)
    ends = x.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = x.join(ends, by).withColumn("bin", F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 255).cast("long"))
    up, whole = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    bins = x.groupBy(*by, "bin").agg(F.count("*").alias("c"))
    cum = bins.withColumn("a", F.sum("c").over(up)).withColumn("s", F.sum(F.col("bin") * F.col("c")).over(up)).withColumn("n", F.sum("c").over(whole)).withColumn("t", F.sum(F.col("bin") * F.col("c")).over(whole))
    rest = F.col("n") - F.col("a")
    between = F.when(rest > 0, F.col("a") * rest * F.pow(F.col("s") / F.col("a") - F.try_divide(F.col("t") - F.col("s"), rest), F.lit(2.0))).otherwise(0.0)
    level = cum.groupBy(*by).agg(F.max_by("bin", F.struct(between.alias("b"), (-F.col("bin")).alias("low"))).alias("level"))
    x = x.join(level, by)
    high = F.col("v") > F.col("lo") + F.col("level") / 255 * (F.col("hi") - F.col("lo"))
    ranked = ranked_values(x, by, "v")
    lows = x.groupBy(*by).agg(F.count(F.when(~high, 1)).alias("nl"))
    nl, nh = F.when(F.col("nl") > 0, F.col("nl")), F.when(F.col("n") > F.col("nl"), F.col("n") - F.col("nl"))
    mids = at_positions(joined(ranked, lows, by), by, {"l": (nl - 1) / 2, "h": F.col("nl") + (nh - 1) / 2, "m": (F.col("n") - 1) / 2})
    both = F.col("l").isNotNull() & F.col("h").isNotNull()
    mids = mids.select(*by, F.when(both, F.col("l")).otherwise(F.col("m")).alias("low"), F.when(both, F.col("h")).otherwise(F.col("m")).alias("high")).withColumn("threshold", (F.col("low") + F.col("high")) / 2)
    state = F.col("v") >= F.col("threshold")
    on, off = F.count(F.when(state, 1)), F.count(F.when(~state, 1))
    out = x.join(mids, by).groupBy(*by, "low", "high", "threshold").agg(F.least(on, off).alias("minority"), F.count(F.when(state == F.col(high_pressed), 1)).alias("pressed"))
    gap = F.col("high") - F.col("low")
    return out.select(*by, "low", "high", "threshold", gap.alias("separation"), "minority", "pressed", ((F.col("minority") >= least_rows) & (gap >= least_gap)).alias("changing"))


def spread_threshold(df: DataFrame, by: list[str], value: str, least: float, fraction: float, least_n: int, least_share: float) -> DataFrame:
    """by, threshold, separation, bimodal: q10 + fraction (q90 - q10), at least `least`; bimodal if both sides hold
    enough rows and their medians and the quantiles are `least` apart."""
    v = F.col(value).cast("double")
    ranked = cut(ranked_values(df, by, v))
    n = F.col("n") - 1
    q = at_positions(ranked, by, {"q10": n * F.lit(0.1), "q90": n * F.lit(0.9)})
    spread = F.col("q90") - F.col("q10")
    q = q.withColumn("threshold", F.greatest(F.lit(least), F.when(spread <= 1e-12, F.col("q90")).otherwise(F.col("q10") + fraction * spread)))
    sides = joined(ranked, q, by).groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("v") < F.col("threshold"), F.col("c"))), F.lit(0)).alias("nl"), F.coalesce(F.sum(F.when(F.col("v") >= F.col("threshold"), F.col("c"))), F.lit(0)).alias("nh"))
    nl, nh = F.when(F.col("nl") > 0, F.col("nl")), F.when(F.col("nh") > 0, F.col("nh"))
    mids = at_positions(joined(ranked, sides, by), by, {"ml": (nl - 1) / 2, "mh": F.col("nl") + (nh - 1) / 2})
    rows = df.groupBy(*by).agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(least_n), F.ceil(least_share * F.col("n")))
    sep = F.coalesce(F.col("mh") - F.col("ml"), F.lit(0.0))
    told = joined(joined(joined(rows, q, by), sides, by), mids, by)
    return told.select(*by, "threshold", sep.alias("separation"), ((F.col("nl") >= need) & (F.col("nh") >= need) & (spread >= least) & (sep >= least)).alias("bimodal"))


def bimodal_static(df: DataFrame, by: list[str], value: str, least_range: float, margin: float, purity: float, duty: tuple[float, float]) -> DataFrame:
    """by, high_share, pure_share, static: whether values stay near their extremes (margin of the range) and the share
    of high ones lies within duty."""
    v = F.col(value).cast("double")
    r = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    x = df.join(r, by).withColumn("u", F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")))
    out = x.groupBy(*by, "lo", "hi").agg(F.avg((F.col("u") >= 0.5).cast("double")).alias("high_share"), F.avg(((F.col("u") <= margin) | (F.col("u") >= 1 - margin)).cast("double")).alias("pure_share"))
    return out.select(*by, "high_share", "pure_share", F.coalesce((F.col("hi") - F.col("lo") >= least_range) & (F.col("pure_share") >= purity) & F.col("high_share").between(*duty), F.lit(False)).alias("static"))


def affine_fit(df: DataFrame, by: list[str], y: str, p: str, steps: int = 50, halvings: int = 12, tolerance: float = 1e-9, least: float = 1e-8) -> DataFrame:
    """by, slope, intercept, converged of a calibration p' = sigmoid(slope logit(p) + intercept) of least log loss, with
    slope at or above least.

    Newton steps from (1, 0). A step of a group is halved until it lowers the loss: one aggregation sums the loss of
    all its halvings, and gradient and Hessian there, for all groups, so each step reads the data once. The data are folded to
    one row per distinct (p, y) and kept. The driver holds one row per group. A group has converged when its
    gradient, by row, is within tolerance of 0 (at least = slope: points below it), or no halving lowers the loss
    by more than rounding does. Groups of one label only have no finite optimum and end unconverged."""
    c = F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))
    data = df.where(F.col(p).isNotNull()).select(*by, F.ln(c / (1 - c)).alias("z"), F.col(y).cast("double").alias("t")).where("t IS NOT NULL").groupBy(*by, "z", "t").agg(F.count("*").alias("w")).persist()
    spark, kinds = df.sparkSession, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    groups = {tuple(r): [1.0, 0.0, 0.0, 0.0, None, False] for r in df.select(*by).distinct().collect()}  # a, b, da, db, loss, converged
    try:
        for _ in range(steps):
            open_ = {k: g for k, g in groups.items() if not g[5]}
            if not open_:
                break
            now = spark.createDataFrame([(*k, *g[:4]) for k, g in open_.items()], f"{kinds}, __a double, __b double, __da double, __db double")
            sums = []
            for h in range(halvings):
                a, b = F.greatest(F.col("__a") + F.col("__da") * 0.5**h, F.lit(least)), F.col("__b") + F.col("__db") * 0.5**h
                x = a * F.col("z") + b
                q = 1 / (1 + F.exp(-x))
                w, slope = F.col("w"), F.col("w") * (q - F.col("t"))
                curve = w * q * (1 - q)
                loss = w * (F.greatest(x, F.lit(0.0)) - x * F.col("t") + F.log1p(F.exp(-F.abs(x))))
                sums.append(F.array(F.sum(loss), F.sum(slope * F.col("z")), F.sum(slope), F.sum(curve * F.col("z") * F.col("z")), F.sum(curve * F.col("z")), F.sum(curve)))
            rows = data.join(F.broadcast(now), by).groupBy(*by).agg(F.sum("w").alias("__n"), F.array(*sums).alias("__s")).collect()
            for k in open_.keys() - {tuple(r[c] for c in by) for r in rows}:
                groups[k][5] = True  # no row to learn from
            for row in rows:
                g = groups[tuple(row[c] for c in by)]
                # Newton's step is likely to be good, so the first halving that lowers the loss is taken.
                h = next((h for h in range(halvings) if g[4] is None or row["__s"][h][0] < g[4] - 1e-12 * abs(g[4])), None)
                if h is None:
                    g[5] = True
                    continue
                g[0], g[1] = max(g[0] + g[2] * 0.5**h, least), g[1] + g[3] * 0.5**h
                g[4], ga, gb, haa, hab, hbb = row["__s"][h]
                held = g[0] <= least and ga > 0
                if max(0.0 if held else abs(ga), abs(gb)) <= tolerance * row["__n"]:
                    g[5] = True
                det = haa * hbb - hab * hab
                if held or det <= 1e-12 * haa * hbb:
                    g[2], g[3] = (0.0, -gb / hbb) if hbb > 0 else (0.0, 0.0)
                else:
                    g[2], g[3] = (hab * gb - hbb * ga) / det, (hab * ga - haa * gb) / det
    finally:
        data.unpersist()
    return spark.createDataFrame([(*k, g[0], g[1], g[5]) for k, g in groups.items()], f"{kinds}, slope double, intercept double, converged boolean")


def affine_apply(p: str, slope: str, intercept: str, eps: float = 1e-6) -> Column:
    c = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    return F.when(F.col(p).isNotNull(), 1 / (1 + F.exp(-(F.col(slope) * F.ln(c / (1 - c)) + F.col(intercept)))))


def block_bootstrap(blocks: DataFrame, block: str, numerator: str, denominator: str, replicates: int, seed: int) -> DataFrame:
    """replicate, value: the ratio of sums over blocks drawn with replacement. blocks: one row of sums per block,
    dense block numbers from 0; draws are hashes, so they repeat on any cluster."""
    n = blocks.agg(F.count("*").alias("n"))
    draws = blocks.sparkSession.range(replicates).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(n)).select("replicate", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    chosen = draws.withColumn(block, F.pmod(F.xxhash64("replicate", "draw", F.lit(seed)), F.col("n"))).groupBy("replicate", block).agg(F.count("*").alias("times"))
    return chosen.join(blocks, block).groupBy("replicate").agg(F.try_divide(F.sum(F.col("times") * F.col(numerator)), F.sum(F.col("times") * F.col(denominator))).alias("value"))


def block_ap_parts(df: DataFrame, by: list[str], block: str, y: str, p: str, pos: str) -> DataFrame:
    """by, block, positives, precision_sum: each group's average precision as a sum of contributions of its blocks."""
    ranked = running_totals(df.select(*dict.fromkeys([*by, block, y, p, pos])), by, p, {"__r": F.lit(1).cast("long"), "__c": F.col(y).cast("long")}, ties=pos, down=True)
    return ranked.groupBy(*by, block).agg(F.sum(F.col(y).cast("long")).alias("positives"), F.coalesce(F.sum(F.when(F.col(y), F.col("__c") / F.col("__r"))), F.lit(0.0)).alias("precision_sum"))


def circular_null(df: DataFrame, part: list[str], run_pos: str, run_len: str, a: str, b: str, shifts: list[int]) -> DataFrame:
    """shift, n, agree of a with b rotated inside each run (part holds it)."""
    s = F.explode(F.array(*[F.lit(x).cast("long") for x in shifts])).alias("shift")
    left = df.select(*part, F.col(a).alias("__a"), run_pos, run_len, s).withColumn("__at", (F.col(run_pos) + F.col("shift")) % F.col(run_len))
    met = left.join(df.select(*part, F.col(run_pos).alias("__at"), F.col(b).alias("__b")), [*part, "__at"])
    return met.groupBy("shift").agg(F.count("*").alias("n"), F.sum((F.col("__a") == F.col("__b")).cast("long")).alias("agree"))


def upper_tail(null: DataFrame, by: list[str], value: str, observed: str) -> DataFrame:
    """by, p = (1 + values of at least the observed one) / (n + 1)."""
    return null.groupBy(*by).agg(((1 + F.count(F.when(F.col(value) >= F.col(observed), 1))) / (F.count("*") + 1)).alias("p"))


def fdr(df: DataFrame, p: str, family: int, q: float, parts: int = 256) -> DataFrame:
    """Adds passed: Benjamini-Hochberg over a frozen family size; null p-values fail and stay in the family.

    Ranks are running totals of counts over the distinct p, split by ranges, so no task sees all p-values."""
    ok = F.col(p).isNotNull() & ~F.isnan(F.col(p))
    counts = df.where(ok).groupBy(F.col(p).cast("double").alias("__p")).agg(F.count("*").alias("__n"))
    ranked = running_totals(counts, [], "__p", {"__rank": F.col("__n")}, parts=parts)
    ranks = ranked.where(F.col("__p") <= q * F.col("__rank") / family).agg(F.max("__p").alias("__cut"))
    return df.crossJoin(F.broadcast(ranks)).withColumn("passed", F.coalesce(ok & (F.col(p) <= F.col("__cut")), F.lit(False))).drop("__cut")


def simultaneous_lower(replicates: DataFrame, key: str, value: str, replicate: str, level: float) -> DataFrame:
    """key, mean, lower: the mean less the level-quantile, over replicates, of the largest deviation of any key."""
    means = replicates.groupBy(key).agg(F.avg(value).alias("mean"))
    worst = replicates.join(means, key).groupBy(replicate).agg(F.max(F.col(value) - F.col("mean")).alias("d")).agg(F.percentile("d", F.lit(level)).alias("q"))
    return means.crossJoin(F.broadcast(worst)).select(key, "mean", (F.col("mean") - F.col("q")).alias("lower"))


def shuffled_events(df: DataFrame, part: list[str], pos: str, event: str, seed: int) -> DataFrame:
    """As many events in each stream as it has, at hashed places."""
    w = Window.partitionBy(*part).orderBy(F.xxhash64(*part, pos, F.lit(seed)), pos)
    n = F.sum(F.col(event).cast("long")).over(Window.partitionBy(*part))
    return df.withColumn("__r", F.row_number().over(w)).withColumn("__n", n).where("__r <= __n").select(*part, pos)


def shuffled_places(events: DataFrame, rows: DataFrame, part: list[str], pos: str, kind: str, seeds: list[int]) -> DataFrame:
    """seed, part, kind, pos: for every seed as many places as a stream has events of a kind, drawn from the rows of
    that stream without repeats, each kind on its own. Places are the first in a salted order, so they repeat on any
    cluster; they are ranked by ranges of that order, so a stream is no single task's work."""
    wanted = events.groupBy(*part, kind).agg(F.count("*").alias("__n"))
    places = rows.select(*part, pos).join(wanted, part).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    order = seed_column(F.col("seed"), F.col(kind), *[F.col(c) for c in part], F.col(pos))
    ranked = numbered(places.withColumn("__h", order), [*part, kind, "seed"], "__h", "__r")
    return ranked.where("__r < __n").select("seed", *part, kind, pos)


def shuffled_scores(events: DataFrame, places: DataFrame, part: list[str], pos: str, kind: str, collar: int) -> DataFrame:
    """seed, kind, f1: how well places of each seed match the events one to one within the collar and their own stream, over
    all streams."""
    seeds = F.broadcast(places.select("seed").distinct())
    met = matched_events(events.select(*part, kind, pos).crossJoin(seeds), places, [*part, kind, "seed"], pos, collar)
    sums = met.groupBy("seed", kind).agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "n_matched")])
    return sums.select("seed", kind, F.try_divide(2.0 * F.col("n_matched"), F.col("n_true") + F.col("n_pred")).alias("f1"))


def rate_gate(df: DataFrame, by: list[str], y: str, predicted: Column, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """by, ratio of predicted to true positive rate, and whether it lies in [low, high]."""
    r = F.try_divide(F.avg(predicted.cast("double")), F.avg(F.col(y).cast("double")))
    return df.groupBy(*by).agg(r.alias("ratio")).withColumn("within", F.coalesce(F.col("ratio").between(low, high), F.lit(False)))


def analytic_chance(width: Column, tolerance: int) -> Column:
    """Chance that a uniform guess of an offset in width places is within tolerance of a uniform truth."""
    near = width * (2 * tolerance + 1) - tolerance * (tolerance + 1)
    return F.when(width > tolerance, near / (width * width)).when(width > 0, 1.0)


def oracle_threshold(df: DataFrame, by: list[str], y: str, p: str, steps: int = 199) -> DataFrame:
    """by, threshold, f1: among quantiles of p and 0.5 the threshold of highest F1, ties to the higher. Each row counts
    once, under the highest threshold that it reaches; windows run over these counts, some 200 of a group."""
    # Each distinct value tells which of the wanted ranks it holds, of which only those near its own share are tried.
    share = lambda rank: (rank / F.greatest(F.col("n") - 1, F.lit(1)) - 0.005) / 0.99 * (steps - 1)
    first, last = F.floor(share(F.col("upto") - F.col("c") - 1)) - 1, F.ceil(share(F.col("upto"))) + 1
    tried = F.sequence(F.greatest(F.least(first, F.lit(steps - 1)), F.lit(0)), F.greatest(F.least(last, F.lit(steps - 1)), F.lit(0)))
    asked = F.transform(tried, lambda i: F.struct(i.alias("i"), ((F.col("n") - 1) * (F.lit(0.005) + F.lit(0.99) * i / F.lit(float(steps - 1)))).alias("at")))
    holds = lambda rank: (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
    held = F.filter(asked, lambda a: holds(F.floor(a["at"])) | holds(F.ceil(a["at"])))
    found = ranked_values(df, by, p).select(*by, "v", F.explode(held).alias("a")).groupBy(*by, "a.i").agg(F.max("a.at").alias("at"), F.min("v").alias("l"), F.max("v").alias("h"))
    quantile = F.when(F.col("l") == F.col("h"), F.col("l")).otherwise((F.ceil("at") - F.col("at")) * F.col("l") + (F.col("at") - F.floor("at")) * F.col("h"))
    cand = found.groupBy(*by).agg(F.collect_list(quantile).alias("__q"))
    cand = cut(df.select(*by).distinct().join(cand, by, "left").select(*by, F.array_sort(F.array_distinct(F.array_append(F.coalesce("__q", F.array().cast("array<double>")), F.lit(0.5)))).alias("__c")))
    rank = F.size(F.filter("__c", lambda t: t <= F.col(p)))
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("__y"), F.count("*").alias("__n")).join(cand, by).groupBy(*by, rank.alias("__r")).agg(F.sum("__y").alias("__y"), F.sum("__n").alias("__n"))
    every = cand.select(*by, F.posexplode("__c").alias("__i", "t")).withColumn("__r", F.col("__i") + 1).drop("__i")
    every = every.unionByName(cand.select(*by, F.lit(None).cast("double").alias("t"), F.lit(0).alias("__r")))
    down = Window.partitionBy(*by).orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)
    summed = every.join(counts, [*by, "__r"], "left").withColumn("tp", F.sum(F.coalesce("__y", F.lit(0))).over(down)).withColumn("pp", F.sum(F.coalesce("__n", F.lit(0))).over(down)).withColumn("pos", F.sum("__y").over(Window.partitionBy(*by)))
    scored = summed.withColumn("f1", F.try_divide(2.0 * F.col("tp"), F.col("pp") + F.col("pos"))).where("f1 IS NOT NULL AND t IS NOT NULL")
    return scored.groupBy(*by).agg(F.max(F.struct("f1", "t")).alias("x")).select(*by, F.col("x.t").alias("threshold"), F.col("x.f1").alias("f1"))


def lag_verdict(df: DataFrame, by: list[str], lag: str, score: str, guard: int) -> DataFrame:
    """by, winner, margin: the lag of the highest score (ties: the smallest lag) and its lead over the best lag that
    is more than guard places away."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(lag, score), F.struct(F.col(score), (-F.col(lag)).alias("l"))).alias("x")).select(*by, F.col(f"x.{lag}").alias("winner"), F.col(f"x.{score}").alias("top"))
    second = df.join(best, by).where(F.abs(F.col(lag) - F.col("winner")) > guard).groupBy(*by, "winner", "top").agg(F.max(score).alias("next"))
    return best.join(second.select(*by, "next"), by, "left").select(*by, "winner", (F.col("top") - F.col("next")).alias("margin"))


def fold_lifts(df: DataFrame, fold: str, lag: str, value: str) -> DataFrame:
    """fold, lag, lift: each non-negative lag over the best negative lag of its fold."""
    base = df.where(F.col(lag) < 0).groupBy(fold).agg(F.max(value).alias("__b"))
    return df.where(F.col(lag) >= 0).join(base, fold).select(fold, lag, (F.col(value) - F.col("__b")).alias("lift"))


def decision(df: DataFrame, key: str, delta: str, least_gain: float, least_same: int, worst: float) -> DataFrame:
    """mean_delta, improved, worst_delta, adopt: gain, enough streams of the same sign and no stream below the guard."""
    out = df.agg(F.avg(delta).alias("mean_delta"), F.count(F.when(F.col(delta) > 0, 1)).alias("improved"), F.min(delta).alias("worst_delta"))
    return out.withColumn("adopt", (F.col("mean_delta") >= least_gain) & (F.col("improved") >= least_same) & (F.col("worst_delta") >= worst))


def recomputed_verdicts(stored: DataFrame, fresh: DataFrame, keys: list[str], margin: str, tolerance: float) -> DataFrame:
    """keys, agrees: whether the stored margin equals the recomputed one within tolerance; a missing side doesn't."""
    j = stored.select(*keys, F.col(margin).alias("__s")).join(fresh.select(*keys, F.col(margin).alias("__f")), keys, "full")
    return j.select(*keys, F.coalesce(F.abs(F.col("__s") - F.col("__f")) <= tolerance, F.lit(False)).alias("agrees"))


def most_alive(df: DataFrame, by: list[str], probe: str, edges: list[str], least: float) -> DataFrame:
    """by, probe, motion, alive: the probe whose weakest edge moves most, and whether it moves at least `least`."""
    weakest = F.least(*edges)
    return df.groupBy(*by).agg(F.max(F.struct(weakest.alias("m"), (-F.col(probe)).alias("q"))).alias("x")).select(*by, (-F.col("x.q")).alias(probe), F.col("x.m").alias("motion"), (F.col("x.m") >= least).alias("alive"))


def median_argmax(events: DataFrame, by: list[str], event: str, lag: str, score: str, replicates: int, seed: int) -> DataFrame:
    """by, replicate, winner: for events drawn with replacement the lag of the highest median score, the smallest on
    ties. events: one row per (by, event, lag); draws are hashes, so they repeat on any cluster."""
    ids = events.select(*by, event).distinct().withColumn("__at", (F.row_number().over(Window.partitionBy(*by).orderBy(event)) - 1).cast("long"))
    n = ids.groupBy(*by).agg(F.count("*").alias("__n"))
    draws = n.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    drawn = draws.withColumn("__at", F.pmod(F.xxhash64(*by, "replicate", "__d", F.lit(seed)), F.col("__n"))).groupBy(*by, "replicate", "__at").agg(F.count("*").alias("__times"))
    met = drawn.join(ids, [*by, "__at"]).join(events, [*by, event])
    middle = met.groupBy(*by, "replicate", lag).agg(F.percentile(score, F.lit(0.5), F.col("__times")).alias("__m"))
    return middle.groupBy(*by, "replicate").agg(F.max_by(lag, F.struct("__m", (-F.col(lag)).alias("l"))).alias("winner"))


def block_agreement(events: DataFrame, by: list[str], event: str, lag: str, score: str, blocks: int, reach: int) -> DataFrame:
    """by, lowest, highest, agrees: the winning lag (highest mean score, the smallest on ties) of each of several
    stretches of a group's events in order, and whether all lie within reach of each other."""
    cut = events.select(*by, event).distinct().withColumn("__b", F.ntile(blocks).over(Window.partitionBy(*by).orderBy(event)))
    mean = events.join(cut, [*by, event]).groupBy(*by, "__b", lag).agg(F.round(F.avg(score), 9).alias("__m"))
    best = mean.groupBy(*by, "__b").agg(F.max_by(lag, F.struct("__m", (-F.col(lag)).alias("l"))).alias("w"))
    return best.groupBy(*by).agg(F.min("w").alias("lowest"), F.max("w").alias("highest")).withColumn("agrees", F.col("highest") - F.col("lowest") <= reach)


def bind_confidence(df: DataFrame, by: list[str], unit: str, support: str, score: str, least: float) -> DataFrame:
    """by, unit, confidence, trusted: each group's best unit (the first name on ties), its support times 0.65 of its
    score and 0.35 of its lead over the next one, and whether that is enough."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), unit)
    led = df.withColumn("__r", F.row_number().over(w)).withColumn("__next", F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    confidence = F.col(support) * (0.65 * F.col(score) + 0.35 * (F.col(score) - F.col("__next")))
    return led.where("__r = 1").select(*by, unit, confidence.alias("confidence")).withColumn("trusted", F.col("confidence") >= least)
