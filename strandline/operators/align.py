"""Joins by index, shift, nearness, interval and vicinity.

No join here pairs all rows of two tables: each has an equality (an index, a bucket, a stream) or one side
that the caller states (a query set, an interval list); broadcast is left to Spark, which checks sizes.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ranges import cut


def matched_rows(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """n_left, n_right, n_matched, n_unmatched of an equi-join on unique keys."""
    both = left.select(*keys, F.lit(1).alias("__l")).join(right.select(*keys, F.lit(1).alias("__r")), keys, "full")
    out = both.agg(F.count("__l").alias("n_left"), F.count("__r").alias("n_right"), F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("n_matched"))
    return out.withColumn("n_unmatched", F.col("n_left") + F.col("n_right") - 2 * F.col("n_matched"))


def shift_sweep(left: DataFrame, right: DataFrame, part: list[str], pos: str, a: str, b: str, reach: int) -> DataFrame:
    """shift, n, agree: how often a at pos equals b at pos + shift, for shifts of -reach to reach."""
    shifted = left.select(*part, F.col(a).alias("__a"), F.col(pos).alias("__p"), F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("shift")).withColumn("__at", F.col("__p") + F.col("shift"))
    found = shifted.join(right.select(*part, F.col(pos).alias("__at"), F.col(b).alias("__b")), [*part, "__at"])
    return found.groupBy("shift").agg(F.count("*").alias("n"), F.sum((F.col("__a") == F.col("__b")).cast("long")).alias("agree"))


def on_support(df: DataFrame, reference: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows of df that reference has, with conflict: whether the payloads differ (they must not)."""
    ref = reference.select(*keys, F.col(payload).alias("__ref"))
    return df.join(ref, keys).withColumn("conflict", ~F.col(payload).eqNullSafe(F.col("__ref"))).drop("__ref")


def nearest_event(true: DataFrame, predicted: DataFrame, part: list[str], t: str, most: int) -> DataFrame:
    """part, t, offset: the nearest predicted time less t, the earlier on ties, if at most `most` away.

    The two event lists are united and the last predicted time before and the first after are carried
    along the stream, so cost is a sort, not a product."""
    rows = true.select(*part, t, F.lit(True).alias("__true")).unionByName(predicted.select(*part, t, F.lit(False).alias("__true")))
    when_pred = F.when(~F.col("__true"), F.col(t))
    # Read backwards for what follows: Spark computes a frame that reaches to the end anew for every row.
    past = F.max(when_pred).over(Window.partitionBy(*part).orderBy(F.asc(t)).rangeBetween(Window.unboundedPreceding, 0))
    future = F.min(when_pred).over(Window.partitionBy(*part).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("__a", past - F.col(t)).withColumn("__b", future - F.col(t)).where("__true")
    offset = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).when(-F.col("__a") <= F.col("__b"), F.col("__a")).otherwise(F.col("__b"))
    return both.withColumn("offset", offset).where(F.abs("offset") <= most).select(*part, t, "offset")


def nearest_in_reach(true: DataFrame, predicted: DataFrame, part: list[str], t: str, reach: int) -> DataFrame:
    """part, t, offset by a bucketed range join over ±reach, first minimum; the variant that lists candidates."""
    width = reach + 1
    left = true.select(*part, t).withColumn("__k", F.explode(F.array(*[F.floor(F.col(t) / width) + d for d in (-1, 0, 1)])))
    right = predicted.select(*part, F.col(t).alias("__u")).withColumn("__k", F.floor(F.col("__u") / width))
    near = left.join(right, [*part, "__k"]).where(F.abs(F.col("__u") - F.col(t)) <= reach)
    best = F.min(F.struct(F.abs(F.col("__u") - F.col(t)).alias("d"), F.col("__u").alias("u")))
    return near.groupBy(*part, t).agg(best.alias("x")).select(*part, t, (F.col("x.u") - F.col(t)).alias("offset"))


def matched_events(true: DataFrame, predicted: DataFrame, part: list[str], t: str, collar: int) -> DataFrame:
    """part, n_true, n_pred, n_matched: one-to-one matches within ±collar, greedy in time order.

    Collar 0 is an equi-join. Else both event lists are dealt by stream and sorted by Spark (which spills) and pass
    through their task batch by batch; what is carried is the unmatched times within reach, however long the
    stream is. A NULL time counts as an event but matches nothing."""
    counts = true.groupBy(*part).agg(F.count("*").alias("n_true")).join(predicted.groupBy(*part).agg(F.count("*").alias("n_pred")), part, "full")
    if collar == 0:
        met = true.select(*part, t).join(predicted.select(*part, t), [*part, t]).groupBy(*part).agg(F.count("*").alias("n_matched"))
    else:
        both = true.select(*part, F.col(t).cast("long").alias("__t"), F.lit(0).alias("__side")).unionByName(predicted.select(*part, F.col(t).cast("long").alias("__t"), F.lit(1).alias("__side")))
        ordered = both.where("__t IS NOT NULL").repartition(*part).sortWithinPartitions(*part, "__t", "__side")

        def run(batches):
            stream, waiting = None, (deque(), deque())
            for batch in batches:
                keys = zip(*[batch.column(n).to_pylist() for n in range(len(part))], strict=True)
                out = []
                for key, at, side in zip(keys, *[batch.column(n).to_pylist() for n in (-2, -1)], strict=True):
                    if key != stream:
                        stream, waiting = key, (deque(), deque())
                    for queue in waiting:
                        while queue and at - queue[0] > collar:
                            queue.popleft()
                    met_here = bool(waiting[1 - side])
                    if met_here:
                        waiting[1 - side].popleft()
                    else:
                        waiting[side].append(at)
                    out.append(met_here)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(part)], pa.array(out, pa.bool_())], names=[*part, "__met"])

        fields = [both.schema[c] for c in part]
        flags = ordered.mapInArrow(run, T.StructType([*fields, T.StructField("__met", T.BooleanType())]))
        met = flags.groupBy(*part).agg(F.sum(F.col("__met").cast("long")).alias("n_matched"))
    zero = F.lit(0)
    return counts.join(met, part, "left").select(*part, *[F.coalesce(c, zero).cast("long").alias(c) for c in ("n_true", "n_pred", "n_matched")])


def close_states(df: DataFrame, equal: list[str], x: str, y: str, pos: str, action: str, radius: float, least_gap: int) -> DataFrame:
    """pos, ambiguous: rows with a neighbour within radius in (x, y), equal keys and at least least_gap apart, and
    whether any such neighbour acts differently.

    Cells are a radius wide. Of every quarter of a cell and action (of which there are few) the box of its rows and their first and
    last position are known, and each row gets those of the nine cells around it. Boxes wholly within the radius settle what they
    can. A box on the border meets a row, row by row, only while the row isn't known to be ambiguous and the box's positions and
    action could still tell. So a dense cell is read once, however many pairs it has."""
    side = radius / 2
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*equal, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(pos).alias("__p"), F.col(action).alias("__a"))
    rows = rows.withColumn("__i", F.floor(F.col("__x") / side)).withColumn("__j", F.floor(F.col("__y") / side))
    rows = cut(rows.withColumn("__k", F.floor(F.col("__i") / 2)).withColumn("__l", F.floor(F.col("__j") / 2)))
    cell, whole = [*equal, "__i", "__j"], [*equal, "__k", "__l"]
    ends = [f(c).alias(n) for f, c, n in ((F.min, "__p", "lo"), (F.max, "__p", "hi"), (F.min, "__x", "x0"), (F.max, "__x", "x1"), (F.min, "__y", "y0"), (F.max, "__y", "y1"))]
    boxes = rows.groupBy(*whole, F.col("__i").alias("i"), F.col("__j").alias("j"), F.col("__a").alias("a")).agg(*ends)
    lists = boxes.groupBy(*whole).agg(F.collect_list(F.struct("i", "j", "a", "lo", "hi", "x0", "x1", "y0", "y1")).alias("boxes"))
    steps = F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("l")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = lists.withColumn("at", F.explode(steps)).select(*equal, (F.col("__k") + F.col("at.k")).alias("__k"), (F.col("__l") + F.col("at.l")).alias("__l"), "boxes")
    told = spread.groupBy(*whole).agg(F.flatten(F.collect_list("boxes")).alias("__boxes"))

    def reach(b, far):
        def away(c, low, high):
            return F.greatest(F.abs(c - low), F.abs(c - high)) if far else F.greatest(low - c, c - high, F.lit(0.0))

        dx, dy = away(F.col("__x"), b["x0"], b["x1"]), away(F.col("__y"), b["y0"], b["y1"])
        return dx * dx + dy * dy <= radius * radius

    def apart(b):
        return (b["lo"] <= F.col("__p") - least_gap) | (b["hi"] >= F.col("__p") + least_gap)

    seen = rows.join(told, whole).withColumn("__boxes", F.filter("__boxes", lambda b: apart(b) & reach(b, False)))
    seen = seen.withColumn("__in", F.filter("__boxes", lambda b: reach(b, True)))
    seen = seen.withColumn("__known", F.size("__in") > 0).withColumn("ambiguous", F.exists("__in", lambda b: b["a"] != F.col("__a")))
    border = F.filter("__boxes", lambda b: ~F.col("ambiguous") & ~reach(b, True) & (~F.col("__known") | (b["a"] != F.col("__a"))))
    seen = cut(seen.select(*equal, "__p", "__x", "__y", "__a", "__known", "ambiguous", F.transform(border, lambda b: F.struct(b["i"].alias("i"), b["j"].alias("j"), b["a"].alias("a"))).alias("__border")))
    asked = seen.select(*equal, "__p", "__x", "__y", "__a", F.explode("__border").alias("c")).select("*", F.col("c.i").alias("__i"), F.col("c.j").alias("__j"), F.col("c.a").alias("__b")).drop("c")
    there = rows.select(*cell, F.col("__x").alias("__u"), F.col("__y").alias("__v"), F.col("__p").alias("__q"), F.col("__a").alias("__b"))
    near = (F.col("__x") - F.col("__u")) ** 2 + (F.col("__y") - F.col("__v")) ** 2 <= radius * radius
    met = asked.join(there, [*cell, "__b"]).where((F.abs(F.col("__p") - F.col("__q")) >= least_gap) & near).select(*equal, "__p", (F.col("__a") != F.col("__b")).alias("ambiguous"))
    return seen.where("__known").select(*equal, "__p", "ambiguous").unionByName(met).groupBy(*equal, F.col("__p").alias(pos)).agg(F.max("ambiguous").alias("ambiguous"))


def future_values(df: DataFrame, part: list[str], idx: str, value: str, horizons: list[int]) -> DataFrame:
    """part, idx, horizon, later: the value at exactly idx + horizon, by index so that gaps have none."""
    ahead = df.select(*part, idx, F.explode(F.array(*[F.lit(h).cast("long") for h in horizons])).alias("horizon")).withColumn("__at", F.col(idx) + F.col("horizon"))
    return ahead.join(df.select(*part, F.col(idx).alias("__at"), F.col(value).alias("later")), [*part, "__at"]).select(*part, idx, "horizon", "later")


def in_intervals(points: DataFrame, intervals: DataFrame, part: list[str], t: str, start: str, end: str, bucket: float, out: str = "inside") -> DataFrame:
    """Adds out: whether t lies in some half-open interval of its part. A range join over buckets of time: each
    bucket has its intervals as one list, so the points are read and moved once and none of them repeats."""
    spans = intervals.select(*part, start, end, F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))).alias("__k"))
    low, high = F.greatest(F.col(start), F.col("__k") * bucket), F.least(F.col(end), (F.col("__k") + 1) * bucket)
    # Overlapping intervals of a bucket become disjoint ones, at most as many as the bucket has places.
    w = Window.partitionBy(*part, "__k").orderBy("__low", "__high")
    cut = spans.select(*part, "__k", low.alias("__low"), high.alias("__high")).where("__low < __high").distinct()
    reach = F.max("__high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = cut.withColumn("__new", F.coalesce((F.col("__low") > reach).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*part, "__k", "__run").agg(F.min("__low").alias("low"), F.max("__high").alias("high"))
    lists = merged.groupBy(*part, "__k").agg(F.collect_list(F.struct("low", "high")).alias("__spans"))
    keyed = points.withColumn("__k", F.floor(F.col(t) / bucket))
    found = F.exists("__spans", lambda x: (F.col(t) >= x["low"]) & (F.col(t) < x["high"]))
    return keyed.join(lists, [*part, "__k"], "left").withColumn(out, F.coalesce(found, F.lit(False))).select(*points.columns, out)


def offset_pairs(df: DataFrame, part: list[str], pos: str, offset: int) -> DataFrame:
    """part, target, observed: transitions (t-1, t) and (t+offset-1, t+offset) that both lie in one run (part holds it)."""
    ends = df.select(*part, F.col(pos).alias("target")).join(df.select(*part, (F.col(pos) + 1).alias("target")), [*part, "target"])
    return ends.withColumn("observed", F.col("target") + offset).join(ends.select(*part, F.col("target").alias("observed")), [*part, "observed"]).select(*part, "target", "observed")


def common_support(df: DataFrame, part: list[str], pos: str, active: str, low: int, high: int) -> DataFrame:
    """Rows whose whole frame pos+low .. pos+high exists in the run and is active."""
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(low, high)
    return df.withColumn("__n", F.count("*").over(w)).withColumn("__off", F.sum((~F.col(active)).cast("long")).over(w)).where((F.col("__n") == high - low + 1) & (F.col("__off") == 0)).drop("__n", "__off")


#: Candidates that a task of ranked_references() holds, and parts of the references.
QUERIES, REFERENCE_PARTS = 16_384, 32


def ranked_references(candidates: DataFrame, references: DataFrame, cid: str, rid: str, vector: str, top: int) -> DataFrame:
    """cid, rid, similarity, rank: the top references of each candidate by cosine (6 digits), ties by rid, its own id apart.

    candidates is a stated query set, references any table. A task holds up to QUERIES of the candidates as a matrix, and its
    part of the references passes by in order of rid, so that of each candidate only the top of a part is shuffled. Vectors are
    of one length; a pair with a NULL (also in a vector) or without a direction has a NULL similarity and comes last. ids are of one type."""
    asked = candidates.select(F.col(cid).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    groups = max(1, -(-asked.count() // QUERIES))
    every = lambda n: F.explode(F.array(*[F.lit(i) for i in range(n)]))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    holding = asked.select(dealt(groups).alias("group"), every(REFERENCE_PARTS).alias("part"), F.lit(False).alias("passing"), "id", "v")
    passing = references.select(F.col(rid).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    passing = passing.select(every(groups).alias("group"), dealt(REFERENCE_PARTS).alias("part"), F.lit(True).alias("passing"), "id", "v")
    met = holding.unionByName(passing).repartition(groups * REFERENCE_PARTS, "group", "part").sortWithinPartitions("group", "part", "passing", "id")
    out = T.StructType([T.StructField(cid, candidates.schema[cid].dataType), T.StructField(rid, references.schema[rid].dataType), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        key, held = None, None

        def told():
            if held and held.best is not None:
                yield from held.told(arrow)

        for batch in batches:
            # Runs of one (group, part, side) within the batch.
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            edges = [0, *(np.nonzero((np.diff(marks, axis=1) != 0).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                if at == end:
                    continue
                if key != (own := tuple(marks[:2, at])):
                    yield from told()
                    key, held = own, _Top(top)
                some = batch.slice(at, end - at)
                (held.meet if marks[2, at] else held.hold)(some.column("id").to_pylist(), some.column("v"))
        yield from told()

    w = Window.partitionBy(cid).orderBy(F.desc("similarity"), rid)
    return met.mapInArrow(run, out).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


class _Top:
    """Candidates, and the top of the references that have passed, which come in order of their ids."""

    UNKNOWN, NEVER = -2.0, -3.0

    def __init__(self, top: int):
        self.top, self.ids, self.vectors, self.best, self.others = top, [], [], None, []

    def hold(self, ids: list, vectors: pa.Array) -> None:
        self.ids += ids
        self.vectors.append(vectors)

    @staticmethod
    def unit(vectors: pa.Array, width: int) -> np.ndarray:
        """Unit vectors; NaN for one that is NULL, holds a NULL, is of another length or zero."""
        out = np.full((len(vectors), width), np.nan)
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy()
        if (fit := lengths == width).any() and width:
            out[fit] = vectors.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        with np.errstate(all="ignore"):
            return out / np.sqrt((out * out).sum(axis=1, keepdims=True))

    def meet(self, ids: list, vectors: pa.Array) -> None:
        if not self.ids:
            return
        if self.best is None:
            lists = pa.concat_arrays(self.vectors)
            self.width = pc.max(pc.list_value_length(lists)).as_py() or 0
            self.vectors, self.where = self.unit(lists, self.width), {}
            for i, x in enumerate(self.ids):
                self.where.setdefault(x, []).append(i)
            self.best, self.at = np.full((len(self.ids), self.top), self.NEVER), np.zeros((len(self.ids), self.top), np.int64)
        others = self.unit(vectors, self.width)
        for start in range(0, len(ids), 256):
            similar = np.round(self.vectors @ others[start : start + 256].T, 6)
            similar[np.isnan(similar)] = self.UNKNOWN
            for j, x in enumerate(ids[start : start + 256]):
                if x in self.where:
                    similar[self.where[x], j] = self.NEVER
            # Of equal ones the earlier stays, whose id is smaller.
            rows = np.nonzero((similar > self.best[:, -1:]).any(axis=1))[0]
            both = np.concatenate((self.best[rows], similar[rows]), axis=1)
            number = np.concatenate((self.at[rows], np.broadcast_to(np.arange(similar.shape[1]) + len(self.others) + start, (len(rows), similar.shape[1]))), axis=1)
            first = np.argsort(-both, axis=1, kind="stable")[:, : self.top]
            self.best[rows], self.at[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(number, first, 1)
        self.others += ids

    def told(self, schema: pa.Schema):
        row, place = np.nonzero(self.best > self.NEVER)
        similar = self.best[row, place]
        columns = [[self.ids[i] for i in row], [self.others[i] for i in self.at[row, place]], [None if s == self.UNKNOWN else float(s) for s in similar]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def precedence_merge(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, conflict: right wins over left; conflict where both have one and they differ."""
    a, b = left.select(*keys, F.col(value).alias("__l")), right.select(*keys, F.col(value).alias("__r"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("__r", "__l").alias(value), F.coalesce(F.col("__l") != F.col("__r"), F.lit(False)).alias("conflict"))


def intersected(df: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Adds low, high: the intersection of two ranges of a row, null if it is empty; a rectangle is two such ranges."""
    low, high = F.greatest(a[0], b[0]), F.least(a[1], b[1])
    return df.withColumn("low", F.when(low < high, low)).withColumn("high", F.when(low < high, high))


def linked_clusters(spans: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
    """Adds cluster: single-link clusters of overlapping ranges of a part, as the smallest start. On a line the
    closure is a running maximum."""
    w = Window.partitionBy(*part).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__n", F.when(F.col(start) < reach, F.lit(None)).otherwise(F.col(start)))
    return marked.withColumn("cluster", F.last("__n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """n_shared: how many distinct keys both hold; 0 proves them disjoint."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys).agg(F.count("*").alias("n_shared"))


def agreed_verdicts(first: DataFrame, second: DataFrame, keys: list[str], verdict: str, confidence: str, ranks: dict[str, int]) -> DataFrame:
    """keys, verdict, confidence: where two verdicts agree, with the weaker confidence; else 'unknown' and the weakest."""
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (v, k)])
    a = first.select(*keys, F.col(verdict).alias("__a"), F.col(confidence).alias("__p"))
    b = second.select(*keys, F.col(verdict).alias("__b"), F.col(confidence).alias("__q"))
    same = F.col("__a") == F.col("__b")
    least = F.least(F.element_at(table, F.col("__p")), F.element_at(table, F.col("__q")))
    weakest = min(ranks, key=ranks.get)
    return a.join(b, keys).select(*keys, F.when(same, F.col("__a")).otherwise("unknown").alias(verdict), F.when(same, F.element_at(names, least)).otherwise(weakest).alias(confidence))


def adjacent_pairs(df: DataFrame, part: list[str], pos: str) -> DataFrame:
    """part, a, b: each two neighbours in order, and first with last, without repeats."""
    w = Window.partitionBy(*part).orderBy(pos)
    near = df.select(*part, F.col(pos).alias("a"), F.lead(pos).over(w).alias("b")).where("b IS NOT NULL")
    ends = df.groupBy(*part).agg(F.min(pos).alias("a"), F.max(pos).alias("b")).where("a < b")
    return near.unionByName(ends).distinct()


def best_assignment(units: DataFrame, roles: list[str], role: str, unit: str, members: str, score: str) -> DataFrame:
    """One unit for each role, with disjoint members, of the highest total score; ties by unit ids in role order.
    units is a declared small set (tens); each join prunes by arrays_overlap."""
    out = None
    for i, r in enumerate(roles):
        one = units.where(F.col(role) == r).select(F.col(unit).alias(f"unit_{r}"), F.col(members).alias(f"__m{i}"), F.col(score).alias(f"__s{i}"))
        out = one if out is None else out.join(one, ~F.arrays_overlap(F.concat(*[F.col(f"__m{j}") for j in range(i)]), F.col(f"__m{i}")))
    total = sum((F.col(f"__s{i}") for i in range(1, len(roles))), F.col("__s0"))
    ids = [f"unit_{r}" for r in roles]
    return out.select(*ids, total.alias("total")).orderBy(F.desc("total"), *ids).limit(1)
