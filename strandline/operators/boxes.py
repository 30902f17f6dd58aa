"""Boxes (axis-parallel rectangles): overlap joins on a grid, and clusters of linked boxes.

Two boxes are linked if they overlap after each has grown by `gap` to the right and below, so if the free
space between them is less than the gap in both directions; touching with a gap of 0 is no overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .ranges import cut, over_ranges, smallest_reachable


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


#: Boxes in cells that a task of overlap_pairs takes: few enough for its idents to fit the dictionary of a Parquet column, 1 MB.
TASK_BOXES = 130_000
#: Where two boxes may start that are paired in a cell: 1, in its columns; 2, in its rows; 3, in both; 0, in neither. Boxes of the first kind come in this order.
MEETINGS = ((3, 3, "__y0"), (3, 1, "__y0"), (3, 2, "__y0"), (3, 0, "__y0"), (1, 2, "__y1"))


def overlap_pairs(boxes: DataFrame, part: list[str], ident: str, x0: str, x1: str, y0: str, y1: str, gap: float, cell: float, height: float | None = None) -> DataFrame:
    """part, a, b (a < b): all pairs of linked boxes of a part. Cells are `cell` wide and `height` (or `cell`) high.

    A box lies in every cell it covers. Two linked boxes share the cell that holds the upper left corner of their
    intersection, and are paired in that cell only, so no pair comes twice. There one box starts in both directions, or one in each:
    a join for each such case, so that few boxes are compared in vain. As many rows as there are pairs, though boxes are shuffled once.
    Boxes with much the same partners come one after the other, each with its partners by ident, so that rows repeat what came
    shortly before and are stored in few bytes."""
    height = cell if height is None else height
    grown = boxes.select(*part, F.col(ident).alias("__i"), F.col(x0).alias("__x0"), (F.col(x1) + gap).alias("__x1"), F.col(y0).alias("__y0"), (F.col(y1) + gap).alias("__y1"))
    # A box with a negative extent lies in the cell where it starts, as pairs are found where the later of two starts.
    spans = [(F.col(f"__{c}0"), F.greatest(f"__{c}0", f"__{c}1"), size) for c, size in (("x", cell), ("y", height))]
    copies = [F.floor(high / size) - F.floor(low / size) + 1 for low, high, size in spans]
    count = grown.agg(F.sum(copies[0] * copies[1])).first()[0] or 0
    tasks = max(-(-int(count) // TASK_BOXES), boxes.sparkSession.sparkContext.defaultParallelism)
    keys = [*part, "__cx", "__cy"]
    shuffled = grown.withColumn("__cx", _cells(*spans[0])).withColumn("__cy", _cells(*spans[1])).repartition(tasks, *keys)
    # Always true. Without it Spark would drop a sort right below a join, and shuffle anew for each kind.
    kept = F.monotonically_increasing_id() >= 0
    starts = F.when(F.floor(F.col("__x0") / cell) == F.col("__cx"), 1).otherwise(0) + F.when(F.floor(F.col("__y0") / height) == F.col("__cy"), 2).otherwise(0)
    placed = shuffled.where(kept).withColumn("__s", starts)
    others = placed.select(*keys, *[F.col(f"__{c}").alias(f"__o{c}") for c in ("s", "i", "x0", "x1", "y0", "y1")])
    linked = []
    for kind, other, order in MEETINGS:
        met = placed.where(F.col("__s") == kind).sortWithinPartitions(*keys, order).where(kept).join(others.where(F.col("__os") == other).sortWithinPartitions(*keys, "__oi").where(kept), keys)
        overlap = met.where("__y0 < __oy1 AND __oy0 < __y1 AND __x0 < __ox1 AND __ox0 < __x1").where("__i < __oi" if kind == other else "__i <> __oi")
        linked.append(overlap.select(*part, F.least("__i", "__oi").alias("a"), F.greatest("__i", "__oi").alias("b")))
    return reduce(DataFrame.unionByName, linked)


class Skyline:
    """For every y how far to the right the boxes met so far reach, and one box linked to that which reaches so far."""

    def __init__(self, pieces=None):
        self.at, self.reach, self.owner = map(list, pieces or ([-inf], [-inf], [None]))

    def pieces(self):
        return self.at, self.reach, self.owner

    def add(self, x0, x1, y0, y1, ident) -> set:
        """Adds a box that starts at x0, no further left than those before; returns owners whose boxes it overlaps.
        Of boxes alive at one y all overlap each other, so one stands for them: the last, also where another reaches further.
        So a box's whole height has one owner after it, and owners met are few for each box, however many overlap."""
        i, j = bisect_right(self.at, y0) - 1, bisect_left(self.at, y1)
        met, at, reach, owner = set(), [], [], []

        def put(a, r, o):
            if not at or (reach[-1], owner[-1]) != (r, o):
                at.append(a)
                reach.append(r)
                owner.append(o)

        for k in range(i, j):
            a, b = self.at[k], self.at[k + 1] if k + 1 < len(self.at) else inf
            r, o = (self.reach[k], self.owner[k]) if self.reach[k] > x0 else (-inf, None)
            if o is not None:
                met.add(o)
            if a < y0:
                put(a, r, o)
            put(max(a, y0), max(r, x1), ident)
            if y1 < b:
                put(y1, r, o)
        self.at[i:j], self.reach[i:j], self.owner[i:j] = at, reach, owner
        return met

    def raised(self, later) -> Skyline:
        """This skyline with a later one over it."""
        out = Skyline(self.pieces())
        for k, (a, r, o) in enumerate(zip(*later, strict=True)):
            if o is not None:
                out.add(-inf, r, a, later[0][k + 1] if k + 1 < len(later[0]) else inf, o)
        return out


def _least_of(links: list[tuple]):
    """(member, least member) of the components of a range's links."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, top) for x in parent if (top := root(x)) != x]


def linked_boxes(boxes: DataFrame, part: list[str], ident: str, x0: str, x1: str, y0: str, y1: str, gap: float, band: float) -> DataFrame:
    """boxes and cluster: the smallest ident of the boxes linked to a box directly or through others (single link).

    Boxes lie in each horizontal band (of height `band`) they cover and are swept from left to right. The sweep keeps
    a skyline, so a box is linked with one box of a pile in place of all of it. A band is cut into ranges of x that are swept in
    parallel: each range's skyline is made first, and that of all ranges before it is where its sweep starts. So a band or cell that
    holds a third of all boxes is many tasks' work, and no list of pairs is made. Links contract within a range, then in
    rounds over all. A skyline has at most two pieces a box alive at its x. ident is unique and without nulls; a box without extent after
    growing, or with a null, is alone."""
    low, high = F.col(y0).cast("double"), (F.col(y1) + gap).cast("double")
    grown = boxes.select(*part, F.col(ident).alias("__i"), F.col(x0).cast("double").alias("__x0"), (F.col(x1) + gap).cast("double").alias("__x1"), low.alias("__y0"), high.alias("__y1"))
    banded = grown.where("__x0 < __x1 AND __y0 < __y1").withColumn("__band", _cells(F.col("__y0"), F.col("__y1"), band))
    at = len(part) + 1

    def summarise(rows):
        sky = Skyline()
        for row in rows:
            left, ident_, right, top, bottom = row[at:]
            sky.add(left, right, top, bottom, ident_)
        return sky.pieces()

    def run(key, state, rows):
        sky, links = Skyline(state), []
        for row in rows:
            left, ident_, right, top, bottom = row[at:]
            links += [(ident_, other) for other in sky.add(left, right, top, bottom, ident_)]
        yield from _least_of(links)

    kind = boxes.schema[ident].dataType
    out = StructType([StructField("a", kind), StructField("b", kind)])
    links = over_ranges(banded, [*part, "__band"], ["__x0", "__i"], ["__x1", "__y0", "__y1"], None, summarise, lambda state, later: Skyline(state).raised(later).pieces(), run, out)
    labels = smallest_reachable(cut(links), "a", "b")
    return boxes.join(labels.withColumnRenamed("node", ident), ident, "left").select(*boxes.columns, F.coalesce("smallest", F.col(ident)).alias("cluster"))
