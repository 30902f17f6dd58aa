"""Running totals, ranks and folds within groups, split by ranges of the order so that no group is one task's work; components by rounds."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a group that one task may sort: some 100 MB when narrow.
FEW_ROWS = 1_000_000


def _below(edges: Column, x: Column, width: int = 16) -> Column:
    """How many of the sorted edges are under x, from blocks of edges first and then in one block."""
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(edges), F.lit(1)), F.lit(width)), lambda i: F.get(edges, i + width - 2))
    full = F.size(F.filter(starts, lambda e: e < x))
    return full * width + F.size(F.filter(F.slice(edges, full * width + 1, F.lit(width)), lambda e: e < x))


def running_totals(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], ties: str | None = None, down: bool = False, parts: int = 256, few: int | None = None) -> DataFrame:
    """df with name (the total of a column over the rows of a group up to this one) and name_all (over the group)
    for each name of sums, in order of `order` (falling if down), then of `ties` (rising). Both are numbers.

    Ranges lie between quantiles of order over all rows; a value that is itself a quantile is a range of its own,
    cut once more at quantiles of ties. Rows are summed within each (group, range), and the ranges' totals before
    it, at most parts * 34 a group, are added. Quantiles decide only how work is split, not results. A NULL order
    comes first if rising and last if falling.

    Groups of up to `few` rows each (FEW_ROWS if None), which one task can sort, need no ranges: one window gives
    the same totals, and Spark deals the groups. For that the rows of groups are counted first, of the columns `by` alone. Else df is
    written once (cut), as it is read three times; give it narrow."""
    kept = [f"__v{i}" for i in range(len(sums))]
    first = [F.desc(order) if down else F.asc(order), *([ties] if ties else [])]
    zero = F.lit(0)
    most = df.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    rows = df.select("*", *[c.alias(k) for k, c in zip(kept, sums.values(), strict=True)])
    if most <= (FEW_ROWS if few is None else few):
        group = Window.partitionBy(*by)
        up = group.orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*df.columns, *[F.coalesce(F.sum(k).over(up), zero).alias(n) for k, n in zip(kept, sums, strict=True)], *[F.sum(k).over(group).alias(f"{n}_all") for k, n in zip(kept, sums, strict=True)])
    rows = cut(rows)
    at = [F.lit(i / parts) for i in range(1, parts)]
    quantiles = [F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(order, F.array(*at)), F.array()))).alias("__edges")]
    if ties:
        quantiles.append(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(ties, F.array(*at[parts // 16 - 1 :: parts // 16])), F.array()))).alias("__cuts"))
    edges = rows.agg(*quantiles)
    x = F.col(order)
    below = _below(F.col("__edges"), x)
    own_range = F.coalesce(F.get("__edges", below) == x, F.lit(False))
    rank = F.when(x.isNull(), F.lit(-1)).otherwise(below * 2 + own_range.cast("int"))
    among = F.when(own_range | x.isNull(), F.coalesce(_below(F.col("__cuts"), F.col(ties)), F.lit(0))).otherwise(0) if ties else F.lit(0)
    ranged = rows.crossJoin(F.broadcast(edges))
    # One key for the window and the join, so that rows move once; fields of a struct that are NULL are equal.
    groups = [f"__key.g{i}" for i in range(len(by))]
    ranged = ranged.withColumn("__key", F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], (-rank if down else rank).alias("a"), among.alias("b"))).drop("__edges", "__cuts")
    totals = ranged.groupBy("__key").agg(*[F.sum(k).alias(k) for k in kept])
    whole = Window.partitionBy(*groups)
    past = whole.orderBy("__key.a", "__key.b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__key").alias("__of"), *[F.coalesce(F.sum(k).over(past), zero).alias(f"{k}_before") for k in kept], *[F.sum(k).over(whole).alias(f"{k}_all") for k in kept])
    up = Window.partitionBy("__key").orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({f"{k}_own": F.coalesce(F.sum(k).over(up), zero) for k in kept})
    out = own.join(before, F.col("__key") == F.col("__of"))
    return out.select(*df.columns, *[(F.col(f"{k}_before") + F.col(f"{k}_own")).alias(n) for k, n in zip(kept, sums, strict=True)], *[F.col(f"{k}_all").alias(f"{n}_all") for k, n in zip(kept, sums, strict=True)])


def tiles(rank: Column, n: Column, k: int) -> Column:
    """The tile, from 1, of a rank from 1 among n rows in k tiles of equal size, the first ones longer by a row."""
    size, longer = F.floor(n / k).cast("long"), (n % k).cast("long")
    head = longer * (size + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (size + 1)) + 1).otherwise(longer + F.floor((rank - 1 - head) / F.greatest(size, F.lit(1))) + 1).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without that setting a temporary folder, in a single JVM only, as no other machine would see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not folder and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="strandline-")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """df and out: the number of a row, from 0, in its group in order of a number."""
    return running_totals(df, by, order, {out: F.lit(1).cast("long")}).withColumn(out, F.col(out) - 1).drop(f"{out}_all")


def ranked_values(df: DataFrame, by: list[str], value: Column | str, also: dict[str, Column] | None = None) -> DataFrame:
    """by, v, c, upto, n: the distinct values of each group as doubles, how often each comes, how many rows up to it and in all.
    also: further columns to sum, as name (of the value), name_upto and name_all. NULLs are left out."""
    also = also or {}
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    tied = df.select(*by, v.alias("v"), *[c.alias(k) for k, c in also.items()]).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("c"), *[F.sum(k).alias(k) for k in also])
    out = running_totals(tied, by, "v", {"upto": F.col("c")} | {f"{k}_upto": F.col(k) for k in also})
    return out.withColumnsRenamed({"upto_all": "n"} | {f"{k}_upto_all": f"{k}_all" for k in also})


def at_positions(ranked: DataFrame, by: list[str], positions: dict[str, Column]) -> DataFrame:
    """by and each name: the value at a position (from 0, between two rows in proportion) of ranked_values(), which
    may hold more columns for the positions to use; NULL where the position is NULL or beyond the rows."""
    aggs, out = [], []
    for i, (name, at) in enumerate(positions.items()):
        low, high = F.floor(at), F.ceil(at)
        of = lambda k: F.max(F.when((F.col("upto") - F.col("c") <= k) & (k < F.col("upto")), F.col("v")))
        aggs += [of(low).alias(f"__l{i}"), of(high).alias(f"__h{i}"), F.max(at).alias(f"__p{i}")]
        a, b, q = (F.col(f"__{x}{i}") for x in "lhp")
        out.append(F.when(a == b, a).otherwise((F.ceil(q) - q) * a + (q - F.floor(q)) * b).alias(name))
    return (ranked.groupBy(*by) if by else ranked).agg(*aggs).select(*by, *out)


def exact_quantiles(df: DataFrame, by: list[str], value: Column | str, probs: dict[str, float]) -> DataFrame:
    """by and each name: percentile() of a group's values, found by rank among ranges of the values, so that no group's values
    lie in one task's memory."""
    return at_positions(ranked_values(df, by, value), by, {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probs.items()})


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left with the columns of right (a row a group, groups without NULLs), also if there is but one group."""
    return left.join(right, by) if by else left.crossJoin(F.broadcast(right))


def over_ranges(df: DataFrame, part: list[str], order: list[str], values: list[str], fresh: Any, summarise: Callable, advance: Callable, run: Callable, out: StructType) -> DataFrame:
    """A fold over each group's rows in order, of which the ranges of a long group are read in parallel.

    The table is dealt by ranges of (part, order), written once, and read twice. First every range is summed up:
    summarise(rows) tells of the rows of one group in one range what advance(state, summary) needs to pass a state
    over them. One summary a range comes to the driver, of the group that reaches its end, and is chained there.
    Then run(key, state, rows) yields the output rows of a group in a range from the state at its start, which is `fresh`
    for the group's first rows. Rows are tuples of part, order and values, passed one by one; summaries must be small.
    A group is the work of as many tasks as it has ranges. Rows of equal (part, order) lie in one range."""
    names = list(dict.fromkeys([*part, *order, *values]))
    width = len(part)
    spread = cut(df.select(*names).repartitionByRange(*part, *order).sortWithinPartitions(*part, *order).withColumn("__range", F.spark_partition_id()))

    def groups(batches, seen):
        def rows():
            for batch in batches:
                if batch.num_rows:
                    seen.append(batch.column(len(names))[0].as_py())
                    yield from zip(*[batch.column(i).to_pylist() for i in range(len(names))], strict=True)

        return groupby(rows(), lambda r: r[:width])

    def sum_up(batches):
        seen, first, last, many, summary = [], None, None, 0, None
        for key, rows in groups(batches, seen):
            many, last, summary = many + 1, key, summarise(rows)
            first = key if first is None else first
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen[0]], pa.int32()), pa.array([pickle.dumps((first, last, many, summary))], pa.binary())], names=["range", "told"])

    states, state, reached = {}, fresh, None
    for row in sorted(spread.mapInArrow(sum_up, "range int, told binary").collect()):
        first, last, many, summary = pickle.loads(row.told)
        if first == reached:
            states[row.range] = state
        state, reached = advance(state if first == reached and many == 1 else fresh, summary), last
    told = df.sparkSession.sparkContext.broadcast(states)
    schema = to_arrow_schema(out)

    def passed(batches):
        seen, ready = [], []
        for number, (key, rows) in enumerate(groups(batches, seen)):
            for row in run(key, fresh if number else told.value.get(seen[0], fresh), rows):
                ready.append(row)
                if len(ready) == 8192:
                    yield _batch(ready, schema)
                    ready = []
        yield _batch(ready, schema)

    return spread.mapInArrow(passed, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def smallest_reachable(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, smallest: for every node of the links (a, b) that isn't the smallest of its component that smallest one.

    Rounds of large-star and small-star: every node gives its larger neighbours, then its smaller ones, to the least node
    it knows, until all links are stars; a round only needs minima by node and joins on a node."""
    ordered = lambda df, u, v: df.select(F.greatest(u, v).alias("node"), F.least(u, v).alias("smallest")).where("node <> smallest").distinct()
    edges = cut(ordered(links, a, b))
    while True:
        tops = edges.select("node").distinct()
        settled = edges.groupBy().agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes")).first()
        if settled.n == settled.nodes and edges.join(tops.withColumnRenamed("node", "smallest"), "smallest", "left_semi").isEmpty():
            return edges
        both = edges.select(F.col("node").alias("u"), F.col("smallest").alias("v")).unionByName(edges.select(F.col("smallest").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ordered(both.join(least, "u").where("v > u"), "v", "m")
        lower = large.groupBy("node").agg(F.min("smallest").alias("m"))
        small = large.join(lower, "node")
        edges = cut(ordered(small.select(F.col("smallest").alias("v"), "m").unionByName(small.select(F.col("node").alias("v"), "m")), "v", "m"))
