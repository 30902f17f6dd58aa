"""Queries over schedules of draws: permutations, weighted plans, exact mixtures and their receipts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import schedule as K
from .base import query, table

#: Draws of each priority in a period of the plan.
WEIGHTS = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
QUOTA = 16
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Rows of each segment in three steps of 16.
CYCLE = [dict(zip(SEGMENTS, row, strict=True)) for row in ((6, 4, 3, 2, 1), (5, 5, 3, 2, 1), (6, 4, 4, 0, 2))]


def _seed(text: str) -> str:
    return f"CAST('0x' || left(sha256({text}), 15) AS BIGINT)"


def _stride(seed: str, size: str) -> str:
    return f"CASE WHEN {size} = 1 THEN 0 ELSE list_filter(list_transform(range({size}), lambda i: 1 + ({seed} + i) % {size}), lambda c: gcd(c, {size}) = 1)[1] END"


@query("i09b_coprime_strides", f"WITH n AS (SELECT l_suppkey AS k, count(*) AS n, {_seed("'stride:' || l_suppkey")} AS seed FROM lineitem GROUP BY ALL) SELECT k, n, CAST({_stride('seed', 'n')} AS BIGINT) AS stride FROM n")
def i09b(spark, sf):
    """A stride for the rows of every supplier."""

    @F.pandas_udf("long")
    def stride(seed: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([K.coprime_stride(int(a), int(b)) for a, b in zip(seed, size, strict=True)], dtype="int64")

    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return sizes.withColumn("stride", stride(K.seed_column(F.lit("stride"), F.col("k")), "n"))


def _schedule_sql(first: str, last: str) -> str:
    weights = ", ".join(f"('{s}', {w})" for s, w in WEIGHTS.items())
    total, many = sum(WEIGHTS.values()), len(WEIGHTS)
    key = f"CAST((n + 1) * ws[i] - {total} * counts[i] AS HUGEINT) * 1152921504606846976 - ts[i]"
    return f"""
WITH RECURSIVE w(s, w) AS (VALUES {weights}), cells AS (SELECT DISTINCT o_orderstatus AS c FROM orders),
src AS (SELECT c, list(s ORDER BY s) AS ss, list(w ORDER BY s) AS ws, list({_seed("'sched:' || c || ':tie:' || s")} ORDER BY s) AS ts FROM cells, w GROUP BY c),
pl AS (SELECT c, 0 AS n, list_transform(range({many}), lambda i: 0) AS counts, CAST(NULL AS VARCHAR) AS s, 0 AS before FROM cells
  UNION ALL SELECT c, n + 1, list_transform(range(1, {many + 1}), lambda i: counts[i] + CASE WHEN i = j THEN 1 ELSE 0 END), ss[j], counts[j]
  FROM (SELECT pl.c, n, counts, ss, list_position(list_transform(range(1, {many + 1}), lambda i: {key}), list_max(list_transform(range(1, {many + 1}), lambda i: {key}))) AS j FROM pl JOIN src USING (c) WHERE n < {total})),
z AS (SELECT o_orderstatus AS c, o_orderpriority AS s, count(*) AS n, {_seed("'sched:' || o_orderstatus || ':' || o_orderpriority || ':offset'")} AS a, {_seed("'sched:' || o_orderstatus || ':' || o_orderpriority || ':stride'")} AS b FROM orders GROUP BY ALL),
b AS (SELECT c, s, n, a % n AS o, {_stride('b', 'n')} AS k FROM z),
r AS (SELECT o_orderstatus AS c, o_orderpriority AS s, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders),
d AS (SELECT id, pl.c, pl.s, id // {total} * w.w + before AS draw FROM (SELECT unnest(range({first} * {QUOTA}, {last} * {QUOTA})) AS id) JOIN pl ON pl.n - 1 = id % {total} JOIN w ON w.s = pl.s)
SELECT CAST(id // {QUOTA} AS BIGINT) AS step, d.c AS o_orderstatus, CAST(id % {QUOTA} AS BIGINT) AS slot, d.s AS o_orderpriority, CAST(draw AS BIGINT) AS draw, o_orderkey
FROM d JOIN b ON b.c = d.c AND b.s = d.s JOIN r ON r.c = d.c AND r.s = d.s AND r.i = (o + (draw % n) * k) % n"""


@query("j09b_counter_schedule", _schedule_sql("0", "(SELECT count(*) // 48 FROM orders)"))
def j09b(spark, sf):
    """As many steps of 16 orders of each status as the orders fill."""
    orders = table(spark, sf, "orders")
    return K.counter_schedule(orders, "o_orderstatus", "o_orderpriority", "o_orderkey", WEIGHTS, QUOTA, 0, orders.count() // 48, "sched")


@query("j09c_schedule_range", _schedule_sql("(SELECT count(*) // 96 FROM orders)", "(SELECT count(*) // 48 FROM orders)"))
def j09c(spark, sf):
    """The second half of these steps on its own."""
    orders = table(spark, sf, "orders")
    n = orders.count()
    return K.counter_schedule(orders, "o_orderstatus", "o_orderpriority", "o_orderkey", WEIGHTS, QUOTA, n // 96, n // 48, "sched")


def _mixture_sql() -> str:
    rows = []
    for turn, row in enumerate(CYCLE):
        for i, s in enumerate(SEGMENTS):
            rows.append(f"({turn}, '{s}', {row[s]}, {sum(row[x] for x in SEGMENTS[:i])}, {sum(r[s] for r in CYCLE[:turn])}, {sum(r[s] for r in CYCLE)})")
    strides = ", ".join(_stride(_seed(f"'mix:' || s || ':stride:{i}'"), "n") for i in range(8))
    return f"""
WITH cyc(turn, s, many, slot, before, every) AS (VALUES {", ".join(rows)}),
z AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s, n, [{strides}] AS ks FROM z),
r AS (SELECT c_mktsegment AS s, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer),
t AS (SELECT step, cyc.* FROM (SELECT unnest(range((SELECT 2 * count(*) // 16 FROM customer))) AS step) JOIN cyc ON turn = step % {len(CYCLE)}),
u AS (SELECT step, s, slot, step // {len(CYCLE)} * every + before AS start, unnest(range(many)) AS j FROM t),
d AS (SELECT step, u.s, slot + j AS slot, start + j AS draw, (start + j) // n AS pass, n, ks FROM u JOIN b USING (s)),
e AS (SELECT *, ({_seed("'mix:' || s || ':offset:' || pass")} % n + (draw % n) * ks[1 + {_seed("'mix:' || s || ':which:' || pass")} % 8]) % n AS i FROM d),
f AS (SELECT CAST(step AS BIGINT) AS step, CAST(slot AS BIGINT) AS slot, e.s AS c_mktsegment, CAST(draw AS BIGINT) AS draw, CAST(pass AS BIGINT) AS pass, c_custkey FROM e JOIN r ON r.s = e.s AND r.i = e.i)"""


def _mixed(spark, sf):
    customers = table(spark, sf, "customer")
    steps = 2 * customers.count() // 16
    return customers, K.mixture(customers, "c_mktsegment", "c_custkey", CYCLE, 0, steps, "mix"), steps


@query("j07b_exact_mixture", _mixture_sql() + " SELECT * FROM f")
def j07b(spark, sf):
    """As many steps of 16 as draw twice as many customers as there are."""
    return _mixed(spark, sf)[1]


@query("j07c_mixture_receipt", _mixture_sql() + f""", taken AS (SELECT c_mktsegment, c_custkey, count(f.step) AS n FROM customer LEFT JOIN f USING (c_mktsegment, c_custkey) GROUP BY ALL),
k AS (SELECT 2 * count(*) // 16 AS steps FROM customer), want AS (SELECT s, CAST(any_value(steps // {len(CYCLE)} * every) + sum(CASE WHEN turn < steps % {len(CYCLE)} THEN many ELSE 0 END) AS BIGINT) AS scheduled FROM cyc, k GROUP BY s)
SELECT c_mktsegment, count(*) AS items, any_value(scheduled) AS scheduled, CAST(sum(n) AS BIGINT) AS actual, count(*) FILTER (n > 0) AS unique_items, CAST(sum(n) - count(*) FILTER (n > 0) AS BIGINT) AS repeats,
CAST(sum(n) // count(*) AS BIGINT) AS passes, min(n) AS "least", max(n) AS most, sum(n) = any_value(scheduled) AND max(n) - min(n) <= 1 AS complete FROM taken JOIN want ON s = c_mktsegment GROUP BY c_mktsegment""")
def j07c(spark, sf):
    customers, draws, steps = _mixed(spark, sf)
    return K.mixture_receipt(customers, draws, "c_mktsegment", "c_custkey", CYCLE, steps)


@query("j06b_dealt_sequence", f"""
WITH RECURSIVE src AS (SELECT list(r_name ORDER BY r_name) AS ss, list(CAST(r_regionkey + 1 AS BIGINT) ORDER BY r_name) AS ws, list({_seed("'deal:tie:' || r_name")} ORDER BY r_name) AS ts, CAST(sum(r_regionkey + 1) AS BIGINT) AS total FROM region),
pl AS (SELECT CAST(0 AS BIGINT) AS n, list_transform(ss, lambda x: CAST(0 AS BIGINT)) AS counts, CAST(NULL AS VARCHAR) AS s FROM src
  UNION ALL SELECT n + 1, list_transform(counts, lambda c, i: c + CASE WHEN i = j THEN 1 ELSE 0 END), ss[j] FROM (SELECT n, counts, ss, total, list_position(ks, list_max(ks)) AS j FROM
    (SELECT n, counts, ss, total, list_transform(counts, lambda c, i: CAST((n + 1) * ws[i] - total * c AS HUGEINT) * 1152921504606846976 - ts[i]) AS ks FROM pl, src WHERE n < total))),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS turn FROM orders)
SELECT o_orderkey, turn, s AS r_name FROM o, src JOIN pl ON pl.n - 1 = turn % total""")
def j06b(spark, sf):
    """All orders dealt to the regions in the shares of their keys plus one."""
    weights = {r.r_name: r.r_regionkey + 1 for r in table(spark, sf, "region").collect()}  # a declared few
    return K.dealt_sequence(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", weights, "deal", "r_name")
