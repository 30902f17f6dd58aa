"""Queries over filters, top rows, set checks, samples and allocations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection as Z
from ..operators import sequence as S
from .base import EV, query, streams, table
from .scores import _r


@query("c01_directions", f"WITH {EV} SELECT i, active OR k < 25 AS \"left\", x OR k > 75 AS \"right\", v < 25 AS up, v > 75 AS down FROM ev")
def c01(spark, sf):
    no = F.lit(False)
    out = Z.four_directions(F.col("k") - 50, F.col("v") - 50, {"left": F.col("active"), "right": F.col("x"), "up": no, "down": no}, 25)
    return streams(spark, sf).select("i", *[c.alias(name) for name, c in out.items()])


BINDS = [(0, "jump", "view"), (0, "jump", "click"), (0, "dash", "purchase"), (1, "jump", "signup"), (1, "dash", None)]
BIND_SQL = "b(q, action, button) AS (VALUES (0, 'jump', 'view'), (0, 'jump', 'click'), (0, 'dash', 'purchase'), (1, 'jump', 'signup'), (1, 'dash', NULL))"


@query("c02_bound_actions", f"WITH {EV}, {BIND_SQL} SELECT s % 2 AS q, i, action, coalesce(bool_or(x AND key = button), false) AS held FROM ev JOIN b ON b.q = s % 2 GROUP BY ALL")
def c02(spark, sf):
    binds = spark.createDataFrame(BINDS, "q long, action string, button string")
    long = streams(spark, sf).select((F.col("s") % 2).alias("q"), "i", F.col("key").alias("button"), "x")
    return Z.bound_actions(long, binds, ["i"], "q", "button", "x", "action")


@query("c03_usable_rows", f"WITH {EV} SELECT i FROM ev WHERE key = 'view' AND NOT x AND NOT isnan(v)")
def c03(spark, sf):
    """With c06: rows with a status, not repeated, and without a sentinel."""
    return streams(spark, sf).where((F.col("key") == "view") & ~F.col("x") & F.col("v").isNotNull() & ~F.isnan("v")).select("i")


@query("c03b_usable_alignment", f"""WITH {EV}, d AS (SELECT s, pos, v, CASE WHEN key <> 'view' THEN g END AS d, CASE WHEN k >= 10 THEN k::DOUBLE WHEN k >= 5 THEN 'nan'::DOUBLE END AS w FROM ev),
t AS (SELECT *, last_value(d IGNORE NULLS) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM d) SELECT s, pos, w FROM t WHERE d IS NOT NULL AND d IS DISTINCT FROM b AND NOT isnan(w)""")
def c03b(spark, sf):
    """Rows that an alignment finds readable and new, with their number; it is NULL or NaN where the player is absent."""
    w = F.when(F.col("k") >= 10, F.col("k").cast("double")).when(F.col("k") >= 5, F.lit(float("nan")))
    df = streams(spark, sf).withColumn("d", F.when(F.col("key") != "view", F.col("g"))).withColumn("w", w)
    return Z.usable_rows(S.readable_alignment(df, ["s"], "pos", "d"), "decode_status", "is_duplicate", ["w"]).select("s", "pos", "w")


@query("c04_thresholds", f"WITH {EV} SELECT i, p >= CASE key WHEN 'view' THEN 0.7 WHEN 'click' THEN 0.2 ELSE 0.5 END AS predicted FROM ev")
def c04(spark, sf):
    return Z.above_thresholds(streams(spark, sf), spark.createDataFrame([("view", 0.7), ("click", 0.2)], "key string, t double"), "key", "p", "t", 0.5).select("i", "predicted")


@query("c05_gated_events", f"WITH {EV}, t AS (SELECT s, pos, active, CASE WHEN x AND NOT b THEN 'onset' WHEN b AND NOT x THEN 'release' END AS kind FROM (SELECT *, lag(x, 1, false) OVER (PARTITION BY s ORDER BY pos) AS b FROM ev)) SELECT s, pos, kind FROM t WHERE kind IS NOT NULL AND active")
def c05(spark, sf):
    df = streams(spark, sf)
    return Z.gated_events(df, S.transitions(df, ["s"], "pos", "x").select("s", "pos", "kind"), ["s"], "pos", "active")


@query("c07_sources", "SELECT source, count(*) FILTER (WHERE lang IN ('en', 'de')) AS kept, count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'de')) AS left_out FROM documents GROUP BY 1")
def c07(spark, sf):
    inside = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(inside, 1)).alias("kept"), F.count(F.when(~inside, 1)).alias("left_out"))


@query("c09_near_activity", f"WITH {EV} SELECT s, pos, bool_or(k >= 95) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM ev")
def c09(spark, sf):
    return Z.near_activity(streams(spark, sf).withColumn("h", F.col("k") >= 95), ["s"], "pos", "h", 3).select("s", "pos", "near")


@query("c10_cascade", f"WITH {EV}, c AS (SELECT CASE WHEN key = 'error' THEN 'broken' WHEN k > 80 AND x THEN 'strong' WHEN k > 50 THEN 'fair' ELSE 'weak' END AS class FROM ev) SELECT class, count(*) AS n FROM c GROUP BY 1")
def c10(spark, sf):
    rules = [(F.col("key") == "error", "broken"), ((F.col("k") > 80) & F.col("x"), "strong"), (F.col("k") > 50, "fair")]
    return streams(spark, sf).groupBy(Z.cascade(rules, "weak").alias("class")).agg(F.count("*").alias("n"))


@query("c12_failures", f"WITH {EV} SELECT i, concat_ws(',', CASE WHEN k < 10 THEN 'low' END, CASE WHEN NOT x THEN 'released' END, CASE WHEN NOT active THEN 'inactive' END) AS reasons, k >= 10 AND x AND active AS admitted FROM ev")
def c12(spark, sf):
    """With c11: each row's failed tests; it is admitted if there is none."""
    bad = Z.failures({"low": F.col("k") >= 10, "released": F.col("x"), "inactive": F.col("active")})
    return streams(spark, sf).select("i", F.array_join(bad, ",").alias("reasons"), (F.size(bad) == 0).alias("admitted"))


@query("c15_action_sets", f"WITH {EV} SELECT CASE x::INT + active::INT + (k > 50)::INT WHEN 0 THEN 'none' WHEN 1 THEN 'solo' ELSE 'several' END AS kind, count(*) AS n FROM ev GROUP BY 1")
def c15(spark, sf):
    df = streams(spark, sf).withColumn("h", F.col("k") > 50)
    return Z.sets_of_actions(df, ["s"], "pos", ["x", "active", "h"]).groupBy("kind").agg(F.count("*").alias("n"))


@query("c16_fallbacks", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice WHEN o_custkey % 2 = 0 THEN o_custkey END AS measure FROM orders")
def c16(spark, sf):
    first, second = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(first, second).alias("measure"))


@query("c17_first_valid", f"WITH {EV} SELECT s, arg_min(pos, CASE WHEN k > 60 THEN 0 ELSE 1000000 END + pos) AS pos, arg_min(k, CASE WHEN k > 60 THEN 0 ELSE 1000000 END + pos) AS k FROM ev GROUP BY s")
def c17(spark, sf):
    return Z.first_valid(streams(spark, sf).withColumn("ok", F.col("k") > 60), ["s"], "pos", "ok", "k")


@query("c18_only_values", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'mixed:' || string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) END AS status FROM orders GROUP BY 1")
def c18(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(Z.only_value("o_orderstatus").alias("status"))


@query("g01_top_rows", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def g01(spark, sf):
    """With g02 and j14: the best rows of each group in an order without ties."""
    return Z.top_row(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey")


@query("g03_hashed_sample", "SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('a' || chr(0) || o_orderkey), o_orderkey) <= 20")
def g03(spark, sf):
    """With j11: a sample without replacement in each class; the limit is the feature."""
    return Z.hashed_sample(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey", "a", 20).select("o_orderstatus", "o_orderkey")


@query("g04_until_weight", f"WITH {EV}, w AS (SELECT s, pos, coalesce(sum(k) OVER (PARTITION BY s ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ev) SELECT s, pos FROM w WHERE b < 500")
def g04(spark, sf):
    return Z.until_weight(streams(spark, sf), ["s"], [F.col("pos")], "k", 500).select("s", "pos")


@query("g07_typical_rows", f"WITH {EV}, m AS (SELECT key, x, median(k) AS m FROM ev GROUP BY ALL) SELECT key, x, arg_min(i, (abs(k - m), i)) AS i FROM ev JOIN m USING (key, x) GROUP BY ALL")
def g07(spark, sf):
    return Z.typical_rows(streams(spark, sf), ["key", "x"], "k", "i")


SPREAD = """n AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT DISTINCT f, CASE WHEN n <= 9 THEN j ELSE CAST(round_even((0.02::DOUBLE + j * 0.12::DOUBLE) * (n - 1), 0) AS BIGINT) END AS slot FROM n, range(9) AS t(j) WHERE j < n)"""


@query("g08_spread_rows", f"WITH {SPREAD}, r AS (SELECT l_returnflag AS f, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS slot, l_orderkey FROM lineitem) SELECT f, l_orderkey FROM r JOIN p USING (f, slot)")
def g08(spark, sf):
    """With j15: evenly spread rows from 2 % to 98 % of each group."""
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), "l_orderkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    return Z.spread_rows(df, ["f"], "o", 9, 0.02, 0.98).select("f", "l_orderkey")


PAIR = ("SELECT doc_id, quality AS q FROM labels", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE quality END AS q FROM labels WHERE doc_id % 2 = 0")


def _pair(spark, sf):
    lab = table(spark, sf, "labels").dropDuplicates(["doc_id"])
    return lab.select("doc_id", F.col("quality").alias("q")), lab.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("quality")).alias("q"))


@query("h02_merged_identical", f"WITH u AS ({PAIR[0]} UNION {PAIR[1]}) SELECT doc_id, any_value(q) AS q FROM u GROUP BY 1 HAVING count(*) = 1")
def h02(spark, sf):
    return Z.merged_identical(list(_pair(spark, sf)), ["doc_id"])[0]


@query("h02b_conflicts", f"WITH u AS ({PAIR[0]} UNION {PAIR[1]}) SELECT doc_id, count(*) AS versions FROM u GROUP BY 1 HAVING count(*) > 1")
def h02b(spark, sf):
    return Z.merged_identical(list(_pair(spark, sf)), ["doc_id"])[1]


@query("h03_coverage", "SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN n IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS problem FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n IS NULL OR c_custkey IS NULL OR n > 1")
def h03(spark, sf):
    """With h01, h06: the difference of two key sets both ways, and repeats."""
    return Z.coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("h04_partition_proof", "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS shared, count(*) FILTER (WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 > 0) AS lost, CAST(0 AS BIGINT) AS \"foreign\" FROM (SELECT DISTINCT o_orderkey FROM orders)")
def h04(spark, sf):
    o = table(spark, sf, "orders")
    return Z.partition_proof(o, [o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0")], "o_orderkey")


@query("h05_shared_tokens", "SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))), ' ') AS shared FROM part")
def h05(spark, sf):
    both = F.array_intersect(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(both), " ").alias("shared"))


@query("j01_balanced", """WITH RECURSIVE o AS (SELECT s_nationkey AS r, s_suppkey AS id, CAST(floor(s_acctbal) AS BIGINT) + 2000 AS w, row_number() OVER (PARTITION BY s_nationkey ORDER BY CAST(floor(s_acctbal) AS BIGINT) DESC, s_suppkey) AS k FROM supplier),
l AS (SELECT DISTINCT r, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS id, 0 AS shard, [CAST(0 AS BIGINT), 0, 0] AS loads FROM o UNION ALL
SELECT r, k, id, pick, list_transform(loads, lambda v, j: CASE WHEN j = pick + 1 THEN v + w ELSE v END) FROM (SELECT o.r, o.k, o.id, o.w, l.loads, list_position(l.loads, list_min(l.loads)) - 1 AS pick FROM l JOIN o ON o.r = l.r AND o.k = l.k + 1))
SELECT r, id, shard FROM l WHERE k > 0""")
def j01(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("r"), F.col("s_suppkey").alias("id"), (F.floor("s_acctbal") + 2000).cast("long").alias("w"))
    return Z.balanced(df, ["r"], "id", "w", 3)


@query("j04_proportional", """WITH c AS (SELECT key, count(*) AS n FROM events_c GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c), f AS (SELECT *, (97 * n) // total AS fl, (97 * n) % total AS rest FROM t)
SELECT key, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= 97 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM f""".replace("events_c", "(SELECT event_type AS key FROM events)"))
def j04(spark, sf):
    return Z.proportional(streams(spark, sf).groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", 97)


@query("j05_systematic", f"WITH {EV} SELECT s, pos FROM ev WHERE (pos - 1) % 7 = 3")
def j05(spark, sf):
    return Z.systematic(streams(spark, sf), ["s"], "pos", 7, 3).select("s", "pos")


@query("j06_mixed_sequence", """WITH RECURSIVE w AS (SELECT r_name AS name, CAST(r_regionkey + 1 AS BIGINT) AS w, row_number() OVER (ORDER BY r_name) AS j FROM region), a AS (SELECT list(w ORDER BY j) AS ws, list(name ORDER BY j) AS names, CAST(sum(w) AS BIGINT) AS total FROM w),
l AS (SELECT CAST(-1 AS BIGINT) AS turn, list_transform(ws, lambda z: CAST(0 AS BIGINT)) AS used, CAST(0 AS BIGINT) AS pick FROM a UNION ALL
SELECT turn, list_transform(used, lambda u, j: CASE WHEN j = pick THEN u + 1 ELSE u END), pick FROM (SELECT turn + 1 AS turn, used, CAST(list_position(lack, list_max(lack)) AS BIGINT) AS pick FROM (SELECT turn, used, list_transform(ws, lambda v, j: v * (turn + 2) - used[j] * total) AS lack FROM l, a WHERE turn < 29)))
SELECT turn, names[pick] AS r_name FROM l, a WHERE turn >= 0""")
def j06(spark, sf):
    return Z.mixed_sequence(table(spark, sf, "region").withColumn("w", F.col("r_regionkey") + 1), [], "r_name", "w", 30)


FOLD = "CAST(('0x' || left(sha256('a' || chr(0) || user_id), 8)) AS BIGINT)"


@query("j13_folds", f"SELECT user_id AS s, {FOLD} % 4 AS fold, count(*) AS n FROM events GROUP BY ALL")
def j13(spark, sf):
    return streams(spark, sf).groupBy("s", Z.fold_of(F.col("s"), "a", 4).alias("fold")).agg(F.count("*").alias("n"))


@query("j08_batches", f"WITH r AS (SELECT event_id AS i, sha256('a' || chr(0) || event_id) AS h, {FOLD.replace('user_id', 'event_id')} % 4 AS rank FROM events) SELECT i, rank, (row_number() OVER (PARTITION BY rank ORDER BY h, i) - 1) // 32 AS batch FROM r")
def j08(spark, sf):
    return Z.ranked_batches(streams(spark, sf), "i", "a", 32, 4).select("i", "rank", "batch")


@query("h06_key_problems", f"WITH {EV} SELECT i, CASE WHEN k % 3 = 0 THEN 'b' WHEN k % 3 = 1 THEN '' ELSE 'b,c' END AS problems FROM ev")
def h06(spark, sf):
    made = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("a"), F.lit(1))).when(F.col("k") % 3 == 1, F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))).otherwise(F.create_map(F.lit("c"), F.lit(1), F.lit("a"), F.lit(2)))
    return streams(spark, sf).select("i", F.array_join(Z.key_problems(made, ["a", "b"]), ",").alias("problems"))


@query("j09_stratified_panel", f"""WITH {EV}, r AS (SELECT key, x, i, row_number() OVER (PARTITION BY key, x ORDER BY sha256('p' || chr(0) || i), i) - 1 AS p FROM ev), t AS (SELECT * FROM r WHERE p < 150), n AS (SELECT key, x, count(*) AS n FROM t GROUP BY ALL)
SELECT key, x, i, CAST(turn AS BIGINT) AS turn FROM t JOIN n USING (key, x), range(150) AS z(turn) WHERE turn % n = p""")
def j09(spark, sf):
    """A panel of 150 turns; the quota is the feature."""
    return Z.stratified_panel(streams(spark, sf), ["key", "x"], "i", "p", 150).select("key", "x", "i", "turn")


@query("j07_cycled", """WITH n AS (SELECT c_mktsegment AS m, c_custkey AS c, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), p AS (SELECT m, c, n, CAST(z.p AS BIGINT) AS pass FROM n, range(400) AS z(p) WHERE z.p <= 399 // n),
d AS (SELECT m, pass, c, row_number() OVER (PARTITION BY m, pass ORDER BY sha256('c' || chr(0) || pass || chr(0) || c), c) - 1 + pass * n AS draw FROM p) SELECT m, draw, pass, c FROM d WHERE draw < 400""")
def j07(spark, sf):
    """400 draws from each pool; the number is the feature."""
    return Z.cycled(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("m"), F.col("c_custkey").alias("c")), ["m"], "c", "c", 400)


@query("f27_freeze_scores", f"""WITH {EV}, m AS (SELECT s, pos, list_sort([lag(k, 3) OVER w, lag(k, 2) OVER w, lag(k, 1) OVER w])[2] AS b, greatest(lead(k, 1) OVER w, lead(k, 2) OVER w, lead(k, 3) OVER w) AS z, lead(k, 4) OVER w AS a, lag(k, 3) OVER w IS NOT NULL AND lead(k, 4) OVER w IS NOT NULL AS whole FROM ev WINDOW w AS (PARTITION BY s ORDER BY pos))
SELECT e.s, e.pos AS e, CAST(h AS BIGINT) AS lag, round(ln((b + 0.5) / (z + 0.5)) + ln((a + 0.5) / (z + 0.5)), 6) AS score FROM ev e, range(-3, 4) AS t(h), m WHERE e.key = 'error' AND m.s = e.s AND m.pos = e.pos + h AND whole""")
def f27(spark, sf):
    df = streams(spark, sf)
    return _r(S.freeze_scores(df, df.where("key = 'error'").select("s", F.col("pos").alias("e")), ["s"], "pos", "k", "e", list(range(-3, 4)), 0.5), "score")


@query("c11_eligible", f"""WITH {EV}, c AS (SELECT s, key, count(*) FILTER (WHERE x) AS n, count(*) FILTER (WHERE x) / 24.0 AS rate, median(k) AS m, avg(active::INT) AS co FROM ev GROUP BY ALL)
SELECT s, key, action FROM c, (VALUES ('jump', 2, 0.1), ('dash', 3, 0.1), ('grab', 1, 0.2), ('pause', 0, 0.0)) AS a(action, least, hourly)
WHERE n >= least AND rate >= hourly AND CASE action WHEN 'jump' THEN m <= 50 WHEN 'dash' THEN m <= 60 AND co >= 0.5 WHEN 'grab' THEN m >= 40 ELSE true END""")
def c11(spark, sf):
    """Each stream's event types as candidates, with a floor of presses, one of presses an hour, and a shape."""
    c = streams(spark, sf).groupBy("s", "key").agg(F.count(F.when(F.col("x"), 1)).alias("n"), F.median("k").alias("m"), F.avg(F.col("active").cast("int")).alias("co")).withColumn("rate", F.col("n") / 24)
    floors = {"jump": (2, 0.1), "dash": (3, 0.1), "grab": (1, 0.2), "pause": (0, 0.0)}
    shapes = {"jump": F.col("m") <= 50, "dash": (F.col("m") <= 60) & (F.col("co") >= 0.5), "grab": F.col("m") >= 40}
    return Z.eligible(c, "n", "rate", floors, shapes).select("s", "key", "action")


@query("j05b_systematic_windows", f"""WITH {EV}, l AS (SELECT key, s, count(*) AS len FROM ev GROUP BY ALL), c AS (SELECT *, sum(len) OVER (PARTITION BY key ORDER BY s) AS e, sum(len) OVER (PARTITION BY key) AS total FROM l),
d AS (SELECT key, CAST(j AS BIGINT) AS draw, CAST(floor((j + 0.25::DOUBLE) * total / (total // 3)) AS BIGINT) AS place FROM (SELECT DISTINCT key, total FROM c), LATERAL (SELECT unnest(range(CAST(total // 3 AS BIGINT))) AS j))
SELECT c.key, c.s, draw, CAST(place - (e - len) AS BIGINT) AS "offset" FROM d JOIN c ON c.key = d.key AND place >= e - len AND place < e""")
def j05b(spark, sf):
    """A third of each event type's rows, evenly over its streams laid end to end."""
    runs = streams(spark, sf).groupBy("key", "s").agg(F.count("*").alias("len"))
    totals = runs.groupBy("key").agg(F.floor(F.sum("len") / 3).cast("long").alias("n"))
    return Z.systematic_windows(runs.join(totals, "key"), ["key"], ["s"], "len", "n", 0.25)


@query("j08b_epoch_batches", """WITH r AS (SELECT event_id AS i, row_number() OVER (ORDER BY sha256('a:3' || chr(0) || event_id), event_id) - 1 AS place, count(*) OVER () AS n FROM events),
p AS (SELECT i, place FROM r UNION ALL SELECT i, place + n FROM r WHERE place + n < ceil(n / 96.0) * 96) SELECT i, CAST(place // 96 AS BIGINT) AS step, CAST(place % 96 // 24 AS INT) AS rank FROM p""")
def j08b(spark, sf):
    return Z.epoch_batches(streams(spark, sf), "i", "a", 3, 96, 4).select("i", "step", "rank")


DEALT = """WITH RECURSIVE o AS (SELECT s_nationkey AS r, s_suppkey AS id, w, again, row_number() OVER (PARTITION BY s_nationkey ORDER BY again, CASE WHEN again THEN 0 ELSE -w END, s_suppkey) AS k
FROM (SELECT *, CAST(floor(s_acctbal) AS BIGINT) + 2000 AS w, {again} AS again FROM supplier WHERE {rows})),
l AS (SELECT r, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS id, 0 AS shard, {start} AS loads, [0, 0, 0] AS taken FROM (SELECT DISTINCT r FROM o) UNION ALL
SELECT r, k, id, pick, list_transform(loads, lambda v, j: CASE WHEN j = pick + 1 THEN v + w ELSE v END), list_transform(taken, lambda v, j: CASE WHEN again AND j = pick + 1 THEN 1 ELSE v END)
FROM (SELECT o.*, l.loads, l.taken, list_position(list_zip(l.taken, l.loads), list_min(list_zip(l.taken, l.loads))) - 1 AS pick FROM l JOIN o ON o.r = l.r AND o.k = l.k + 1))
SELECT r, id, shard FROM l WHERE k > 0"""
#: Of each nation, its two suppliers of smallest key are to be retried.
AGAIN = "row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2"


def _units(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("r"), F.col("s_suppkey").alias("id"), (F.floor("s_acctbal") + 2000).cast("long").alias("w"))


@query("j02_retries_spread", DEALT.format(again=AGAIN, rows="true", start="[CAST(0 AS BIGINT), 0, 0]"))
def j02(spark, sf):
    at = F.row_number().over(Window.partitionBy("r").orderBy("id"))
    return Z.balanced(_units(spark, sf).withColumn("at", at).withColumn("again", F.when(F.col("at") <= 2, F.col("at"))), ["r"], "id", "w", 3, retry="again")


@query("j03_recovery_partition", DEALT.format(again="false", rows="s_suppkey % 4 = 3", start="(SELECT [CAST(coalesce(sum(w) FILTER (WHERE h = 0), 0) AS BIGINT), CAST(coalesce(sum(w) FILTER (WHERE h = 1), 0) AS BIGINT), CAST(coalesce(sum(w) FILTER (WHERE h = 2), 0) AS BIGINT)] FROM (SELECT s_nationkey AS q, s_suppkey % 4 AS h, CAST(floor(s_acctbal) AS BIGINT) + 2000 AS w FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey NOT IN (SELECT ps FROM (SELECT s_suppkey AS ps FROM supplier WHERE s_suppkey % 10 = 1))) WHERE q = r)").replace("WHERE s_suppkey % 4 = 3)", "WHERE s_suppkey % 4 = 3 AND s_suppkey % 10 <> 1)"))
def j03(spark, sf):
    """Shards keep what they held, less what is completed; what was queued for recovery is dealt on top."""
    units = _units(spark, sf)
    open_ = units.join(units.where("id % 10 = 1").select("id"), "id", "left_anti")
    held = open_.where("id % 4 < 3").withColumn("shard", (F.col("id") % 4).cast("int"))
    return Z.balanced(open_.where("id % 4 = 3"), ["r"], "id", "w", 3, loads=held.select("r", "shard", "w"))


@query("j10_nearest_sum")
def j10(spark, sf):
    """Of each nation's suppliers, those whose balances add up nearest to two thirds of all."""
    df = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("r"), F.col("s_suppkey").alias("id"), (F.floor(F.col("s_acctbal") / 100) + 20).cast("long").alias("w"))
    target = df.groupBy("r").agg((F.sum("w") * 2 / 3).alias("t"))
    return Z.nearest_sum(df.join(target, "r"), ["r"], "id", "w", "t", "n")
