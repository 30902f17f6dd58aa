"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .base import EV, query, streams, table
from .scores import _r


@query("i01_source_and_id", r"""SELECT page_id, CASE WHEN a <> '' THEN 'numbered' WHEN b <> '' THEN 'named' END AS source, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b END AS id
FROM (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS a, regexp_extract(url, '//([^/]+)', 1) AS b FROM pages)""")
def i01(spark, sf):
    found = X.first_pattern(F.col("url"), [("numbered", "/([0-9]+)"), ("named", "//([^/]+)")])
    return table(spark, sf, "pages").select("page_id", found.alias("x")).select("page_id", "x.source", "x.id")


@query("i02_seconds", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 5 * 3600 + l_linenumber * 60 + l_quantity AS DOUBLE) AS seconds, CAST(l_quantity AS DOUBLE) AS start FROM lineitem""")
def i02(spark, sf):
    text = F.concat((F.col("l_partkey") % 5).cast("string"), F.lit("H"), F.col("l_linenumber").cast("string"), F.lit("m"), F.col("l_quantity").cast("string"), F.lit("s"))
    url = F.concat(F.lit("https://host/watch?v=1&t=bad&start="), F.col("l_quantity").cast("string"), F.lit("#t=4"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.seconds(text).alias("seconds"), X.url_start(url).alias("start"))


@query("i03_tokens", """SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(len(regexp_extract_all(text, '([0-9]+(?::[0-9]{2})+)', 1)) AS BIGINT) AS n_clocks
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM documents)""")
def i03(spark, sf):
    w = X.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(X.clocks(F.col("text"))).cast("long").alias("n_clocks"))


@query("i04_safe_paths", r"""SELECT page_id, split_part(url, '://', 2) AS path, split_part(url, '://', 2) <> '' AND NOT regexp_matches(split_part(url, '://', 2), '(^|/)\.{0,2}(/|$)') AS safe FROM pages""")
def i04(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("://"), F.lit(2)).alias("path")).withColumn("safe", X.safe_relative(F.col("path")))


@query("i05_strict_json", "SELECT event_id, CASE WHEN event_id % 5 > 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def i05(spark, sf):
    """Of five rows one is cut short, one has a text after the object and one a key too many."""
    n = F.col("event_id") % 5
    text = F.when(n == 0, F.expr("left(props, length(props) - 1)")).when(n == 1, F.concat("props", F.lit(" trailing"))).when(n == 2, F.expr("concat(left(props, length(props) - 1), ', \"z\": 1}')")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", X.strict_json(text, {"k": "bigint"})["k"].alias("k"))


@query("i06_before_last", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '__c' AS video FROM orders")
def i06(spark, sf):
    name = F.concat_ws("__", F.col("o_custkey").cast("string"), F.lit("c"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", X.before_last(name, "__").alias("video"))


@query("i07_digests", """SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}') AS digest FROM region""")
def i07(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", X.canonical_digest(["r_regionkey", "r_name"]).alias("digest"))


@query("i08_salted_order", "SELECT c_custkey, sha256('fold' || chr(0) || c_custkey) AS h FROM customer")
def i08(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.salted_key(F.col("c_custkey"), "fold").alias("h"))


LOGIT = "ln(q) - ln(1 - q)"


@query("i10_calibrated", f"""WITH {EV}, e AS (SELECT i, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ev)
SELECT i, round(1 / (1 + exp(-(({LOGIT}) * 0.8 + 0.3))), 6) AS calibrated, round(1 / (1 + exp(-({LOGIT} - ln(4.0)))), 6) AS plain, round(CASE WHEN q <= 0.2 THEN 0 WHEN q <= 0.5 THEN (q - 0.2) / 0.3 ELSE 1 END, 6) AS curve FROM e""")
def i10(spark, sf):
    """With i11 and i12: affine logits, logits without a class weight, and a piecewise curve."""
    p = F.col("p")
    return _r(streams(spark, sf).select("i", X.affine(p, 0.8, 0.3).alias("calibrated"), X.deweighted(p, 4.0).alias("plain"), X.piecewise(X.clip(p, 1e-6, 1 - 1e-6), [(0.2, 0.0), (0.5, 1.0)]).alias("curve")), "calibrated", "plain", "curve")


@query("i13_scaled_rects", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(floor(l_quantity * 1.5) - 2, 0) AS BIGINT) AS x0, CAST(greatest(floor(l_linenumber * 2.0) - 2, 0) AS BIGINT) AS y0,
CAST(least(ceil((l_quantity + 10) * 1.5) + 2, 60) AS BIGINT) AS x1, CAST(least(ceil((l_linenumber + 4) * 2.0) + 2, 20) AS BIGINT) AS y1 FROM lineitem) SELECT * FROM b WHERE x0 < x1 AND y0 < y1""")
def i13(spark, sf):
    box = (F.col("l_quantity"), F.col("l_linenumber"), F.lit(10), F.lit(4))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.scaled_rect(box, (F.lit(1.5), F.lit(2.0)), (F.lit(60), F.lit(20)), 2).alias("r"))
    return df.where("r IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "r.*")


@query("i14_similarity", """WITH m AS (SELECT label, CAST(embedding AS DOUBLE[]) AS b FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
j AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, b FROM embeddings JOIN m USING (label)),
c AS (SELECT *, list_transform(a, lambda z: z - list_avg(a)) AS ca, list_transform(b, lambda z: z - list_avg(b)) AS cb FROM j),
t AS (SELECT vec_id, list_transform(list_sort(list_transform(a, lambda z, k: {'x': -z, 'i': k}))[:10], lambda r: r.i) AS ta, list_transform(list_sort(list_transform(b, lambda z, k: {'x': -z, 'i': k}))[:10], lambda r: r.i) AS tb FROM j)
SELECT c.vec_id, round(list_inner_product(ca, cb) / sqrt(list_inner_product(ca, ca) * list_inner_product(cb, cb)), 6) AS correlation, len(list_intersect(ta, tb)) / 10.0 AS dice FROM c JOIN t USING (vec_id)""")
def i14(spark, sf):
    """Each vector against its label's first one."""
    df = table(spark, sf, "embeddings")
    first = df.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return _r(df.join(first, "label").select("vec_id", X.correlation(F.col("embedding"), F.col("b")).alias("correlation"), X.strongest_dice(F.col("embedding"), F.col("b"), 10).alias("dice")), "correlation")


@query("i16_first_evidence", f"""WITH {EV} SELECT i, CASE WHEN k < 20 THEN k WHEN x THEN pos ELSE s END AS value, CASE WHEN k < 20 THEN 'trace' WHEN x THEN 'index' ELSE 'nominal' END AS source FROM ev""")
def i16(spark, sf):
    pick = X.first_evidence([("trace", F.when(F.col("k") < 20, F.col("k"))), ("index", F.when(F.col("x"), F.col("pos"))), ("nominal", F.col("s"))])
    return streams(spark, sf).select("i", pick.alias("e")).select("i", "e.value", "e.source")


@query("c19_contrast_bits", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity - l_linenumber >= 10 THEN 25 > (l_quantity + l_linenumber) / 2 END AS bit FROM lineitem")
def c19(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.contrast_bit(F.lit(25), F.col("l_linenumber"), F.col("l_quantity"), 10).alias("bit"))


@query("c08_embargoed", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '5-LOW') OR contains(lower(o_orderpriority), 'med') AS embargoed FROM orders")
def c08(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.embargoed(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"], "MED").alias("embargoed"))


@query("i15_ring_contrast", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > l_linenumber THEN round(l_quantity * 4 - (l_quantity * 2 * l_quantity - l_quantity * l_linenumber) / (l_quantity - l_linenumber), 6) END AS contrast FROM lineitem")
def i15(spark, sf):
    """Quantity and line number stand for the areas of a box and of the cell in it, and multiples of the quantity for means."""
    c = X.ring_contrast(F.col("l_quantity") * 4, F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_quantity") * 2, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(c, 6).alias("contrast"))


@query("a11_checked_index", """WITH o AS (SELECT o_orderkey AS k, o_custkey % 16 AS c FROM orders)
SELECT k, CASE WHEN xor(xor(xor(k & 15, (k >> 4) & 15), xor((k >> 8) & 15, (k >> 12) & 15)), xor((k >> 16) & 15, (k >> 20) & 15)) = c THEN k END AS idx FROM o""")
def a11(spark, sf):
    code = F.col("o_orderkey") * 16 + F.col("o_custkey") % 16
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), X.checked_index(code).alias("idx"))


@query("i09_splitmix64", """WITH c AS (SELECT o_orderkey AS k, (o_orderkey::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM orders),
a AS (SELECT k, xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM c), b AS (SELECT k, xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM a)
SELECT k, CAST(xor(z, z // 2147483648::UHUGEINT) AS VARCHAR) AS mixed FROM b""")
def i09(spark, sf):
    """As unsigned decimal text."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.conv(F.hex(X.splitmix64(F.col("o_orderkey"))), 16, 10).alias("mixed"))


@query("i14b_edge_similarity", """WITH m AS (SELECT label, CAST(embedding AS DOUBLE[]) AS b FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
c AS (SELECT vec_id, a, b, list_transform(a, lambda z: z - list_avg(a)) AS ca, list_transform(b, lambda z: z - list_avg(b)) AS cb, list_aggregate(a, 'quantile_cont', 0.85) AS qa, list_aggregate(b, 'quantile_cont', 0.85) AS qb FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, b FROM embeddings JOIN m USING (label))),
t AS (SELECT vec_id, list_inner_product(ca, cb) / sqrt(list_inner_product(ca, ca) * list_inner_product(cb, cb)) AS r, len(list_filter(a, lambda z: z >= qa)) AS na, len(list_filter(b, lambda z: z >= qb)) AS nb, len(list_filter(list_zip(a, b), lambda z: z[1] >= qa AND z[2] >= qb)) AS shared FROM c)
SELECT vec_id, round(round(0.7 * r + 0.3 * (2.0 * shared / (na + nb)), 8), 6) AS score, round(round(2.0 * shared / (na + nb), 8), 6) AS dice FROM t""")
def i14b(spark, sf):
    """Each vector against its label's first one."""
    df = table(spark, sf, "embeddings")
    first = df.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    return _r(df.join(first, "label").select("vec_id", X.edge_similarity(F.col("embedding"), F.col("b")).alias("e")).select("vec_id", "e.score", "e.dice"), "score", "dice")
