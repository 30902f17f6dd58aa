"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans, leftmost and non-overlapping for each kind: assign (a named value of 8 or more characters),
access (AKIA and what follows, 16 or more), hex (32 or more). They are always reported.

Linking adds weak candidates, each of which alone would be noise:
  ident     a user, account, client or access-key id assignment
  opaque    40 or more of [A-Za-z0-9+/] with an upper-case letter, a lower-case one and a digit
  endpoint  an address with a scheme of services that take credentials
ident and opaque candidates that overlap a base span are dropped. Identifiers are access and ident;
secrets are assign, hex and opaque. Parts are in one scope if their starts are at most SCOPE code points
apart in one text. An ident is reported if a secret is in its scope, an opaque one if an identifier is,
an endpoint if both are. Offsets count code points; ends are exclusive.

Positions come from split() and regexp_extract_all(), which walk the same matches: a match starts where
the pieces and matches before it end.

Defined cases: a null text is empty and has no spans. Repeated rows are reported each; copies of a text
are linked once, by its SHA-256, so a text that holds a third of the rows is one group of parts. A null
doc_id is an id like any other. A very long text is searched whole, in time that grows with its length and
its matches. Extra columns, whatever their names, are not read. An empty table gives no rows.

Scale: one pass over the text, whose narrow result is cut(); the interval join moves only the parts of
texts with a weak candidate, under (text, scope bucket), and as it is a semi join it makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCOPE = 256
FOLD = 256
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")

_SAYS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))" + _SAYS + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"(?:(?i:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:[_-]?(?:name|id))?|login))" + _SAYS + r"([A-Za-z0-9@._-]{3,})"
OPAQUE = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?|ftps?|s3|mysql|postgres(?:ql)?|mongodb|redis|amqps?)://[^\x00-\x20\"'<>\\)]+"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _spans(text: Column, pattern: str, kind: str, maybe: Column) -> Column:
    """array<struct<start, kind (its number), end, value>> of all matches; maybe must be true wherever there is one."""
    number = KINDS.index(kind)
    value = 1 if kind in ("assign", "ident") else 0
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.transform(_matches(text, pattern), F.char_length).alias("size"), _matches(text, pattern, value).alias("value")
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(x["size"].isNull(), acc["found"]).otherwise(F.array_append(acc["found"], span)).alias("found"))

    # A fold copies its list at each step, so lists are kept short: matches by FOLD, each chunk from where it begins.
    chunks = F.transform(F.sequence(F.lit(1), F.size(zipped), F.lit(FOLD)), lambda i: F.slice(zipped, i, FOLD))

    def length(chunk: Column) -> Column:
        return F.aggregate(chunk, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["size"], F.lit(0)))

    begins = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, chunk: F.array_append(acc, F.element_at(acc, -1) + length(chunk)))
    found = F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("found")), step, lambda acc: acc["found"]))
    return F.when(maybe, F.flatten(found)).otherwise(empty)


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base and weak (arrays of spans) and, where there are weak ones, the text's key."""
    text = F.col("text")
    says = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id",
        "text",
        F.filter(_spans(text, ASSIGN, "assign", says & text.rlike(ASSIGN)), lambda x: F.char_length(x["value"]) >= 8).alias("assign"),
        _spans(text, ACCESS, "access", F.contains(text, F.lit("AKIA"))).alias("access"),
        _spans(text, HEX, "hex", text.rlike(HEX)).alias("hex"),
        _spans(text, IDENT, "ident", says & text.rlike(IDENT)).alias("ident"),
        F.filter(_spans(text, OPAQUE, "opaque", text.rlike(OPAQUE)), lambda x: x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]") & x["value"].rlike("[0-9]")).alias("opaque"),
        _spans(text, ENDPOINT, "endpoint", F.contains(text, F.lit("://"))).alias("endpoint"),
    )
    base = _bare(F.concat("assign", "access", "hex"))
    return (
        rows.withColumn("base", base)
        .withColumn("loose", F.filter(_bare(F.concat("ident", "opaque")), lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))
        .withColumn("weak", F.concat("loose", _bare(F.col("endpoint"))))
        .select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], "base", "weak", F.when(F.size("weak") > 0, F.sha2("text", 256)).alias("key"))
    )


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """key, added: the weak candidates of each text that have their complementary parts in scope."""
    part = rows.where("key IS NOT NULL").select("key", "base", "weak").dropDuplicates(["key"]).select("key", F.explode(F.concat("base", "weak")).alias("part"))
    part = part.select("key", "part.*").withColumn("bucket", F.floor(F.col("start") / scope))
    around = part.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))).select("key", "bucket", F.col("start").alias("other"), "kind")
    identifiers = around.where(F.col("kind").isin(1, 3)).drop("kind")
    secrets = around.where(F.col("kind").isin(0, 2, 4)).drop("kind")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"key": "k2", "bucket": "b2"})
        return left.join(right, (left["key"] == right["k2"]) & (left["bucket"] == right["b2"]) & (F.abs(left["start"] - right["other"]) <= scope), "left_semi")

    found = near(part.where("kind = 3"), secrets).union(near(part.where("kind = 4"), identifiers)).union(near(near(part.where("kind = 5"), identifiers), secrets))
    return found.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = cut(_parts(docs, id_col, text_col))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    plain = rows.where("key IS NULL").withColumn("added", none)
    weak = rows.where("key IS NOT NULL").join(_linked(rows, scope), "key", "left").withColumn("added", F.coalesce("added", none))
    return plain.unionByName(weak.select(*plain.columns)).select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans")
    )
