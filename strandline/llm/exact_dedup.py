"""Exact dedup: group by a 128-bit content hash, compare the bytes inside groups, keep one row of each class.

Two texts are equal when they are identical after every character of [\\x20\\x09-\\x0D] is deleted.
Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.

Defined cases: a null text counts as empty, so null, empty and all-blank texts form one class. A null
doc_id orders after all others. Rows that repeat a doc_id are rows of their own: exactly one row of a
class has kept = true. Ids may be of any type that has an order. A very long text is hashed and compared
whole. Extra columns, whatever their names, are not read. An empty table gives no rows.

Plan: only texts whose hash another row has are compared, so all others stay where they are: the hashes
of two or more rows are counted, and up to BROADCAST_ROWS are broadcast (beyond that every text moves once).
Copies collapse in each map task before anything is shuffled (partial aggregation on hash and
bytes, and on hash and digest), so a group that holds a third of the rows sends one row a task. The join
that brings the class back to its rows carries no text, and adaptive execution may split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, unused, without_rows

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text_col: str = "text") -> Column:
    out = F.coalesce(F.col(text_col), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank))
    return out


def content_hash(text: Column) -> Column:
    """128 bits of the text, as 16 bytes."""
    return F.unhex(F.md5(text))


def _rows(docs: DataFrame, id_col: str, text_col: str, hash128, row: Column | None = None) -> DataFrame:
    """id, points, row (a number of its own), h and text_sha256 of each row, without text."""
    source = docs.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"), normalised(text_col).alias("norm"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    return cut(source.select("id", "points", "row", hash128(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")))


def _classes(docs: DataFrame, rows: DataFrame, text_col: str, hash128) -> DataFrame:
    """h, tag, group_size, best: a row for each class. tag is empty unless different bytes share the hash h."""
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("id").isNull().alias("none"), "id", "row"))
    digests = rows.groupBy("h", "text_sha256").agg(F.count("*").alias("n"), best.alias("best"))
    # The comparison of bytes, for hashes of more than one row: the text itself is a grouping key, beside its hash.
    repeated = cut(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    few = repeated.count() <= BROADCAST_ROWS
    hashed = docs.select(normalised(text_col).alias("norm")).select(hash128(F.col("norm")).alias("h"), "norm")
    bodies = hashed.join(F.broadcast(repeated) if few else repeated.hint("shuffle_merge"), "h", "left_semi").groupBy("h", "norm").agg(F.lit(1).alias("one"))
    shared = bodies.groupBy("h").agg(F.count("*").alias("bodies")).where("bodies > 1").select("h", F.lit(True).alias("split"))
    # Where different bytes share a hash, the second digest tells them apart; elsewhere the hash is the class.
    tag = F.when(F.col("split"), F.col("text_sha256")).otherwise("")
    return digests.join(shared, "h", "left").groupBy("h", tag.alias("tag")).agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128=content_hash) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    hash128 makes the hash of a normalised text; a weak one is slower and changes nothing else."""
    rows = _rows(docs, id_col, text_col, hash128)
    # Written, so that the join below is of two plain tables and adaptive execution may split a hot hash.
    classes = cut(_classes(docs, rows, text_col, hash128)).withColumnRenamed("h", "class_h")
    return rows.join(classes, (F.col("h") == F.col("class_h")) & ((F.col("tag") == "") | (F.col("tag") == F.col("text_sha256")))).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: one of each class of equal texts."""
    row = unused("__row", docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = _rows(numbered, id_col, text_col, content_hash, F.col(row))
    keep = _classes(numbered, rows, text_col, content_hash).select(F.col("best.row").alias(row))
    return without_rows(numbered, cut(rows.select(F.col("row").alias(row)).join(keep, row, "left_anti")), row)
