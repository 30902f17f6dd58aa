"""Contracts and provenance: each check returns its violations as rows (rule, subject, detail), so that several are
united and a table is right if nothing comes back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def violations(df: DataFrame, subject: Column, rules: dict[str, Column], detail: Column | None = None) -> DataFrame:
    """All rules that a row fails, in one pass; a rule that is NULL fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    shown = F.lit(None) if detail is None else detail
    return df.select(F.explode(failed).alias("rule"), subject.cast("string").alias("subject"), shown.cast("string").alias("detail"))


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def required(df: DataFrame, subject: str, paths: list[str]) -> DataFrame:
    """Missing values of required fields, nested ones by their path."""
    return violations(df, F.col(subject), {f"required {p}": F.col(p).isNotNull() for p in paths})


def schema_problems(found: StructType, wanted: StructType) -> list[str]:
    """Differences of name, order and type (not of nullability or metadata)."""
    if [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in wanted]:
        return []
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (found, wanted))
    out = [f"{n}: missing" for n in want if n not in have] + [f"{n}: not expected" for n in have if n not in want]
    out += [f"{n}: {have[n]} instead of {want[n]}" for n in want if n in have and have[n] != want[n]]
    return out or ["columns in another order"]


def declared_counts(declared: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose declared count isn't the number of their rows."""
    found = rows.groupBy(key).agg(F.count("*").alias("__n"))
    both = declared.select(key, count).join(found, key, "full").select(key, count, F.coalesce("__n", F.lit(0)).alias("__n"))
    return violations(both, F.col(key), {"declared count": F.col(count) == F.col("__n")}, F.concat_ws(" of ", "__n", count))


def one_value_each(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose columns are NULL somewhere or hold several values."""
    n = F.count("*").alias("__rows")
    per = df.groupBy(key).agg(n, *[F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("n")).alias(c) for c in columns])
    return violations(per, F.col(key), {f"one value of {c}": (F.col(f"{c}.a") == F.col(f"{c}.b")) & (F.col(f"{c}.n") == F.col("__rows")) for c in columns})


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """Blank and repeated ids; a blank one is reported once, with its number of rows."""
    per = df.groupBy(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")).alias("id")).agg(F.count("*").alias("n"))
    return violations(per, F.col("id"), {"id not blank": F.col("id") != "", "id unique": (F.col("n") == 1) | (F.col("id") == "")}, F.col("n"))


def close_to(df: DataFrame, evidence: DataFrame, key: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Rows that differ from their evidence by more than the tolerance, or that lack it or a row."""
    other = evidence.select(*key, *[F.col(v).alias(f"__{v}") for v in values])
    subject = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return violations(df.select(*key, *values).join(other, key, "full"), subject, {f"{v} as in evidence": F.abs(F.col(v) - F.col(f"__{v}")) <= tolerance for v in values})


def whole_groups(df: DataFrame, refused: DataFrame, group: str, order: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """The rows of groups without a refused member, and each refused group with its first reason."""
    first = refused.groupBy(group).agg(F.min_by(reason, order).alias(reason))
    return df.join(first, group, "left_anti"), first


def only_allowed(df: DataFrame, reasons: str, allowed: list[str]) -> DataFrame:
    """Rows that have reasons, all of them allowed."""
    return df.where((F.size(reasons) > 0) & (F.size(F.array_except(reasons, F.array(*map(F.lit, allowed)))) == 0))


def gated(df: DataFrame, waivers: DataFrame, key: str, passed: Column) -> DataFrame:
    """key, outcome: passed, waived (a recorded exception, never counted as passed) or failed."""
    w = waivers.select(key).distinct().withColumn("__w", F.lit(True))
    outcome = F.when(F.coalesce(passed, F.lit(False)), "passed").when(F.col("__w"), "waived").otherwise("failed")
    return df.join(w, key, "left").select(key, outcome.alias("outcome"))


def inventory(found: DataFrame, listed: DataFrame) -> DataFrame:
    """path, problem of two tables (path, length, sha256): missing, unexpected, or of another length or content."""
    a, b = (d.select("path", F.struct("length", "sha256").alias(n)) for d, n in ((found, "a"), (listed, "b")))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("a.length") != F.col("b.length"), "length").when(F.col("a.sha256") != F.col("b.sha256"), "content")
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def sequence_problems(df: DataFrame, part: list[str], pos: str, state: str) -> DataFrame:
    """part, pos: rows whose state goes back below an earlier one."""
    before = F.max(state).over(Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__b", before).where(F.col(state) < F.col("__b")).select(*part, pos)
