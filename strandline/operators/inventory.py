"""Inventories of parts: what can be reused, what is accepted, and whether declared totals hold. All are equi-joins and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reusable(wanted: DataFrame, done: DataFrame, key: list[str], bindings: list[str]) -> DataFrame:
    """wanted and reuse: whether a finished part has the same key and the same bindings (hashes, versions). A NULL binding
    binds nothing: its part is built again. A part that is finished twice with other bindings is, too."""
    every = done.groupBy(*key).agg(*[F.min(b).alias(f"__lo_{b}") for b in bindings], *[F.max(b).alias(f"__hi_{b}") for b in bindings], *[F.count(F.when(F.col(b).isNull(), 1)).alias(f"__no_{b}") for b in bindings])
    same = F.lit(True)
    for b in bindings:
        same = same & (F.col(b) == F.col(f"__lo_{b}")) & (F.col(b) == F.col(f"__hi_{b}")) & (F.col(f"__no_{b}") == 0)
    return wanted.join(every, key, "left").select(*wanted.columns, F.coalesce(same, F.lit(False)).alias("reuse"))


def acceptance_chain(steps: list[tuple[str, DataFrame]], key: list[str], sha: str, binds: str) -> DataFrame:
    """key, broken_at: each key of the first step with the first step that is missing, repeated or doesn't bind the sha of the
    step before; NULL where the whole chain holds."""
    first_name, first = steps[0]
    once = lambda df, i: df.groupBy(*key).agg(F.min(sha).alias(f"__sha{i}"), F.min(binds).alias(f"__binds{i}"), F.count("*").alias(f"__n{i}"))
    chain, tests = once(first, 0), [(first_name, (F.col("__n0") == 1) & F.col("__sha0").isNotNull())]
    for i, (name, df) in enumerate(steps[1:], 1):
        chain = chain.join(once(df, i), key, "left")
        tests.append((name, (F.col(f"__n{i}") == 1) & (F.col(f"__binds{i}") == F.col(f"__sha{i - 1}"))))
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests]
    return chain.select(*key, F.coalesce(*broken, F.lit(None).cast("string")).alias("broken_at"))


def totals(df: DataFrame, declared: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """by, measure, declared, found: where a group's aggregated measure differs from the declared one, or one side lacks the
    group. declared has by and a long column for each measure."""
    found = df.groupBy(*by).agg(*[m.cast("long").alias(n) for n, m in measures.items()]).unpivot(by, list(measures), "measure", "found")
    stated = declared.select(*by, *[F.col(n).cast("long") for n in measures]).unpivot(by, list(measures), "measure", "declared")
    return stated.join(found, [*by, "measure"], "full").where(~F.col("declared").eqNullSafe(F.col("found"))).select(*by, "measure", "declared", "found")


def tier_inventories(rows: DataFrame, assignment: DataFrame, key: list[str], tier: str) -> DataFrame:
    """rows and their tier by a frozen assignment; a key without one, or with two, raises when the rows are read."""
    tiers = assignment.groupBy(*key).agg(F.min(tier).alias(tier), F.count("*").alias("__n"))
    problem = F.when(F.col("__n").isNull(), F.lit("no tier for ")).when(F.col("__n") > 1, F.lit("several tiers for "))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, name)).cast("string")).otherwise(F.col(tier))
    return rows.join(tiers, key, "left").select(*rows.columns, checked.alias(tier))


def manifest_windows(rows: DataFrame, manifest: DataFrame, part: list[str], pos: str, start: str, length: str, window: str) -> DataFrame:
    """rows with the window (and slot in it) that a manifest binds them to: windows are spread to their places, so an equi-join
    finds the rows. A window of which a row is missing or repeated is left out whole."""
    places = manifest.select(window, *part, F.col(length).alias("__length"), F.posexplode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)).alias("slot", pos))
    found = places.join(rows, [*part, pos])
    whole = found.groupBy(window, "__length").agg(F.count("*").alias("__n"), F.countDistinct("slot").alias("__d")).where("__n = __length AND __d = __length").select(window)
    return found.join(whole, window, "left_semi").drop("__length")


def link_groups(inventory: DataFrame, path: str, sha: str) -> DataFrame:
    """path, first, files: files of one content are one group, named by its smallest path, with its number of paths."""
    groups = inventory.groupBy(sha).agg(F.min(path).alias("first"), F.count("*").alias("files"))
    return inventory.join(groups, sha).select(path, "first", "files")


def link_problems(links: DataFrame, inventory: DataFrame, path: str, target: str, sha: str) -> DataFrame:
    """path, target, problem of links that don't hold: a path or its target isn't in the inventory, or they differ in content."""
    known = inventory.groupBy(path).agg(F.min(sha).alias("__own"))
    found = links.select(path, target).join(known, path, "left").join(known.select(F.col(path).alias(target), F.col("__own").alias("__of")), target, "left")
    problem = F.when(F.col("__own").isNull(), "no file").when(F.col("__of").isNull(), "no target").when(F.col("__own") != F.col("__of"), "other content")
    return found.select(path, target, problem.alias("problem")).where("problem IS NOT NULL")


def list_problems(listed: DataFrame, manifest: DataFrame, inventory: DataFrame, name: str, key: str, sha: str) -> DataFrame:
    """name, key, problem of lists that don't split a manifest (key, name): 'listed twice', 'not in the manifest', 'not listed', 'in
    another list', and 'content in another list', where a file (inventory: key, sha) of the same content is in a list of another name."""
    once = listed.groupBy(name, key).agg(F.count("*").alias("__n"))
    stated = manifest.groupBy(key).agg(F.min(name).alias("__stated"))
    both = once.join(stated, key, "full")
    tests = {
        "listed twice": F.col("__n") > 1, "not in the manifest": F.col("__stated").isNull(), "not listed": F.col(name).isNull(), "in another list": F.col(name) != F.col("__stated"),
    }
    reasons = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for p, t in tests.items()]))).alias("problem")
    plain = both.select(F.coalesce(name, "__stated").alias(name), key, reasons)
    # One row for each list and content: a content that many files share is counted, not paired.
    contents = once.join(inventory.select(key, sha).distinct(), key)
    shared = contents.groupBy(sha).agg(F.count_distinct(name).alias("__lists")).where("__lists > 1").select(sha)
    leaks = contents.join(shared, sha, "left_semi").select(name, key, F.lit("content in another list").alias("problem"))
    return plain.unionByName(leaks)
