"""Readers. Schemas are given, never inferred; what a reader refuses it raises when the rows are read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .arrays import PARTITION_BYTES, ArrayArchives


def columns_where(spark: SparkSession, path: str, columns: list[str], condition: Column | None = None) -> DataFrame:
    """Some columns of a Parquet table, with a condition that the scan gets as a pushed filter."""
    df = spark.read.parquet(path)
    return (df if condition is None else df.where(condition)).select(*columns)


def versioned_csv(spark: SparkSession, path: str, versions: list[StructType], fills: dict[str, Column]) -> DataFrame:
    """A CSV file of one of several versions, told by its header; columns of the last version that it lacks are filled."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].split(",") if header else []
    schema = next((v for v in versions if v.names == names), None)
    if schema is None:
        raise ValueError(f"unknown columns: {names}")
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    return df.select(*[F.col(f.name) if f.name in schema.names else fills[f.name].cast(f.dataType).alias(f.name) for f in versions[-1]])


def json_lines(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """One JSON object a line. A broken line, or one without a key, raises when it is read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    checked = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"line without {k}"))).otherwise(F.col(k)).alias(k) if k in keys else F.col(k) for k in schema.names]
    return df.select(*checked)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, trimmed; a blank or repeated one raises when it is read."""
    ids = spark.read.text(path).groupBy(F.trim("value").alias("id")).agg(F.count("*").alias("n"))
    problem = F.when(F.col("id") == "", F.lit("blank id")).when(F.col("n") > 1, F.concat(F.lit("repeated id "), F.col("id")))
    return ids.select(F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("id")).alias("id"))


def json_tree(spark: SparkSession, path: str, schema: StructType, pattern: str, part_names: list[str], lines: bool = False) -> DataFrame:
    """All JSON files under a folder whose names fit the pattern (one object or list each, or JSON lines), with their last folders as columns. The rows come
    in no order; the columns sort them."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)
    folders = F.split(F.col("_metadata.file_path"), "/")
    return df.select(*[F.element_at(folders, -1 - len(part_names) + i).alias(n) for i, n in enumerate(part_names)], *schema.names)


def first_of_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, with the group's number of rows."""
    w = Window.partitionBy(*by)
    return df.withColumn("rows", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order))).where("__r = 1").drop("__r")


def tail(df: DataFrame, part: list[str], pos: str, n: int) -> DataFrame:
    """The last n rows of each part."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc(pos)))).where(F.col("__r") <= n).drop("__r")


def override_map(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, overrides: a map of each group's keys to values; the smallest value wins where a key repeats."""
    one = df.groupBy(group, key).agg(F.min(value).alias(value))
    return one.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("overrides"))


def first_link(df: DataFrame, links: str, pattern: str) -> DataFrame:
    """df and link: the first of an array of links that fits a pattern, NULL without one."""
    return df.withColumn("link", F.try_element_at(F.filter(links, lambda x: x.rlike(pattern)), F.lit(1)))


def held_keys(df: DataFrame, session: str, pos: str, keys: list[str]) -> DataFrame:
    """session, pos and a flag a key for each row: made flags that are the same on every run, over streams of any table. Key j
    is held while (pos + 7 * session) is in its own stretch of a cycle of 90 rows."""
    phase = F.pmod(F.col(pos) + 7 * F.col(session), F.lit(90))
    return df.select(F.col(session).alias("session"), F.col(pos).alias("pos"), *[phase.between(10 * j, 10 * j + 5 + j).alias(k) for j, k in enumerate(keys)])


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path (below the folder), length, sha256 of all files under a folder; contents stay in the tasks that read them. Spark's scan
    passes over empty files, so those aren't listed: inventory() reports a listed one as missing."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.split_part(F.col("path"), F.lit(path.rstrip("/") + "/"), F.lit(2))
    return df.select(name.alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def _arrays(spark: SparkSession, path: str, **options: str):
    spark.dataSource.register(ArrayArchives)
    return spark.read.format("array_archives").options(path=path, **options)


def array_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, array, shape, dtype, columnar (Fortran order) of all arrays of all .npz files under a folder. Only directories
    and headers are read, by seeking; a broken file raises when it is read."""
    return _arrays(spark, path, what="headers").load().select(F.col("file").alias("path"), "array", "shape", "dtype", "columnar")


def array_rows(spark: SparkSession, path: str, schema: str | None = None, partition_bytes: int = PARTITION_BYTES, ident: str | None = None, arrays: dict[str, tuple[list[str], tuple[int | None, ...]]] | None = None, rows: int | None = None, names: str = "*") -> DataFrame:
    """file, row and a column for each array of all .npz files under a folder, with types and nested shapes as they are.

    schema: the columns to read (file and row among them if wanted), by default those of the first file. arrays: name -> (dtypes,
    shape), None standing for any size. A file without one of these, of another type or shape, or whose one-string array
    ident isn't its own name raises, a large one when the scan is laid out, a small one when it is read. A task reads a range of rows (of partition_bytes, and `rows` rows
    at most) or several small files, in batches of such ranges. Only files whose names fit the pattern `names` are opened."""
    options = {"bytes": str(partition_bytes), "contract": json.dumps(arrays or {}), "pathGlobFilter": names} | ({"ident": ident} if ident else {}) | ({"rows": str(rows)} if rows else {})
    reader = _arrays(spark, path, **options)
    return (reader.schema(schema) if schema else reader).load()


def array_archives(spark: SparkSession, path: str, ident: str, arrays: dict[str, tuple[list[str], tuple[int | None, ...]]], rows: int | None = None) -> DataFrame:
    """id (the file's name), pos and each array's row as a flat array of doubles: array_rows() for numeric vectors, at most `rows` rows to a task."""
    df = array_rows(spark, path, None, PARTITION_BYTES, ident, arrays, rows)

    def flat(name: str) -> Column:
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if not isinstance(kind, ArrayType):
            return F.array(column.cast("double"))
        while isinstance(kind.elementType, ArrayType):
            column, kind = F.flatten(column), kind.elementType
        return column.cast("array<double>")

    name = F.regexp_extract("file", r"([^/]+)\.npz$", 1)
    return df.select(name.alias("id"), F.col("row").alias("pos"), *[flat(k).alias(k) for k in arrays])
