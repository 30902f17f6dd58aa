"""Writers. Spark's committer publishes a folder's files at once; a manifest row or marker is written last."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fixed_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order and types; a missing or NULL value in a column that may have none raises."""
    out = []
    for f in schema:
        x = F.col(f.name).cast(f.dataType)
        out.append((x if f.nullable else F.when(x.isNull(), F.raise_error(F.lit(f"{f.name} is NULL"))).otherwise(x)).alias(f.name))
    return df.select(*out)


def publish(df: DataFrame, path: str, schema: StructType, by: list[str] | None = None) -> None:
    """A new Parquet folder; one that is there already raises and stays as it is."""
    writer = fixed_schema(df, schema).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def publish_all(frames: dict[str, tuple[DataFrame, StructType]], path: str) -> DataFrame:
    """Several tables under a folder, then a manifest (table, rows) as the sign that all are whole; returns it."""
    spark = next(iter(frames.values()))[0].sparkSession
    for name, (df, schema) in frames.items():
        publish(df, f"{path}/{name}", schema)
    rows = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in frames]
    manifest = rows[0]
    for r in rows[1:]:
        manifest = manifest.unionByName(r)
    manifest.write.mode("errorifexists").parquet(f"{path}/_complete")
    return spark.read.parquet(f"{path}/_complete")


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether publish_all() has ended there; asks the file system of the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_complete/_SUCCESS")
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def parts(df: DataFrame, part: list[str], pos: str, size: int, least: int) -> DataFrame:
    """df and part_no: each part's rows in parts of size rows by pos; parts of under least rows are left out. To be
    written with partitionBy."""
    at = F.row_number().over(Window.partitionBy(*part).orderBy(pos)) - 1
    numbered = df.withColumn("part_no", F.floor(at / size).cast("long"))
    return numbered.withColumn("__n", F.count("*").over(Window.partitionBy(*part, "part_no"))).where(F.col("__n") >= least).drop("__n")


def upserted(manifest: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The manifest with rows in place of those of the same key."""
    return manifest.join(rows, key, "left_anti").unionByName(rows)


def append_log(df: DataFrame, path: str) -> None:
    """Adds one JSON line a row to a log folder; what it holds stays as it is."""
    df.write.mode("append").json(path)


def write_archives(df: DataFrame, path: str, part: str, order: str, columns: list[str]) -> int:
    """Writes folder/<part>.npz for every value of part, with its rows in order, one array a column and the array `session` (the
    part); returns the number of files. A part is one archive and so one task's work: cut long streams into bounded parts
    first. A file takes its name when it is whole, so a task that runs again leaves one."""
    names = list(dict.fromkeys([order, *columns]))

    def save(frames):
        held = None
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(inner, recursive=True)

        def out(frame):
            name = str(frame[part].iloc[0])
            whole = f"{inner}/.{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(whole) as file:
                np.savez(file, session=np.array(name), **{c: np.stack(frame[c].to_list()) if frame[c].dtype == object else frame[c].to_numpy() for c in names})
            system.move(whole, f"{inner}/{name}.npz")
            return pd.DataFrame({"name": [name]})

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            values = frame[part]
            last = values == values.iloc[-1] if len(frame) else values.isna()
            for _, some in frame[~last].groupby(part, sort=False):
                yield out(some)
            held = frame[last]
        if held is not None and len(held):
            yield out(held)

    spread = df.select(part, *names).repartition(part).sortWithinPartitions(part, order)
    return spread.mapInPandas(save, "name string").distinct().count()
