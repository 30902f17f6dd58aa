"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row numbers that may be broadcast: 16 MB, some 50 MB as a hash table.
BROADCAST_ROWS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table: A-Z to a-z, everything else as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a temporary folder, in one JVM only: on a cluster no other
    machine would see it, so there it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="strandline-")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that a lost executor costs no more than the
    work since. spark.cleaner.referenceTracking.cleanCheckpoints lets Spark delete what isn't used any more."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(name: str, df: DataFrame) -> str:
    """name, or name with more underscores, such that df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, row: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows whose number gone (a written table of row) holds, and without the number. At most `most`
    numbers, counted first, are broadcast, so that no text moves; more are met by a shuffle on the number."""
    few = gone.count() <= most
    return docs.join(F.broadcast(gone) if few else gone.hint("shuffle_merge"), row, "left_anti").drop(row)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def texts(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, null as empty; few copies live at once."""
    for at in range(0, len(column), step):
        for value in column.slice(at, step).cast(pa.binary()).to_pylist():
            yield value or b""


def id_as_text(id_col: str) -> Column:
    return F.col(id_col).cast("string")
