"""A corpus pipeline: poor documents go, then exact copies, near copies and contaminated documents; the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame,
which run() writes as Parquet into the shared folder (spark.checkpoint.dir) and rereads. All stages but
the last return the columns of docs as they are, whatever they are. run() leaves these files to whoever
owns the folder, as its result is read from the last of them.

Defined cases: rows are told apart by number, not by id, so rows with a null id or with the id of another
row stay or go by their own text. A null or empty text is poor, equal or near to others by the rules of
the stage's operator. A very long text is handled whole by one task. An empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, decontaminate, exact_dedup, quality, simhash
from strandline.llm.common import shared_folder, table
from strandline.llm.queries import BPE_PATH


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, BPE_PATH, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_one_of_equal),
    ("SimHash near-dedup", keep_one_of_near),
    ("benchmark decontamination", keep_uncontaminated),
    ("byte-level BPE encoding and decoding", encoded),
]

#: A trained classifier and a tokenizer's merges are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
