"""Language ID by rank-order profiles.

The n-grams of a text are runs of 1 to 3 characters of its lower-cased letters, each word bounded by one
blank on both sides (a lone blank is no n-gram). A language's profile is its PROFILE most frequent
n-grams over all training documents, in order of falling count, then of code. A document is compared by
its own RANKED most frequent n-grams: the out-of-place distance adds, for each, how far its rank is from
its rank in the profile, or PROFILE where the profile lacks it. The nearest profile wins, ties by name.
score is the margin by which the second nearest is farther, as a share of its distance (0 to 1).

Learning sees only rows whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not null; counts
cover all of them and their whole texts. lang, source and doc_id are no inputs of a prediction.

Defined cases: a null text, or one without a letter, gives und with score 0. Without training rows every
text gives und. With one language only, score is 1. A null doc_id is not held out and not learned from.
Repeated rows count and are predicted each. Equal distances go to the language that sorts first, equal counts of n-grams to the smaller
code. A very long text is read whole by one task, in time that grows with its length. Extra columns, whatever their
names, are not read. An empty table gives no rows.

Scale: a task adds up its counts before anything is shuffled, and what is shuffled is one row for each
task, language and n-gram. The driver holds PROFILE n-grams for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, texts

PROFILE = 400
RANKED = 400
#: Characters of text that are sorted at a time.
STEP = 400_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to itself where it is a letter, else 0; built once in each worker."""
    if not _letters:
        _letters.append(np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.int64))
    return _letters[0]


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts; a code packs up to three code points, 21 bits each."""
    low = text.decode("utf-8", "replace").lower()
    codes, counts = [], []
    for at in range(0, len(low), STEP):
        # One step sees the two characters before it, so that no n-gram is lost or counted twice.
        start = max(0, at - 2)
        c = letters()[np.frombuffer(low[start : at + STEP].encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        new = np.arange(len(c)) >= at - start
        c, new = c[keep], new[keep]
        if at == 0:
            c, new = np.concatenate(([0], c)), np.concatenate(([False], new))
        if at + STEP >= len(low):
            c, new = np.concatenate((c, [0])), np.concatenate((new, [True]))
        one = c[new & (c != 0)]
        two = ((c[:-1] << 21) | c[1:])[new[1:]]
        three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[new[2:] & (c[1:-1] != 0)] if len(c) > 2 else c[:0]
        two = two[two != 0]
        found = np.sort(np.concatenate((one, two | (np.int64(1) << 62), three | (np.int64(1) << 63))))
        if len(found):
            first = np.concatenate(([0], np.nonzero(found[1:] != found[:-1])[0] + 1))
            codes.append(found[first])
            counts.append(np.diff(np.concatenate((first, [len(found)]))))
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
    return summed(np.concatenate(codes), np.concatenate(counts))


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.concatenate(([0], np.nonzero(codes[1:] != codes[:-1])[0] + 1))
    return codes[first], np.add.reduceat(counts[order], first)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = RANKED) -> np.ndarray:
    """The most frequent codes, by falling count, then code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        above = counts >= least
        codes, counts = codes[above], counts[above]
    return codes[np.lexsort((codes, -counts))][:most]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), fold(id_col).alias("fold")).where("fold <> 0 AND lang IS NOT NULL").select("text", "lang")

    def count(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size_now: dict[str, int] = {}

        def merged(lang):
            codes, counts = zip(*held[lang], strict=True)
            held[lang] = [summed(np.concatenate(codes), np.concatenate(counts))]
            size_now[lang] = len(held[lang][0][0])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                codes, counts = grams(text)
                if len(codes):
                    held.setdefault(lang, []).append((codes, counts))
                    size_now[lang] = size_now.get(lang, 0) + len(codes)
                    if size_now[lang] > 500_000:
                        merged(lang)
        for lang in held:
            merged(lang)
            codes, counts = held[lang][0]
            for at in range(0, len(codes), 50_000):
                part = codes[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(counts[at : at + 50_000])], names=["lang", "code", "n"])

    counted = narrow.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for row in top.collect():
        out.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {lang: np.array([code for _, code in sorted(rows)], np.int64) for lang, rows in sorted(out.items())}


class Judge:
    """All profiles as one table of ranks: codes in order, and for each language the rank of each code."""

    def __init__(self, known: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = list(known), size
        self.codes = np.unique(np.concatenate(list(known.values()))) if known else np.empty(0, np.int64)
        self.ranks = np.full((len(known), len(self.codes)), -1, np.int64)
        for row, codes in zip(self.ranks, known.values(), strict=True):
            row[np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def judge(self, text: bytes) -> tuple[str, float]:
        own = ranked(*grams(text))
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        theirs = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        far = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(far.argmin())
        if len(far) == 1:
            return self.names[best], 1.0
        second = int(np.partition(far, 1)[1])
        return self.names[best], float(1 - far[best] / second) if second else 0.0


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id_col, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(Judge(profiles(docs, id_col, text_col, lang_col)))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [shared.value.judge(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
