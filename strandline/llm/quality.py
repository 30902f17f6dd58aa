"""Quality classifier: histogram gradient-boosted trees over document statistics.

features() turns a whole text into a fixed vector of statistics of its bytes, words and lines. fit()
bins each statistic by quantiles and grows complete binary trees level by level on binned gradients
(logistic loss). A tree is three flat arrays in heap order, so scoring walks all rows at once in numpy,
one step a level.

Learning sees labelled rows only whose crc32(doc_id as text) mod 5 is not 0, at most MAX_ROWS of them,
those with the smallest xxhash64(doc_id) (a documented bound; statistics are of whole texts). Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: a null or empty text is a text of zero statistics and gets a score. Without any label, or
with labels of one kind only, every score is the smoothed share of label 1. A doc_id labelled more than
once counts with its smallest label. A null doc_id isn't held out (held_out = false) and can't be learned from.
Repeated rows are scored each. Equal gains of splits go to the first feature and bin. A very long text is read whole by one task, in time that
grows with its length. Extra columns, whatever their names, are not read. An empty table gives no rows.

Scale: one pass over the text joins the bounded ids to learn from, a second scores; no shuffle of text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, fold, texts, unused

MAX_ROWS = 12_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
THRESHOLD = 0.3
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: 13 shares and means, then the share of each mark.
WIDTH = 21 + len(MARKS)


def features(text: bytes) -> np.ndarray:
    out = np.zeros(WIDTH, np.float64)
    n = len(text)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(words))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    low = text.translate(LOWER_BYTES).split()
    kinds: dict[bytes, int] = {}
    for w in low:
        kinds[w] = kinds.get(w, 0) + 1
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = len(set(zip(low, low[1:]))) if m > 1 else 0
    ends = [w[-1] for w in words]
    out[:21] = (
        np.log1p(n),
        np.log1p(len(words)),
        size.mean(),
        size.std(),
        size.max(),
        upper / n,
        upper / max(1, upper + lower),
        counts[48:58].sum() / n,
        counts[128:].sum() / n,
        (counts[9:14].sum() + counts[32]) / n,
        len(kinds) / m,
        max(kinds.values(), default=0) / m,
        pairs / max(1, m - 1),
        len(lines) / m,
        len(set(lines)) / max(1, len(lines)),
        sum(map(len, lines)) / max(1, len(lines)),
        max(map(len, lines), default=0) / n,
        sum(1 for e in ends if e == 46 or e == 33 or e == 63) / m,
        sum(1 for e in ends if not (48 <= e <= 57 or 65 <= e <= 90 or 97 <= e <= 122 or e >= 128)) / m,
        sum(1 for w in words if w.isupper()) / m,
        sum(1 for w in words if w.isdigit()) / m,
    )
    out[21:] = counts[np.frombuffer(MARKS, np.uint8)] / m
    return out


class Trees:
    """Complete trees of one depth: split feature and threshold of each inner node, value of each leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = 1.0, least: float = 3.0) -> Trees:
    n, width = x.shape if len(x) else (0, WIDTH)
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if n == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    edges = np.full((width, bins), np.inf)
    for j, c in enumerate(cuts):
        edges[j, : len(c)] = c
    total = np.full(n, base)
    features_, thresholds_, values_ = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            at = (node - first) * bins
            gs = np.stack([np.bincount(at + binned[j], g, many * bins) for j in range(width)]).reshape(width, many, bins).cumsum(axis=2)
            hs = np.stack([np.bincount(at + binned[j], h, many * bins) for j in range(width)]).reshape(width, many, bins).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = -1
            gain = gain.transpose(1, 0, 2).reshape(many, -1)
            best = gain.argmax(axis=1)
            for k in range(many):
                if gain[k, best[k]] > 1e-9:
                    f[first + k], t[first + k] = divmod(int(best[k]), bins)[0], edges[divmod(int(best[k]), bins)]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        total += v[leaf]
        features_.append(f), thresholds_.append(t), values_.append(v)
    return Trees(np.array(features_), np.array(thresholds_), np.array(values_), base)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Trees:
    """Trees from at most max_rows labelled rows of docs outside the held-out fold."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
        .where(F.col("y").isNotNull() & (fold("id") != 0))
        .groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            vectors = [features(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y").cast(pa.int32()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], names=["id", "y", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sorted((r["id"], r["y"], r["x"]) for r in narrow.mapInArrow(run, schema).groupBy("id", "y").agg(F.min("x").alias("x")).collect())
    x = np.array([r[2] for r in rows]) if rows else np.zeros((0, WIDTH))
    return fit(x, np.array([float(r[1] > 0) for r in rows]))


def _scored(docs: DataFrame, trees: Trees, text_col: str) -> DataFrame:
    """docs with a column more, the score, last."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    names, added = docs.columns, unused("__score", docs)

    def run(batches):
        for batch in batches:
            x = np.stack([features(t) for t in texts(batch.column(text_col))]) if batch.num_rows else np.zeros((0, WIDTH))
            scores = shared.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted."""
    trees = learn(docs, labels, id_col, text_col, label_col)
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return _scored(narrow, trees, "__text").select(
        F.col("__id").alias(id_col), F.coalesce(fold("__id") == 0, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least threshold, all columns as they are; no shuffle of text."""
    scored = _scored(docs, learn(docs, labels, id_col, text_col, label_col), text_col)
    return scored.where(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
