"""SimHash near-dedup with pivot distance tables.

A text's fingerprint: A-Z lower-cased, words are runs outside [\\x20\\x09-\\x0D], shingles are three words
joined by one space (all words if there are fewer), each hashed by XXH64 with seed 42; a bit is 1 if it
is set in over half of the shingles, repeats counted. No words: 0. Fingerprints link at 3 or fewer
differing bits, and a document's component is the smallest doc_id that it reaches.

Linking works on distinct fingerprints:
1. The 64 bits are cut into 5 blocks. Two fingerprints with at most 3 differing bits agree on 2 blocks
   at least, so each of the 10 pairs of blocks is a key and linked fingerprints meet under one of them.
   This loses no link; it keeps a pivot table from being compared with the whole table.
2. Under a key, each fingerprint has its row of a pivot distance table: its Hamming distances to PIVOTS
   fixed reference fingerprints. By the triangle inequality a pair whose coordinates differ by more
   than 3 anywhere can't link; the maximum coordinate difference discards such pairs.
3. Survivors are verified by exclusive or and bit count. A search that removes what it has reached
   keeps one edge a fingerprint, never all pairs.
A key with more than CELL fingerprints is dealt into chunks, and each pair of chunks is a cell of its
own; edges of the cells meet again in components().

Defined cases: null and empty texts have fingerprint 0 and link like any other. A null doc_id belongs to
its component and never names it; a component of null ids only has a null id. Repeated rows are
reported each. A very long text is hashed whole by one task, in time that grows with its length. There are no ties: links
and smallest ids decide. Extra columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, cut, texts, unused, without_rows
from .components import components

SHINGLE = 3
DISTANCE = 3
BLOCKS = 5
PIVOTS = 16
CELL = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a signed long) of each row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], names=["id", "fp"])

    return narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: n hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "big"), 42) for i in range(n)], np.uint64)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each reference."""
    return np.bitwise_count(references[:, None] ^ fps[None, :]).astype(np.int8)


def tree_edges(fps: np.ndarray, references: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges, one less than members, of each component of distinct fingerprints."""
    table = distance_table(fps, references)
    order = np.argsort(table[0], kind="stable")
    left, table = fps[order], table[:, order]
    edges = []
    while len(left):
        frontier = [(left[0], table[:, 0])]
        left, table = left[1:], table[:, 1:]
        while frontier and len(left):
            fp, row = frontier.pop()
            lo, hi = np.searchsorted(table[0], (row[0] - most, row[0] + most + 1))
            if lo == hi:
                continue
            near = lo + np.nonzero((np.abs(table[:, lo:hi] - row[:, None]) <= most).all(axis=0))[0]
            near = near[np.bitwise_count(left[near] ^ fp) <= most]
            if len(near):
                edges += [(int(fp), int(x)) for x in left[near]]
                frontier += [(left[i], table[:, i]) for i in near]
                stay = np.ones(len(left), bool)
                stay[near] = False
                left, table = left[stay], table[:, stay]
    return edges


def _link_cells(batches, most: int, n_pivots: int):
    """Batches of rows (cell columns, fp), sorted by cell; a cell may span batches."""
    references = pivots(n_pivots)
    names = ["combo", "key", "left", "right"]
    rest_cell, rest = None, np.empty(0, np.uint64)

    def out(edges):
        a = np.array([e[0] for e in edges], np.uint64).view(np.int64)
        b = np.array([e[1] for e in edges], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.concatenate(([0], np.nonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0))[0] + 1, [len(fps)]))
        edges = []
        first = tuple(cells[:, 0])
        if rest_cell is not None and first != rest_cell and len(rest) > 1:
            edges += tree_edges(rest, references, most)
        carried = rest if first == rest_cell else np.empty(0, np.uint64)
        # Cells of two rows, the usual size, go through the pivot table together.
        sizes = np.diff(starts)
        pairs = starts[:-1][(sizes == 2)]
        pairs = pairs[(pairs > 0) & (pairs + 2 < len(fps))]
        x, y = fps[pairs], fps[pairs + 1]
        near = np.nonzero((np.abs(distance_table(x, references) - distance_table(y, references)) <= most).all(axis=0))[0]
        near = near[np.bitwise_count(x[near] ^ y[near]) <= most]
        edges += zip(x[near].tolist(), y[near].tolist(), strict=True)
        done = set(pairs.tolist())
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if s in done:
                continue
            members = fps[s:e] if s else np.concatenate((carried, fps[s:e]))
            if e == len(fps):
                rest_cell, rest = tuple(cells[:, -1]), members
            elif len(members) > 1:
                edges += tree_edges(members, references, most)
        if edges:
            yield out(edges)
    if len(rest) > 1:
        yield out(tree_edges(rest, references, most))


def links(fps: DataFrame, most: int = DISTANCE, blocks: int = BLOCKS, n_pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """fps: distinct fp. Returns a, b: links that join each component, many of them more than once."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - most):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "key"))
    counts = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, ["combo", "key"])
    chunks = F.ceil(F.col("n") / cell).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    cells = met.select("combo", "key", "fp", "chunk", "chunks", other).where("chunks = 1 OR other <> chunk OR chunks = 2").select(
        "combo", "key", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "fp"
    )
    dealt = cells.repartition("combo", "key", "left", "right").sortWithinPartitions("combo", "key", "left", "right")
    return dealt.mapInArrow(lambda batches: _link_cells(batches, most, n_pivots), "a long, b long")


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """rows: id, fp. Returns fp, root (the component's name among fingerprints), least (the smallest id of fp)."""
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    return cut(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = DISTANCE) -> DataFrame:
    """One row per document: id_col, fingerprint, component_id."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = _classes(rows, most)
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: of each component the row with the smallest id,
    and where that id repeats in it one of its rows. A component of null ids only keeps one row too. Rows
    are told apart by a number, not by id, so what shares an id in another component stays."""
    row = unused("__row", docs)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    rank = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    rows = cut(fingerprints(numbered.select(rank.alias("rank"), F.col(text_col).alias("text")), "rank", "text"))
    classes = _classes(rows, DISTANCE)
    keep = classes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    gone = cut(rows.select(F.col("id.row").alias(row)).join(keep, row, "left_anti"))
    return without_rows(numbered, gone, row)
