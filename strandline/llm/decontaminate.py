"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of bytes outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. A window is
13 consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit; a document is contaminated if it has a hit
and at least a twentieth of its words are hit.

The search runs once for each window length m. A table gives, for each block of B words that some
window holds, how far the search may shift without missing an occurrence; any other block allows
m - B + 1 words. Where the shift is 0, the bucket of that suffix block, divided by prefix block, names
the windows that can end here, and these are compared word by word.

Scale: documents stream through tasks with no shuffle. The benchmark is searched in blocks of at most
block_bytes of text, chosen by a running sum of sizes, and only one block is broadcast at a time;
beyond one block the hits so far travel with the rows and are cut() between blocks.

Defined cases: a null text has no words. A benchmark row with a null id still marks words as hit but is
no entry of the item list. Repeated items count once; repeated documents are reported each. A very long
text is searched whole by one task. Extra columns, whatever their names, are not read. An empty benchmark
hits nothing, and no documents give no rows.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts, unused

WINDOW = 13
BLOCK_BYTES = 1_000_000
#: bytes.translate table: A-Z to a-z, bytes of no word to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WuManber:
    """Finds all occurrences of windows (tuples of words, each with a set of item ids)."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], block: int = 2):
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for window in windows:
            by_length[len(window)].append(window)
        self.items = windows
        self.tables = [self._tables(m, by_length[m], min(block, m)) for m in sorted(by_length)]

    @staticmethod
    def _tables(m: int, windows: list[tuple[bytes, ...]], block: int):
        shift: dict[tuple[bytes, ...], int] = {}
        bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[bytes, ...]]]] = {}
        for window in windows:
            for end in range(block, m + 1):
                key = window[end - block : end]
                shift[key] = min(shift.get(key, m), m - end)
            bucket.setdefault(window[m - block :], {}).setdefault(window[:block], []).append(window)
        return m, block, shift, bucket

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, window) of each occurrence."""
        for m, block, shift, bucket in self.tables:
            n, far, at = len(words), m - block + 1, m
            allowed = shift.get
            while at <= n:
                key = (words[at - 2], words[at - 1]) if block == 2 else tuple(words[at - block : at])
                step = allowed(key, far)
                if step:
                    at += step
                    continue
                start = at - m
                for window in bucket[key].get(tuple(words[start : start + block]), ()):
                    if tuple(words[start:at]) == window:
                        yield start, window
                at += 1


def matcher(items: list[tuple[str | None, bytes]], size: int = WINDOW) -> WuManber:
    windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows_of(words_of(text), size):
            windows[window].update(() if item is None else (item,))
    return WuManber(dict(windows))


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most block_bytes (or one item), fetched one at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes) or 1
    if parts == 1:
        yield [(r[0], r[1].encode()) for r in items.collect()]
        return
    dealt = cut(items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts))))
    for part in range(parts):
        rows, held = [], 0
        for row in dealt.where(F.col("part") == part).toLocalIterator():
            rows.append((row[0], row[1].encode()))
            held += len(rows[-1][1])
            if held > block_bytes:
                yield rows
                rows, held = [], 0
        if rows:
            yield rows


_matchers: dict[str, WuManber] = {}


def _matcher(shared, size: int) -> WuManber:
    """The matcher of a broadcast block, built once in each Python worker."""
    key, items = shared.value
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = matcher(items, size)
    return _matchers[key]


def _search(docs: DataFrame, text_col: str, shared, size: int, marks: list[str]) -> DataFrame:
    """Sets the columns marks: a text's number of words, its hits (a byte a word, empty if none is hit) and its items.
    Where docs has them already, hits and items are added to."""
    n_words, old, items_ = marks
    again = old in docs.columns
    first = [c for c in docs.columns if c not in marks]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in first)

    def run(batches):
        search = _matcher(shared, size)
        for batch in batches:
            counts, all_hits, all_items = [], [], []
            old_hits = batch.column(old).to_pylist() if again else None
            old_items = batch.column(items_).to_pylist() if again else None
            for i, text in enumerate(texts(batch.column(text_col))):
                words = words_of(text)
                hits = bytearray(old_hits[i]) if again and old_hits[i] else None
                items = set(old_items[i]) if again else set()
                for start, window in search.find(words):
                    if hits is None:
                        hits = bytearray(len(words))
                    hits[start : start + len(window)] = b"\x01" * len(window)
                    items |= search.items[window]
                counts.append(len(words))
                all_hits.append(bytes(hits or b""))
                all_items.append(sorted(items))
            columns = [batch.column(c) for c in first] + [pa.array(counts, pa.int64()), pa.array(all_hits, pa.binary()), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*first, *marks])

    return docs.mapInArrow(run, f"{fields}, `{n_words}` long, `{old}` binary, `{items_}` array<string>")


def _searched(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int, block_bytes: int, marks: list[str]) -> DataFrame:
    def search(rows: DataFrame, block: list[tuple[str | None, bytes]]) -> DataFrame:
        return _search(rows, text_col, docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), size, marks)

    out = None
    for block in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        out = search(docs if out is None else cut(out), block)
    return out if out is not None else search(docs, [])


def _report(found: DataFrame, keep: list[str]) -> DataFrame:
    """The digest columns beside keep, computed from the marks; marks are summed in the JVM."""
    n_hit = F.length(F.replace(F.hex("__hits"), F.lit("00"))).cast("long") / 2
    return found.select(
        *keep,
        F.col("__words").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = _searched(narrow, benchmark, "__text", item_col, item_text_col, size, block_bytes, ["__words", "__hits", "__items"])
    return _report(found, ["__id"]).withColumnRenamed("__id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are; no shuffle."""
    marks = [unused(name, docs) for name in ("__words", "__hits", "__items")]
    found = _searched(docs, benchmark, text_col, item_col, item_text_col, size, block_bytes, marks)
    n_hit = F.length(F.replace(F.hex(marks[1]), F.lit("00"))) / 2
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col(marks[0])))).select(*[found[c] for c in docs.columns])
