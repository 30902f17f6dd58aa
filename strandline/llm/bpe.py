"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is split by the tokenizer's pattern. A pre-token that is a vocabulary entry resolves through a
minimal perfect hash: one 64-bit hash gives a bucket, the bucket's displacement gives the one slot
where the entry can be, and one comparison of bytes tells an entry from a stranger. Other pre-tokens
are merged: their bytes form a linked list, a heap holds each adjacent pair that is a vocabulary entry
by (rank, position), and pairs made stale by a merge are passed over. A table from id to bytes decodes.

Defined cases: a null text is empty and has no ids; the file's special tokens do not exist here, so
their strings are ordinary text. Any bytes can be encoded, so decoding gives back the text. Repeated rows are encoded each, and a
null id is an id like any other. Of equal ranks the leftmost pair is merged first. A very long text is encoded whole by one task; a
long pre-token costs its length times the logarithm of it. Extra columns, whatever their names, are not read. An empty table gives no rows.

Scale: rows stream through tasks with no shuffle. The vocabulary (some 50,000 entries) is read on the
driver and broadcast; a worker remembers the ids of at most MEMO recent pre-tokens, then starts anew.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, of a file of lines 'base64 rank'. Ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys to n slots, by hash and displace."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a hash")
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        home = (low % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        self.displace = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        taken = bytearray(n)
        low, high, free = low.tolist(), high.tolist(), n - 1
        for bucket in np.argsort(-(starts[1:] - starts[:-1]), kind="stable").tolist():
            members = order[starts[bucket] : starts[bucket + 1]].tolist()
            if not members:
                break
            if len(members) == 1:  # any free slot will do: its number is kept, negated
                while taken[free]:
                    free -= 1
                taken[free], self.slots[free], self.displace[bucket] = 1, members[0], -free - 1
                continue
            d = 0
            while True:
                at = {self._slot(low[i], high[i], d) for i in members}
                if len(at) == len(members) and not any(map(taken.__getitem__, at)):
                    break
                d += 1
            self.displace[bucket] = d
            for i in members:
                slot = self._slot(low[i], high[i], d)
                taken[slot], self.slots[slot] = 1, i

    def _slot(self, low: int, high: int, d: int) -> int:
        mixed = (high + d * (low | 1) * 0x9E3779B1) & 0xFFFFFFFFFFFF
        return (mixed ^ (mixed >> 17)) % self.n

    def find(self, key: bytes) -> int:
        """The index that key would have; the caller compares bytes."""
        h = xxhash.xxh64_intdigest(key)
        low = h & 0xFFFFFFFF
        d = self.displace[low % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._slot(low, h >> 32, d)]


class _Memo(dict):
    """The ids of recent pre-tokens; one that is missing is encoded."""

    def __init__(self, encode_piece):
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.encode_piece(piece.encode())
        return ids


class Tokenizer:
    def __init__(self, tokens: list[bytes], pattern: str, vocabulary: PerfectHash | None = None):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.vocabulary = vocabulary or PerfectHash(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.decimal = [str(i) for i in range(len(tokens))]
        self.memo = _Memo(self.encode_piece)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        found = self.vocabulary.find(piece)
        return (found,) if self.tokens[found] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Heap over linked bytes: part i is piece[i:after[i]]; before and after link the living parts."""
        n, rank = len(piece), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            # Stale if part i has gone or grown, or its right neighbour has.
            if after[i] < 0 or (mid := after[i]) >= end or after[mid] != end:
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (left := before[i]) >= 0 and (r := rank(piece[left:end])) is not None:
                heappush(heap, (r, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids = list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text))))
        if len(self.memo) > MEMO:
            self.memo.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ready: dict[str, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """One in each Python worker, from the tables that the driver built."""
    key, tokens, pattern, vocabulary = shared.value
    if key not in _ready:
        _ready.clear()
        _ready[key] = Tokenizer(tokens, pattern, vocabulary)
    return _ready[key]


def _share(docs: DataFrame, path: str, pattern: str):
    """The vocabulary as a broadcast; its perfect hash is built once for a driver."""
    tokens = read_ranks(path)
    key = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
    if key not in _ready:
        _ready[key] = Tokenizer(tokens, pattern)
    return docs.sparkSession.sparkContext.broadcast((key, tokens, pattern, _ready[key].vocabulary))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int> of each whole text."""
    shared = _share(docs, path, pattern)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in batches:
            ids = [tokenizer.encode(t.decode("utf-8", "replace")) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, data binary: the bytes of each row's ids."""
    shared = _share(encoded, path, pattern)
    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in batches:
            data = [tokenizer.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], names=[id_col, "data"])

    return narrow.mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encode(), then decode(), in one task and without keeping the ids."""
    shared = _share(docs, path, pattern)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in batches:
            n, listed, decoded = [], [], []
            for text in texts(batch.column("text")):
                ids = tokenizer.encode(text.decode("utf-8", "replace"))
                n.append(len(ids))
                listed.append(hashlib.sha256(",".join(map(tokenizer.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
