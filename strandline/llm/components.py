"""Connected components of a link table: contraction inside tasks, then large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that one task contracts, on average; each costs it some 200 bytes.
PER_TASK = 250_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(batches):
    """Links of a task as one link from each node to the smallest node that it reaches by them."""
    own = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not own:
        return
    a, b = (np.concatenate(x) for x in zip(*own, strict=True))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    # Numbers of nodes keep their order, so the smallest number is the smallest node.
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent has a smaller number, so its root is known already
        parent[x] = parent[parent[x]]
    root = nodes[np.array(parent)]
    far = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["a", "b"])


def components(links: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """links: a, b (long). Returns node, root for every node with a link to another: root is the smallest
    node that it reaches.

    Each task first contracts its share of the links, per_task of them on average; where one task holds
    all of them, that is the whole work. Else rounds follow, in which neighbours are never gathered: each
    takes the smallest one by aggregation and joins it back, so a star of millions costs rows, not memory,
    and adaptive execution may split it. The number of rounds grows with the logarithm of the longest
    chain; each is cut() from its lineage."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tasks = -(-edges.count() // per_task)
    if tasks:
        edges = cut(edges.coalesce(tasks).mapInArrow(_stars, "a long, b long"))
    before = _state(edges) if tasks > 1 else (0,)
    while before[0]:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
