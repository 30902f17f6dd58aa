"""Centroid clustering by dual-tree Lloyd in exact integers.

Vectors become integers floor(scale * x). The first centroids are the k vectors with the smallest SHA-256 of
'seed:id'. Each round assigns every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and puts
floor(sum / count) of its vectors, component by component, in place of every centroid that has any.

Method: vectors are dealt into blocks, and a cover tree is made over each block once: children of a node lie within
half its scale and, among themselves, further apart than that. Each round a tree of the same kind is made over
the centroids, and the two are walked together, breadth first: a pair of nodes is dropped if the
least distance its radii allow is more than a distance that some centroid is known to keep for all of the vectors' node. Pairs of
leaves that are left are compared exactly. Bounds are floating point with a margin, so they never drop a tie.

Scale: blocks are cut from partitions as they come, so no key decides where a vector goes; the trees are written
once to the shared folder. A round is one pass that yields k rows of sums a task; k rows come to the driver.

Defined cases: rows are kept if the vector has exactly `dim` components, none null or not finite; others are
not returned. Repeated rows count each; of rows with equal hashes (one id) the smaller vector comes first. A null id is the
empty text in the hash. With fewer than k rows there are fewer centroids. A component of over 2 ** 26 in size
after scaling, whose distances a long can't hold, is an error. Extra columns, whatever their names, are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors of one cover tree, vectors of one of its leaves, and centroids of one leaf.
BLOCK, LEAF, CENTROID_LEAF = 1024, 8, 2
LARGEST = 1 << 26
#: Pairs that are compared at a time.
CHUNK = 16_384


def _as_integers(vector: str, scale: int) -> Column:
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    too_large = F.exists(scaled, lambda x: F.abs(x) > LARGEST)
    return F.when(too_large, F.raise_error(F.lit("a component is beyond what exact distances can hold"))).otherwise(scaled)


def _kept(vector: str, dim: int) -> Column:
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~odd, F.lit(False))


@dataclass
class Tree:
    """A cover tree. Node i has the point centre[i], all its points within radius[i], and either its children
    (first[i] and the following many[i]) or, if many[i] is 0, its points order[low[i]:high[i]]."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    many: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.order, self.centre, self.radius, self.first, self.many, self.low, self.high)]

    @staticmethod
    def unpack(parts: list[bytes]) -> Tree:
        return Tree(*(np.frombuffer(p, np.float64 if i == 2 else np.int64) for i, p in enumerate(parts)))


def _squared(points: np.ndarray, at: np.ndarray, centre: int) -> np.ndarray:
    gap = points[at] - points[centre]
    return np.einsum("ij,ij->i", gap, gap)


def cover_tree(points: np.ndarray, leaf: int) -> Tree:
    """A cover tree over the rows of an integer matrix, from the first row down."""
    order = np.arange(len(points))
    centre, radius, first, many, low, high = [0], [0.0], [0], [0], [0], [len(points)]
    away = {0: _squared(points, order, 0)}  # squared distance of a waiting node's points to its centre
    node = 0
    while node < len(centre):
        lo, hi, distance = low[node], high[node], away.pop(node)
        far = int(distance.max(initial=0))
        radius[node] = float(np.sqrt(far))
        if far and hi - lo > leaf:
            # The scale is the least power of two that covers the node; children cover half of it.
            scale = 1
            while scale * scale < far:
                scale *= 2
            within = scale * scale // 4 if scale > 1 else 0
            rest, gaps, pivot, groups = order[lo:hi].copy(), distance, centre[node], []
            while True:
                near = gaps <= within
                groups.append((pivot, rest[near], gaps[near]))
                rest = rest[~near]
                if not len(rest):
                    break
                pivot = int(rest[0])
                gaps = _squared(points, rest, pivot)
            first[node], many[node], at = len(centre), len(groups), lo
            for pivot, members, gaps in groups:
                order[at : at + len(members)] = members
                away[len(centre)] = gaps
                for values, value in ((centre, pivot), (radius, 0.0), (first, 0), (many, 0), (low, at), (high, at + len(members))):
                    values.append(value)
                at += len(members)
        node += 1
    longs = [np.array(x, np.int64) for x in (centre, first, many, low, high)]
    return Tree(order, longs[0], np.array(radius), *longs[1:])


def _children(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the i-th node its children, and i beside each of them."""
    many = tree.many[nodes]
    place = np.repeat(np.arange(len(nodes)), many)
    return tree.first[nodes][place] + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many), place


def nearest(points: np.ndarray, tree: Tree, centroids: np.ndarray, centroid_tree: Tree) -> tuple[np.ndarray, np.ndarray, int]:
    """For every row the number of its nearest centroid, the squared distance, and how many pairs were compared."""
    bound = np.full(len(tree.centre), np.inf)
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaf_pairs = []
    while len(v):
        gap = (points[tree.centre[v]] - centroids[centroid_tree.centre[c]]).astype(np.float64)
        distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        # The node's centre is itself a centroid, so it is this near to every vector of the other node.
        np.minimum.at(bound, v, distance + tree.radius[v])
        keep = distance - tree.radius[v] - centroid_tree.radius[c] <= bound[v] * (1 + 1e-9) + 1e-6
        v, c = v[keep], c[keep]
        v_leaf, c_leaf = tree.many[v] == 0, centroid_tree.many[c] == 0
        both = v_leaf & c_leaf
        leaf_pairs.append((v[both], c[both]))
        split_v = ~v_leaf & (c_leaf | (tree.radius[v] >= centroid_tree.radius[c]))
        split_c = ~both & ~split_v
        below, place = _children(tree, v[split_v])
        np.minimum.at(bound, below, bound[v[split_v]][place])
        c_below, c_place = _children(centroid_tree, c[split_c])
        v, c = np.concatenate([below, v[split_c][c_place]]), np.concatenate([c[split_v][place], c_below])
    v, c = (np.concatenate(x) for x in zip(*leaf_pairs, strict=True))
    gap = (points[tree.centre[v]] - centroids[centroid_tree.centre[c]]).astype(np.float64)
    keep = np.sqrt(np.einsum("ij,ij->i", gap, gap)) - tree.radius[v] - centroid_tree.radius[c] <= bound[v] * (1 + 1e-9) + 1e-6
    v, c = v[keep], c[keep]
    best = np.full(len(points), np.iinfo(np.int64).max)
    number = np.full(len(points), len(centroids))
    compared = 0
    sizes = (tree.high[v] - tree.low[v]) * (centroid_tree.high[c] - centroid_tree.low[c])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(v):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, "right")) - 1)
        rows, found = [], []
        for i in range(at, end):
            own = tree.order[tree.low[v[i]] : tree.high[v[i]]]
            others = centroid_tree.order[centroid_tree.low[c[i]] : centroid_tree.high[c[i]]]
            rows.append(np.repeat(own, len(others)))
            found.append(np.tile(others, len(own)))
        rows, found = np.concatenate(rows), np.concatenate(found)
        gap = points[rows] - centroids[found]
        distance = np.einsum("ij,ij->i", gap, gap)
        compared += len(rows)
        # Sorted so that the first of a row is its nearest, of these the one of the smallest number.
        sort = np.lexsort((found, distance, rows))
        rows, found, distance = rows[sort], found[sort], distance[sort]
        head = np.concatenate([[True], rows[1:] != rows[:-1]])
        rows, found, distance = rows[head], found[head], distance[head]
        better = (distance < best[rows]) | (distance == best[rows]) & (found < number[rows])
        best[rows[better]], number[rows[better]] = distance[better], found[better]
        at = end
    return number, best, compared


_PARTS = ("order", "centre", "radius", "first", "many", "low", "high")


def _blocks(kept: DataFrame, dim: int) -> DataFrame:
    """Rows of BLOCK vectors: ids, points and the packed cover tree over them."""
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                points = some.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                ids = some.column("id")
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                binary = [pa.array([p], pa.binary()) for p in (points.astype(np.int32).tobytes(), *cover_tree(points, LEAF).pack())]
                yield pa.RecordBatch.from_arrays([lists, *binary], names=["ids", "points", *_PARTS])

    return kept.mapInArrow(run, f"ids array<{kind}>, points binary, " + ", ".join(f"{p} binary" for p in _PARTS))


def _assigned(batches, dim: int, centroids: np.ndarray):
    """ids (an Arrow array), points, number and distance of every block."""
    centroid_tree = cover_tree(centroids, CENTROID_LEAF)
    for batch in batches:
        for row in range(batch.num_rows):
            points = np.frombuffer(batch.column("points")[row].as_py(), np.int32).astype(np.int64).reshape(-1, dim)
            tree = Tree.unpack([batch.column(p)[row].as_py() for p in _PARTS])
            ids = batch.column("ids")[row].values if "ids" in batch.schema.names else None
            yield ids, points, *nearest(points, tree, centroids, centroid_tree)[:2]


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), "q")
    return np.array([r.q for r in hashed.orderBy("h", "q").limit(k).collect()], np.int64)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dim = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, points, number, _ in _assigned(batches, dim, centroids):
            np.add.at(sums, number, points)
            counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = blocks.drop("ids").mapInArrow(run, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    after = centroids.copy()
    for row in total.collect():
        after[row.cluster] = [s // row.n for s in row.sums]
    return after


def lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", scale: int = 256, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    # Only rows that are kept are scaled.
    narrow = vectors.select(F.col(id_col).alias("id"), F.when(_kept(vector_col, dim), _as_integers(vector_col, scale)).alias("q")).where("q IS NOT NULL")
    centroids = first_centroids(narrow, k, seed)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks = cut(_blocks(narrow, dim))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def run(batches):
        for ids, _, number, distance in _assigned(batches, dim, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    near = cut(blocks.mapInArrow(run, f"id {kind}, cluster int, distance long"))
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    inertia = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    whole = sum(r.cluster_inertia for r in inertia)
    of_cluster = spark.createDataFrame([(r.cluster, r.cluster_inertia, whole, digests[r.cluster]) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(of_cluster), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
