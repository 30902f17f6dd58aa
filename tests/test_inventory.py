"""Archives, logs, pools and inventories: edge cases beside the registered queries."""

import io
import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as X
from strandline.operators import inventory as V
from strandline.operators import metrics as M
from strandline.operators import selection as Z
from strandline.sources import arrays, readers, writers


def save(folder, name, own=None, n=5, dtype="uint8"):
    np.savez_compressed(folder / f"{name}.npz", keys=np.arange(n * 2).reshape(n, 2).astype(dtype), frame=np.arange(n, dtype="int64"), session=np.array([own or name]))


ARRAYS = {"keys": (["uint8"], (None, 2)), "frame": (["int64"], (None,))}


def test_array_archives(spark, tmp_path):
    save(tmp_path, "a")
    save(tmp_path, "b", n=0)
    got = sorted(map(tuple, readers.array_archives(spark, str(tmp_path), "session", ARRAYS, rows=2).collect()))
    assert got == [("a", i, [2.0 * i, 2.0 * i + 1], [float(i)]) for i in range(5)]
    heads = {(r.path.rsplit("/", 1)[-1], r.array): (r.shape, r.dtype) for r in readers.array_headers(spark, str(tmp_path)).collect()}
    assert heads[("a.npz", "keys")] == ([5, 2], "|u1") and heads[("b.npz", "frame")] == ([0], "<i8") and len(heads) == 6


@pytest.mark.parametrize("wrong", [{"own": "other"}, {"dtype": "int16"}])
def test_array_archives_refuse(spark, tmp_path, wrong):
    save(tmp_path, "a", **wrong)
    with pytest.raises(Exception, match="isn't the file's name|keys is int16"):
        readers.array_archives(spark, str(tmp_path), "session", ARRAYS).collect()


def test_append_log_keeps_what_it_holds(spark, tmp_path):
    for i in range(2):
        writers.append_log(spark.range(i + 1), str(tmp_path / "log"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 0, 1]


def test_nearest_sum_equals_trying_all(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        pools = {g: [(f"{g}{i}", int(w) * 3) for i, w in enumerate(rng.integers(1, 12, 8))] for g in "xy"}
        target = {g: float(rng.integers(5, 90)) for g in pools}
        df = spark.createDataFrame([(g, i, w, target[g]) for g, items in pools.items() for i, w in items], "g string, id string, w long, t double")
        got = {}
        for r in Z.nearest_sum(df, ["g"], "id", "w", "t", "s").collect():
            got.setdefault(r.g, []).append(r.id)
        for g, items in pools.items():
            best = min(abs(sum(w for _, w in c) - target[g]) for k in range(9) for c in itertools.combinations(items, k))
            weights = dict(items)
            assert abs(sum(weights[i] for i in got.get(g, [])) - target[g]) == best


def test_too_many_retries_raise(spark):
    df = spark.createDataFrame([("p", i, 1, i) for i in range(3)], "p string, id long, w long, again long")
    with pytest.raises(Exception, match="more retries than shards"):
        Z.balanced(df, ["p"], "id", "w", 2, retry="again").collect()
    got = {r.id: r.shard for r in Z.balanced(df, ["p"], "id", "w", 3, retry="again").collect()}
    assert sorted(got.values()) == [0, 1, 2]


def test_tier_of_unknown_key_raises(spark):
    rows, tiers = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string"), spark.createDataFrame([("a", "small")], "k string, tier string")
    with pytest.raises(Exception, match="no tier for b"):
        V.tier_inventories(rows, tiers, ["k"], "tier").collect()


def test_effective_rank_of_flat_and_round_vectors(spark):
    flat = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    line = spark.createDataFrame([([float(i), 2.0 * i],) for i in range(5)], "v array<double>")
    both = spark.createDataFrame([([1.0, 0.0],), ([-1.0, 0.0],), ([0.0, 1.0],), ([0.0, -1.0],)], "v array<double>")
    assert [round(M.effective_rank(d, "v").first().rank, 9) for d in (flat, line, both)] == [0.0, 1.0, 2.0]


def test_splitmix64_at_the_ends(spark):
    def plain(x):
        z = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    ends = [0, 1, -1, 2**63 - 1, -(2**63), 0x0123456789ABCDEF]
    got = spark.createDataFrame([(x,) for x in ends], "x long").select("x", X.splitmix64(F.col("x")).alias("y")).collect()
    assert all(r.y % 2**64 == plain(r.x % 2**64) for r in got)


def all_types(path, n, saver=np.savez, start=0):
    at = np.arange(start, start + n)
    saver(
        path, frames=(at[:, None, None] + np.arange(6).reshape(2, 3)).astype(np.uint8), index=at + (1 << 60), keys=(at[:, None] + np.arange(4)) % 2 == 0, half=at.astype(np.float16), big=at.astype(np.uint64) + np.uint64(1 << 63),
        name=np.array([f"n{i}" for i in at], dtype="U12"), columnar=np.asfortranarray(np.stack([at, -at], 1).astype(np.int16)), session=np.array(path.stem), rate=np.array(59.5),
    )


@pytest.mark.parametrize("saver", [np.savez, np.savez_compressed])
def test_array_rows_keep_types_and_shapes(spark, tmp_path, saver):
    all_types(tmp_path / "a.npz", 50, saver)
    all_types(tmp_path / "b.npz", 0, saver)
    all_types(tmp_path / "c.npz", 7, saver, 50)
    df = readers.array_rows(spark, str(tmp_path), partition_bytes=900)
    assert dict(df.dtypes) == {
        "file": "string", "row": "bigint", "frames": "array<array<smallint>>", "index": "bigint", "keys": "array<boolean>", "half": "float", "big": "decimal(20,0)", "name": "string", "columnar": "array<smallint>", "session": "string", "rate": "double",
    }
    assert df.rdd.getNumPartitions() > 3
    got = sorted(df.collect(), key=lambda r: r["index"])
    assert [r.row for r in got] == [*range(50), *range(7)]
    for i, r in enumerate(got):
        assert r.frames == [[i, i + 1, i + 2], [i + 3, i + 4, i + 5]] and r["index"] == i + (1 << 60) and r.keys == [(i + j) % 2 == 0 for j in range(4)]
        assert (r.half, int(r.big), r.name, r.columnar, r.session, r.rate) == (i, i + (1 << 63), f"n{i}", [i, -i], "a" if i < 50 else "c", 59.5)
    raw = readers.array_rows(spark, str(tmp_path), "row long, frames binary").where("row = 6").collect()
    assert sorted(bytes(r.frames) for r in raw) == sorted(bytes((i + j) % 256 for j in range(6)) for i in (6, 56))


def test_array_rows_choose_files(spark, tmp_path):
    """Files of other names aren't opened (one is broken), and filters on one DataFrame don't stick to it."""
    for name in "ac":
        all_types(tmp_path / f"{name}.npz", 5)
    (tmp_path / "b.npz").write_bytes(b"no archive")
    df = readers.array_rows(spark, str(tmp_path), "file string, row long, index long", names="[ac].npz")
    assert [df.where(F.col("file") == str(tmp_path / "a.npz")).count(), df.count(), df.where(F.col("file").endswith("c.npz")).count()] == [5, 10, 5]
    with pytest.raises(Exception, match="zip"):
        readers.array_rows(spark, str(tmp_path), "file string, row long, index long").count()


@pytest.mark.parametrize("schema, match", [("row long, index int", "index is bigint instead of int"), ("row long, other long", "missing arrays"), ("row long, frames array<array<int>>", "instead of")])
def test_array_rows_refuse(spark, tmp_path, schema, match):
    all_types(tmp_path / "a.npz", 5)
    with pytest.raises(Exception, match=match):
        readers.array_rows(spark, str(tmp_path), schema).collect()


def test_headers_read_a_small_part_of_a_file(tmp_path):
    """Under 1 % of the bytes of a large archive are read for its headers, and a row range reads little more than itself."""
    np.savez(tmp_path / "a.npz", big=np.zeros((2000, 1000)), small=np.arange(2000))

    class Counted(io.FileIO):
        seen = 0

        def readinto(self, buffer):
            got = super().readinto(buffer)
            Counted.seen += got
            return got

        def read(self, size=-1):
            out = super().read(size)
            Counted.seen += len(out)
            return out

    size = (tmp_path / "a.npz").stat().st_size
    with Counted(tmp_path / "a.npz") as file, zipfile.ZipFile(file) as archive:
        found = arrays.members(archive)
        assert [(m.name, m.shape, m.dtype.str) for m in found] == [("big", (2000, 1000), "<f8"), ("small", (2000,), "<i8")]
        assert Counted.seen < size / 100
        Counted.seen = 0
        assert arrays._rows(archive, found[0], 500, 510).shape == (10, 1000)
        assert Counted.seen < 2 * 80_000


def test_archives_round_trip(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 3).cast("string").alias("part"), "id", F.array("id", F.col("id") * 2).alias("v"), (F.col("id") / 2).alias("x"))
    assert writers.write_archives(df, str(tmp_path / "out"), "part", "id", ["v", "x"]) == 3
    back = readers.array_rows(spark, str(tmp_path / "out"), ident="session")
    assert sorted(tuple(r) for r in back.select(F.regexp_extract("file", "([^/]+).npz", 1).alias("part"), "id", "v", "x").collect()) == sorted(tuple(r) for r in df.collect())
