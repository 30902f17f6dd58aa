"""Many small archives: few tasks, and the same checks and rows as for large ones."""

import numpy as np
import pytest

from strandline.sources import arrays, readers


def test_small_archives_share_tasks(spark, tmp_path):
    for n in range(300):
        np.savez(tmp_path / f"s{n}.npz", session=np.array(f"s{n}"), k=np.arange(n % 5) + n)
    np.savez(tmp_path / "t.npz", session=np.array("t"), k=np.arange(200_000))
    df = readers.array_rows(spark, str(tmp_path), ident="session", partition_bytes=800_000)
    assert df.rdd.getNumPartitions() < 160  # one a file before
    got = {}
    for r in df.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.k))
    assert sorted(got["t.npz"]) == [(i, i) for i in range(200_000)]
    assert {f: v for f, v in got.items() if f != "t.npz"} == {f"s{n}.npz": [(i, n + i) for i in range(n % 5)] for n in range(300) if n % 5}
    heads = readers.array_headers(spark, str(tmp_path))
    assert heads.rdd.getNumPartitions() <= 3 and heads.count() == 602
    np.savez(tmp_path / "u.npz", session=np.array("v"), k=np.arange(3))
    with pytest.raises(Exception, match="isn't the file's name"):
        readers.array_rows(spark, str(tmp_path), ident="session").collect()


def test_packs():
    packs = list(arrays.packed([(str(n), 100) for n in range(1000)], arrays.PARTITION_BYTES))
    assert sum(packs, []) == [str(n) for n in range(1000)] and 8 <= len(packs) < 12
    assert list(arrays.packed([("a", 1 << 30), ("b", 1)], 5)) == [["a"], ["b"]] and list(arrays.packed([], 5)) == []
