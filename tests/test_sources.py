"""Readers and writers on files of their own: what they take, refuse and leave behind."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators import checks
from strandline.sources import readers, writers


def schema(text):
    return StructType.fromDDL(text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filter_reaches_the_scan(spark):
    df = readers.columns_where(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_returnflag") == "R")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_versioned_csv(spark, tmp_path):
    versions = [schema("t bigint, a boolean"), schema("t bigint, a boolean, death boolean")]
    (tmp_path / "old.csv").write_text("t,a\n1,true\n2,false\n")
    (tmp_path / "new.csv").write_text("t,a,death\n1,true,true\n")
    (tmp_path / "bad.csv").write_text("t,b\n1,true\n")
    fills = {"death": F.lit(False)}
    assert rows(readers.versioned_csv(spark, str(tmp_path / "old.csv"), versions, fills)) == [(1, True, False), (2, False, False)]
    assert rows(readers.versioned_csv(spark, str(tmp_path / "new.csv"), versions, fills)) == [(1, True, True)]
    with pytest.raises(ValueError):
        readers.versioned_csv(spark, str(tmp_path / "bad.csv"), versions, fills)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b"}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 1}\n')
    (tmp_path / "c.jsonl").write_text('{"id": "a", "n"\n')
    s = schema("id string, n bigint")
    assert sorted(readers.json_lines(spark, str(tmp_path / "a.jsonl"), s, ["id"]).collect(), key=str) == [("a", 1), ("b", None)]
    for name in "bc":
        with pytest.raises(Exception):
            readers.json_lines(spark, str(tmp_path / f"{name}.jsonl"), s, ["id"]).collect()


def test_id_list(spark, tmp_path):
    for name, text in (("a", "x\n y \n"), ("b", "x\nx\n"), ("c", "x\n\ny\n")):
        (tmp_path / name).write_text(text)
    assert rows(readers.id_list(spark, str(tmp_path / "a"))) == [("x",), ("y",)]
    for name in "bc":
        with pytest.raises(Exception):
            readers.id_list(spark, str(tmp_path / name)).collect()


def test_json_tree(spark, tmp_path):
    for shard, video, chunk in (("S0", "v", "0"), ("S0", "v", "1"), ("S1", "w", "0")):
        folder = tmp_path / shard / video / chunk
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text('{\n"game": "g"\n}')
        (folder / "other.json").write_text("{}")
    tree = readers.json_tree(spark, str(tmp_path), schema("game string"), "metadata.json", ["video", "chunk"])
    assert rows(tree) == [("v", "0", "g"), ("v", "1", "g"), ("w", "0", "g")]
    assert rows(readers.first_of_group(tree, ["video"], ["chunk"]).select("video", "chunk", "rows")) == [("v", "0", 2), ("w", "0", 1)]


def test_publish(spark, tmp_path):
    s = schema("n int not null, t string")
    path = str(tmp_path / "out")
    writers.publish(spark.createDataFrame([("x", 1, 0)], "t string, n bigint, more int"), path, s)
    assert not checks.schema_problems(spark.read.parquet(path).schema, s)
    with pytest.raises(Exception):
        writers.publish(spark.createDataFrame([("y", 2)], "t string, n bigint"), path, s)
    assert rows(spark.read.parquet(path)) == [(1, "x")]
    with pytest.raises(Exception):
        writers.publish(spark.createDataFrame([("y", None)], "t string, n bigint"), str(tmp_path / "null"), s)


def test_publish_all(spark, tmp_path):
    s, path = schema("n bigint"), str(tmp_path / "set")
    assert not writers.is_complete(spark, path)
    assert rows(writers.publish_all({"a": (spark.range(3).toDF("n"), s), "b": (spark.range(0).toDF("n"), s)}, path)) == [("a", 3), ("b", 0)]
    assert writers.is_complete(spark, path)


def test_inventory(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    (tmp_path / "f" / "b.bin").write_bytes(b"d")
    (tmp_path / "f" / "empty.bin").write_bytes(b"")
    found = readers.file_inventory(spark, str(tmp_path / "f"))
    listed = found.where("path = 'a.bin'").withColumn("sha256", F.lit("0"))
    assert rows(checks.inventory(found, listed)) == [("a.bin", "content"), ("b.bin", "unexpected")]


def test_schema_problems():
    want = schema("a int, b string")
    assert checks.schema_problems(schema("a int, b string"), want) == []
    assert checks.schema_problems(schema("b string, a int"), want) == ["columns in another order"]
    assert checks.schema_problems(schema("a bigint, c int"), want) == ["b: missing", "c: not expected", "a: bigint instead of int"]
