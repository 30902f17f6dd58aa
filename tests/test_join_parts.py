"""The parts of a join grow with its rows."""

from strandline.plans import QUERIES, alignment

SF = "/root/testdata/sf0.001"


def test_join_in_more_parts(spark, monkeypatch):
    want = sorted(map(tuple, QUERIES["d01_equi_join"](spark, SF).collect()))
    monkeypatch.setattr(alignment, "TASK_ROWS", 500)
    got = QUERIES["d01_equi_join"](spark, SF)
    assert "hashpartitioning(o_orderkey" in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() >= 12  # 4, or one, before
    assert sorted(map(tuple, got.collect())) == want
