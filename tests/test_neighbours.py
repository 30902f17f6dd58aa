"""Nearest neighbours in pruned blocks against all pairs."""

import numpy as np
import pytest

from strandline.operators import neighbours

SCHEMA = "id long, v array<double>"


def brute(rows):
    kept = [(i, np.array(v, float)) for i, v in rows if v is not None and any(v)]
    ids, unit = np.array([i for i, _ in kept]), np.array([v / np.sqrt((v * v).sum()) for _, v in kept])
    similar = np.round(unit @ unit.T, 9)
    similar[ids[:, None] == ids[None, :]] = -2
    return {int(i): (int(ids[row == row.max()].min()), row.max()) for i, row in zip(ids, similar, strict=True)}


@pytest.mark.parametrize("shape", ["clusters", "random", "copies"])
def test_neighbours(spark, shape):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (12, 8))
    made = {"clusters": centres[draw.integers(0, 12, 900)] + draw.normal(0, 0.02, (900, 8)), "random": draw.normal(0, 1, (300, 8)), "copies": np.repeat(centres[:4], 60, axis=0)}[shape]
    rows = [(i * 3, [float(x) for x in v]) for i, v in enumerate(made)] + [(-1, None), (-2, [0.0] * 8)]
    got = {r.id: r for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(6), "id", "v", block=40).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (other, similarity) in want.items():
        assert abs(got[i].similarity - similarity) < 1e-8
        if shape != "copies":  # equal vectors differ in the last digit by how their products are summed
            assert got[i].neighbour == other
    compared = sum(r.compared for r in got.values())
    assert compared <= len(want) ** 2 and (shape != "clusters" or compared < len(want) ** 2 / 4)
    whole = neighbours.neighbour_uniqueness(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "v", block=40)).first()
    assert whole.n == len(want) and (shape == "copies" or abs(whole.unique - len({o for o, _ in want.values()}) / len(want)) < 1e-9)


def test_few_rows(spark):
    assert neighbours.nearest_neighbours(spark.createDataFrame([], SCHEMA), "id", "v").collect() == []
    assert neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), "id", "v").collect() == []
    got = neighbours.nearest_neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], SCHEMA), "id", "v").collect()
    assert {(r.id, r.neighbour) for r in got} == {(1, 2), (2, 1)}


def test_groups_bound_what_is_shuffled(spark, monkeypatch):
    """More blocks than groups may hold; and each vector moves for every group and part at most, not for every pair of blocks."""
    monkeypatch.setattr(neighbours, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(neighbours, "GROUPS", 4)
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(draw.normal(0, 1, (600, 8)))]
    df = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "v", block=10)
    assert {r.id: r.neighbour for r in df.collect()} == {i: other for i, (other, _) in brute(rows).items()}
    monkeypatch.setattr(neighbours, "GROUP_BLOCKS", 128)
    path = "Exchange hashpartitioning(group"
    df = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", "v", block=10)
    assert df.count() == 600 and path in df._jdf.queryExecution().executedPlan().toString()
