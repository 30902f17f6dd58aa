"""Running totals over ranges, and what is built on them, against plain loops."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics as M
from strandline.operators import ranges
from strandline.operators.ranges import running_totals, tiles


@pytest.fixture(autouse=True, params=[0, ranges.FEW_ROWS], ids=["ranges", "whole"])
def few(request, monkeypatch):
    """Every test by ranges, and by a whole window as small tables get it."""
    monkeypatch.setattr(ranges, "FEW_ROWS", request.param)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    scores = [None, *[i / 8 for i in range(8)]]
    # Half of the rows are one score of one group; null groups and scores occur.
    return [("a", 0.5, i, i % 3) for i in range(600)] + [(draw.choice(["a", "b", None]), draw.choice(scores) if draw.random() < 0.7 else draw.random(), 600 + i, i % 5) for i in range(600)]


SCHEMA = "g string, p double, i long, n long"


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("parts", [16, 64])
def test_totals_equal_a_plain_scan(spark, rows, down, parts):
    found = running_totals(spark.createDataFrame(rows, SCHEMA), ["g"], "p", {"r": F.lit(1), "s": F.col("n")}, ties="i", down=down, parts=parts)
    got = {r["i"]: (r["r"], r["s"], r["r_all"], r["s_all"]) for r in found.collect()}
    want = {}
    for group in ("a", "b", None):
        own = [r for r in rows if r[0] == group]
        own.sort(key=(lambda r: (r[1] is None, -(r[1] or 0), r[2])) if down else (lambda r: (r[1] is not None, r[1] or 0, r[2])))
        sums = list(accumulate(r[3] for r in own))
        want |= {r[2]: (k + 1, sums[k], len(own), sums[-1]) for k, r in enumerate(own)}
    assert got == want


def test_one_score_of_a_whole_group(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.lit(0.5).alias("p"), F.col("id").alias("i"))
    found = running_totals(df, ["g"], "p", {"r": F.lit(1)}, ties="i")
    assert [r["r"] for r in found.orderBy("i").collect()] == list(range(1, 1001))


def test_no_rows_and_no_groups(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 2), (2.0, 3)], "p double, i long")
    assert [r["r"] for r in running_totals(df, [], "p", {"r": F.col("i")}).orderBy("p").collect()] == [1, 4, 6]
    assert running_totals(df.limit(0), [], "p", {"r": F.lit(1)}, ties="i").count() == 0


@pytest.mark.parametrize("n", [1, 3, 7, 8, 9, 30])
def test_tiles_are_those_of_ntile(spark, n):
    df = spark.range(1, n + 1).select("id", tiles(F.col("id"), F.lit(n), 8).alias("t"))
    size, longer = divmod(n, 8)
    want = [t for t in range(1, 9) for _ in range(size + (t <= longer))]
    assert [r["t"] for r in df.orderBy("id").collect()] == want


def test_auc_counts_pairs(spark):
    draw = random.Random(3)
    data = [("a", draw.random() < 0.4, draw.randrange(6) / 5, i) for i in range(200)]
    got = M.rank_auc(spark.createDataFrame(data, "g string, y boolean, p double, i long"), ["g"], "y", "p", "i").first()["auc"]
    pos, neg = [r[2] for r in data if r[1]], [r[2] for r in data if not r[1]]
    # Of a tie the positives have the lower ranks, so an equal negative isn't below.
    assert got == pytest.approx(sum(a > b for a in pos for b in neg) / (len(pos) * len(neg)))


def test_many_small_groups_need_no_ranges(spark, monkeypatch):
    """More rows than FEW_ROWS in all, but in no group: windows, nothing written."""
    monkeypatch.setattr(ranges, "FEW_ROWS", 50)

    def written(df):
        raise AssertionError("written")

    df = spark.range(1000).selectExpr("id % 40 AS g", "id DIV 40 AS p")
    monkeypatch.setattr(ranges, "cut", written)
    got = running_totals(df, ["g"], "p", {"r": F.lit(1)}).collect()
    assert len(got) == 1000 and all((r["r"], r["r_all"]) == (r["p"] + 1, 25) for r in got)
    monkeypatch.setattr(ranges, "FEW_ROWS", 24)
    with pytest.raises(AssertionError, match="written"):
        running_totals(df, ["g"], "p", {"r": F.lit(1)})
