"""Ranked references in several groups and parts, with copies, NULLs and vectors without a direction."""

import math
import random

from strandline.operators import align


def test_ranked_references(spark, monkeypatch):
    monkeypatch.setattr(align, "QUERIES", 7)  # there were no groups before
    monkeypatch.setattr(align, "REFERENCE_PARTS", 3)
    draw = random.Random(3)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(3)]) for i in range(400)] + [(900, None), (901, [0.0] * 3), (902, [1.0, None, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    queries = df.where("id % 20 = 0 OR id = 901")
    got = align.ranked_references(queries.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "v", 4)

    def cosine(x, y):
        if x is None or y is None or None in x + y or not any(x) or not any(y):
            return None
        return round(sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y)), 6)

    want = []
    for i, x in rows:
        if i % 20 == 0 or i == 901:
            near = sorted(((cosine(x, y), j) for j, y in rows if j != i), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))[:4]
            want += [(i, j, s, n + 1) for n, (s, j) in enumerate(near)]
    assert sorted(map(tuple, got.select("a", "b", "similarity", "rank").collect())) == sorted(want)
