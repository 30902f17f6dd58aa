"""The language and quality models against plain loops over whole tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from strandline.llm import language, quality, queries
from strandline.llm.common import table

SF = "/root/testdata/sf0.001"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def plain_grams(text):
    """N-grams as tuples of code points, 0 for a blank."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    out = Counter()
    for word in words:
        c = [0, *map(ord, word), 0]
        out.update((x,) for x in c[1:-1])
        out.update(zip(c, c[1:]))
        out.update(zip(c, c[1:], c[2:]))
    return out


def plain_ranks(counts):
    """Falling count, then code: of equal counts three characters come first, then one, then two."""
    return sorted(counts, key=lambda g: (-counts[g], {3: 0, 1: 1, 2: 2}[len(g)], g))[: language.RANKED]


def test_language_equals_a_plain_profile_search(spark):
    docs = table(spark, SF, "documents").collect()
    counts = {}
    for d in docs:
        if d.lang is not None and fold(d.doc_id):
            counts.setdefault(d.lang, Counter()).update(plain_grams(d.text))
    profiles = {lang: {g: r for r, g in enumerate(plain_ranks(c))} for lang, c in sorted(counts.items())}
    got = {r.doc_id: r for r in queries.op6_language(spark, SF).collect()}
    assert len(got) == len(docs) and len(profiles) > 1
    for d in docs:
        own = plain_ranks(plain_grams(d.text))
        far = {lang: sum(abs(p[g] - r) if g in p else language.PROFILE for r, g in enumerate(own)) for lang, p in profiles.items()}
        best, second = sorted(far.values())[:2]
        want = (min(far, key=far.get), 1 - best / second if second else 0.0) if own else ("und", 0.0)
        found = got[d.doc_id]
        assert (found.held_out, found.lang_pred) == (fold(d.doc_id) == 0, want[0]) and found.score == pytest.approx(want[1])


def walked(trees, x):
    """The score of one row, tree by tree and node by node."""
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += value[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def test_quality_equals_a_plain_walk(spark):
    docs, labels = (table(spark, SF, n).collect() for n in ("documents", "labels"))
    label = {r.doc_id: r.quality for r in labels if r.quality is not None and fold(r.doc_id)}
    x = {d.doc_id: quality.features((d.text or "").encode()) for d in docs}
    known = sorted(i for i in x if i in label)
    assert len(known) < quality.MAX_ROWS
    trees = quality.fit(np.array([x[i] for i in known]), np.array([float(label[i] > 0) for i in known]))
    got = queries.op4_quality(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = walked(trees, x[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-9) and r.held_out == (fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3)


def test_first_split_is_the_best_of_all():
    draw = np.random.default_rng(5)
    x = draw.integers(0, 12, (300, 4)).astype(float)
    y = ((x[:, 2] > 6) ^ (draw.random(300) < 0.1)).astype(float)
    trees = quality.fit(x, y, trees=1, depth=1)
    p = (y.sum() + 1) / (len(y) + 2)
    best = None
    for j in range(4):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) * p * (1 - p) < 3:
                continue
            gain = sum((p - y[side]).sum() ** 2 / (side.sum() * p * (1 - p) + 1) for side in (left, ~left))
            if best is None or gain > best[0] + 1e-9:
                best = gain, j, left
    gain, j, left = best
    assert trees.feature[0, 0] == j and ((x[:, j] <= trees.threshold[0, 0]) == left).all()
    for value, side in zip(trees.value[0], (left, ~left), strict=True):
        assert value == pytest.approx(-quality.RATE * (p - y[side]).sum() / (side.sum() * p * (1 - p) + 1))
