"""Personal data, centroid clustering and conversation repair against brute force, on odd rows and skewed tables."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import clusters, conversations, pii
from strandline.llm.common import table

SF = "/root/testdata/sf0.001"
EXTRA = ", id string, h int, q int, text_ string, conv string, range int, cluster string, piece int, n int, kind int, code int, points string"
CLASH = ("i", 1, 2, "x", "c", 3, "k", 4, 5, 6, 7, "p")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(df, want):
    """Rows as a multiset; the wanted columns come first."""
    assert Counter(tuple(r)[: len(want[0])] for r in df.collect()) == Counter(want)


# --- personal data ---


def loose(text):
    """The contract's rules by plain backtracking."""
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


PIECES = ["a.b@c.d", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (904) 555-6352", "+", "-", " ", "é", "٣", "12", "007", "_", "%", "\n", "\x00", "(5)", "aa@bb.c@dd.e", "0000000000000000"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(alphabet="a1@.+ -é", max_size=6), max_size=14).map("".join))
def test_base_spans_equal_the_rules(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == loose(text)


@pytest.fixture(scope="module")
def notes(spark):
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    rows = list(enumerate(texts)) + [
        (-1, None), (-2, ""), (-3, "x" * 3000), (-4, "1" * 3000), (-5, "a1@" * 1000), (-6, "+1 " * 1000), (-7, "call (904) 555-6352 now"), (-7, "call (904) 555-6352 now"),
        (None, "to joe@mail.example.com and 10.0.0.1"), (-8, "1.2.3.4" + ".5" * 800), (-9, "on 2024-05-06 at 12:30 for 1,234.50"), (-10, "two +1 (843) 555-7672 170.106.47.218"), (-11, "4845168114407329 4111111111111111"),
    ]
    return rows, spark.createDataFrame([(i, t, *CLASH) for i, t in rows], "doc_id long, text string" + EXTRA)


def test_op11(notes):
    rows, docs = notes
    got = pii.personal_spans(docs).collect()
    want = []
    for i, t in rows:
        base = loose(t or "")
        counts = Counter(k for k, _, _ in base)
        want.append((i, *(counts[k] for k in pii.KINDS), sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        base = [f"{k}:{s}:{e}" for k, s, e in loose(t or "")]
        listed = by_id[i].spans.split(",") if by_id[i].spans else []
        assert not Counter(base) - Counter(listed) and len(listed) == len(base) + by_id[i].n_added
        order = [(pii.KINDS.index(k), int(s)) for k, s, _ in (x.split(":") for x in listed)]
        assert order == sorted(order)
    assert by_id[-7].spans == "phone:5:19"  # no plus sign: only the field finds it
    assert by_id[-9].spans == ""
    assert "phone:4:21" in by_id[-10].spans and "ip:22:36" in by_id[-10].spans  # the rule takes both for one number of too many digits
    clean = [by_id[i] for i, t in rows if t and i is not None and i >= 0 and not re.search("[0-9@]", t)]
    assert clean and all(r.spans == "" for r in clean)


def test_very_long_texts_take_linear_time():
    """Plain backtracking would take hours on these."""
    for text in ("x" * 1_000_000, "1" * 1_000_000, "a1@" * 300_000, "+1 " * 300_000, "+1(" + "(" * 1_000_000, "1.2.3.4" + ".5" * 400_000):
        assert len(pii.base_spans(text)) < 300_000
        assert sum(1 for _ in pii.islands(text)) <= 300_000


def brute_segments(n, scored):
    """The best sum over all sets of spans that don't overlap."""

    def best(at):
        if at >= n:
            return 0.0
        return max([best(at + 1)] + [max(s) + best(j) for i, j, s in scored if i == at])

    return best(0)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(1, n), st.lists(st.floats(-3, 3), min_size=4, max_size=4)).filter(lambda x: x[0] < x[1]), max_size=12))))
def test_segments_are_the_best(case):
    n, scored = case
    chosen = pii.best_segments(n, scored)
    assert all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False))
    assert math.isclose(sum(x[3] for x in chosen), brute_segments(n, scored), abs_tol=1e-9)


def test_learning_raises_the_likelihood():
    """Gradients of the forward-backward sums: gold segments of the training islands are decoded after learning."""
    pieces = [f"+1 ({i}) 555-{1000 + i}" for i in range(200, 230)] + [f"joe.{i}@mail{i}.example.com" for i in range(30)] + [f"{i}-{i + 1}-77" for i in range(1000, 1030)]
    examples = pii.examples_of(pieces)
    field = pii.learn(examples)
    right = sum([(i, j, k) for i, j, k, _ in pii.best_segments(n, [(i, j, field.score(f)) for i, j, f in found])] == gold for n, found, gold in examples)
    assert right > 0.98 * len(examples)


# --- centroid clustering ---


def brute_lloyd(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept], np.int64)
    first = sorted(range(len(kept)), key=lambda j: (sha(f"2:{'' if kept[j][0] is None else kept[j][0]}"), kept[j][1]))[:k]
    centroids = points[first].copy()

    def assign():
        away = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
        return away.argmin(1), away.min(1)

    for _ in range(rounds):
        number, _ = assign()
        for j in set(number.tolist()):
            centroids[j] = points[number == j].sum(0) // (number == j).sum()
    number, away = assign()
    return [(i, int(c), int(d), int(away[number == c].sum()), int(away.sum()), sha(",".join(map(str, centroids[c].tolist())))) for (i, _), c, d in zip(kept, number, away, strict=True)]


def test_op12_on_the_table(spark):
    vectors = table(spark, SF, "embeddings")
    same(clusters.lloyd(vectors), brute_lloyd([(r.vec_id, r.embedding) for r in vectors.collect()]))


def test_op12_on_odd_rows(spark):
    """A third of the rows one vector, ties, repeated and null ids, and vectors that aren't kept."""
    draw = np.random.default_rng(1)
    centres = draw.integers(-400, 400, (30, 64)) / 100
    rows = [(i, [float(x) for x in centres[draw.integers(30)] + draw.normal(0, 0.05, 64)]) for i in range(1200)]
    rows += [(9000 + i, rows[5][1]) for i in range(600)]
    rows += [(None, rows[7][1]), (3, None), (4, [1.0] * 63), (5, [1.0] * 63 + [None]), (6, [math.nan] + [0.0] * 63), (7, [-math.inf] + [0.0] * 63), (8, [0.0] * 64), (8, [0.0] * 64), (9, [])]
    frame = spark.createDataFrame([(*r, *CLASH) for r in rows], "vec_id long, embedding array<double>" + EXTRA)
    same(clusters.lloyd(frame), brute_lloyd(rows))
    assert clusters.lloyd(frame.limit(0)).collect() == []
    few = frame.where("vec_id < 3 OR vec_id BETWEEN 5 AND 8")
    same(clusters.lloyd(few), brute_lloyd([r for r in rows if r[0] is not None and (r[0] < 3 or 5 <= r[0] <= 8)]))


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e12] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters.lloyd(frame).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 5), st.integers(0, 30), st.integers(0, 999))
def test_dual_trees_equal_all_pairs(n, k, dim, spread, seed):
    draw = np.random.default_rng(seed)
    points, centroids = draw.integers(-spread, spread + 1, (n, dim)), draw.integers(-spread, spread + 1, (k, dim))
    tree = clusters.cover_tree(points, 2)
    number, away, _ = clusters.nearest(points, tree, centroids, clusters.cover_tree(centroids, 1))
    every = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
    assert number.tolist() == every.argmin(1).tolist() and away.tolist() == every.min(1).tolist()
    # Cover tree: points lie within the radius of their node; children are apart by more than half the node's scale.
    for node in range(len(tree.centre)):
        own = points[tree.order[tree.low[node] : tree.high[node]]] - points[tree.centre[node]]
        assert (np.sqrt((own**2).sum(1)) <= tree.radius[node] + 1e-9).all()
        below = tree.centre[tree.first[node] : tree.first[node] + tree.many[node]]
        for a in range(len(below)):
            for b in range(a):
                assert ((points[below[a]] - points[below[b]]) ** 2).sum() * 16 > tree.radius[node] ** 2 or spread < 2


def test_trees_prune():
    draw = np.random.default_rng(2)
    centres = draw.integers(-1000, 1000, (40, 64))
    points = centres[draw.integers(0, 40, 1000)] + draw.integers(-20, 20, (1000, 64))
    compared = clusters.nearest(points, clusters.cover_tree(points, 8), centres, clusters.cover_tree(centres, 2))[2]
    assert compared < 1000 * 40 / 10


# --- conversation repair ---


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        d = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by keeping the best of every state; rows are (role, text, must go, truncated)."""
    after = {0: (2, "user:"), 1: (2, "user:"), 2: (3, "assistant:"), 3: (2, "user:")}
    now = {0: (0, "", ())}
    for role, text, must, cut in rows:
        new = {}
        for q, (cost, audit, lines) in now.items():
            for _ in range(4):
                wanted = 3 if q == 2 else 2
                options = [(q, cost + 3, "D", ())]
                if not must:
                    options.append((wanted, cost + 2 + cut, "R", (f"{'assistant' if q == 2 else 'user'}:{text}",)))
                    if role[:1] == ("a" if q == 2 else "u"):
                        options.append((wanted, cost + cut, "K", (f"{role}:{text}",)))
                    if role[:1] == "s" and q == 0:
                        options.append((1, cost + cut, "K", (f"{role}:{text}",)))
                for to, total, letter, line in options:
                    new[to] = min(new.get(to, (math.inf,)), (total, audit + letter, lines + line))
                q, line = after[q]
                cost, audit, lines = cost + 2, audit + "I", (*lines, line)
        now = new
    ends = []
    for q, (cost, audit, lines) in now.items():
        rest = {1: ("user:", "assistant:"), 2: ("assistant:",)}.get(q, ())
        ends.append((cost + 2 * len(rest), audit + "I" * len(rest), lines + rest))
    return min(ends)


def brute_repair(rows):
    out, kept = [], damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))
        seen, faults, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            again = (role, text) in seen
            cut = bool(body) and not again and body[-1] not in ".!?"
            blank, duplicate, truncated = blank + (not body), duplicate + (bool(body) and again), truncated + cut
            faults.append((role, text, not body or again, int(cut)))
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank, duplicate, truncated, illegal, cost, audit, sha("\n".join(lines))))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    """A conversation with most of the rows, one row many times over, ties in turns, nulls, and whole short conversations."""
    draw = random.Random(3)
    said = ["ok.", "no", "Yes!", "", "  ", "hm?\n", "x.", "y", None, "é. \x0b", "z" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(draw.choice([1, 2, 3, None, 50, 60] + [99] * 6), draw.choice([None, *range(60)]), draw.choice(roles), draw.choice(said)) for _ in range(900)]
    rows += [(99, i, draw.choice(roles[:3]), f"w{i}{draw.choice('.?x')}") for i in range(100, 700)]
    rows += [(1000 + i, j, ["system", "user", "assistant", "user", "assistant"][j], f"t{i}{j}.") for i in range(150) for j in range(5)]
    rows += [(5000, 1, "user", "same")] * 300
    return rows, spark.createDataFrame([(*r, *CLASH) for r in rows], "conv_id long, turn long, role string, text string" + EXTRA)


@pytest.mark.parametrize("ranges", [1, 9])
@pytest.mark.parametrize("limits", [{}, {"most_rows": 7}, {"most_chars": 50}])
def test_op13(spark, talks, ranges, limits):
    rows, frame = talks
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", ranges == 1)
        same(conversations.repair(frame, **limits), brute_repair(rows))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_op13_empty(spark, talks):
    assert conversations.repair(talks[1].limit(0)).collect() == []
    dropped = next(t for t in range(1000) if crc32(f"7:{t}".encode()) % 20 == 0)
    same(conversations.repair(spark.createDataFrame([(7, dropped, "user", "a.")], "conv_id long, turn long, role string, text string")), [(7, 0, 0, 0, 0, 0, 0, "", sha(""))])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "x"]), st.booleans(), st.integers(0, 1)), max_size=9))
def test_audits_are_the_least_of_the_cheapest(faults):
    rows = [(role, "t", must, 0 if must else cut) for role, must, cut in faults]
    codes = bytes({"system": 1, "user": 2, "assistant": 3, "x": 0}[r] + 4 * (3 if must else cut) for r, _, must, cut in rows)
    automaton = conversations.Automaton()
    states, cost = automaton.scan(codes, conversations._FINAL)
    labels, after = automaton.trace(codes, states, 0)
    end = after[-1] if after else 0
    assert (cost + automaton.vectors[states[0]][0], "".join(labels) + conversations._TAIL[end]) == cheapest(rows)[:2]
    assert len(automaton.vectors) < 60
