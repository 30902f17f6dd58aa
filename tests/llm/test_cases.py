"""Linking of secrets, recall of license bands, kept rows and clashing names, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from strandline.llm import common, decontaminate, exact_dedup, licenses, quality, secrets, simhash

DOCS = "doc_id long, text string"


def brute_spans(text, scope=secrets.SCOPE):
    """All spans of one text, part by part."""
    found = []
    for number, (kind, pattern) in enumerate(zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.IDENT, secrets.OPAQUE, secrets.ENDPOINT), strict=True)):
        pattern = pattern.replace(r"\x20", " ")
        for m in re.finditer(pattern, text):
            if kind == "assign" and len(m[1]) < 8 or kind == "opaque" and not all(re.search(x, m[0]) for x in ("[A-Z]", "[a-z]", "[0-9]")):
                continue
            found.append((m.start(), number, m.end()))
    base = [x for x in found if x[1] < 3]
    parts = base + [x for x in found if x[1] > 2 and (x[1] == 5 or not any(b[0] < x[2] and x[0] < b[2] for b in base))]

    def near(x, kinds):
        return any(p[1] in kinds and abs(p[0] - x[0]) <= scope for p in parts)

    identifiers, secret = (1, 3), (0, 2, 4)
    added = [x for x in parts if x[1] == 3 and near(x, secret) or x[1] == 4 and near(x, identifiers) or x[1] == 5 and near(x, secret) and near(x, identifiers)]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + added))


def test_secret_linking(spark):
    draw = random.Random(4)
    pieces = ["user_id = bob17", "client-id: 'abc_9'", "password: hunter2hunter2", "token=short", "AKIA" + "ABCD" * 4, "0f" * 20, "aB3" * 20, "https://db.example.org/x", "s3://bucket.example.org/key", "login=" + "aB3x" * 12]
    texts = []
    for _ in range(300):
        gap = draw.choice([5, 60, 255, 256, 257, 600])
        texts.append("".join(f" {draw.choice(pieces)} {'é ' * draw.randrange(gap // 2 + 1)}" for _ in range(draw.randrange(9))))
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[7])]
    got = {(r.doc_id, r.spans) for r in secrets.secret_spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(i, brute_spans(t)) for i, t in rows}
    added = Counter(k for _, spans in got for k in re.findall("ident|opaque|endpoint", spans))
    assert min(added.values()) > 50 and len(added) == 3


def test_secret_spans_of_a_long_text(spark):
    """50,000 matches in one text: a list that is copied at each of them would take minutes."""
    text = " ".join(f"token = value{i:06d} {'ab' * (i % 3)}é" for i in range(50_000))
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], DOCS)).first()
    assert row.n_assign == 50_000 and row.spans == brute_spans(text)


def test_license_recall(spark):
    """Templates with words changed, cut into pieces and mixed: all with containment of 0.8 or more are found."""
    draw = random.Random(6)

    def shingles(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    rows = []
    for n in range(600):
        words = draw.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(draw.randrange(1 + len(words) // 25)):
            words[draw.randrange(len(words))] = "changed"
        at = draw.randrange(len(words))
        filler = [f"w{draw.randrange(500)}" for _ in range(draw.randrange(40))]
        rows.append((n, " ".join(filler + (words if n % 3 else words[at:] + filler + words[:at]) + filler)))
    want = set()
    for n, text in rows:
        held = shingles(text)
        want |= {(n, k) for k, t in licenses.TEMPLATES.items() if len(shingles(t) & held) >= 0.8 * len(shingles(t))}
    got = {(r.doc_id, k) for r in licenses.license_scan(spark.createDataFrame(rows, DOCS)).collect() for k in filter(None, r.licenses.split(","))}
    assert len(want) > 300 and got == want  # a recall of 1 here; above 0.9999 by the choice of bands


def test_short_texts_have_no_license(spark):
    templates = spark.createDataFrame([("a", "MIT License"), ("b", "under the MIT License here")], "template_id string, text string")
    got = licenses.license_scan(spark.createDataFrame([(1, "MIT license"), (2, "under the MIT License here now"), (3, None)], DOCS), templates)
    assert {r.doc_id: r.licenses for r in got.collect()} == {1: "", 2: "b", 3: ""}


def test_many_templates_go_in_blocks(spark):
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(9000)}" for _ in range(60)) for _ in range(300)]
    templates = spark.createDataFrame([(f"t{i:03d}", t) for i, t in enumerate(texts)], "template_id string, text string")
    docs = spark.createDataFrame([(i, f"so {t} it goes") for i, t in enumerate(texts) if i % 40 == 0] + [(-1, "nothing of the kind in this text")], DOCS)
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs, templates).collect()}
    assert got == {-1: ""} | {i: f"t{i:03d}" for i in range(0, 300, 40)}


@pytest.mark.parametrize("kind", ["string", "date"])
def test_exact_classes_of_other_ids(spark, kind):
    rows = [("2024-01-03", "a b"), ("2024-01-02", "ab"), (None, "a b"), ("2024-01-01", "c"), ("2024-01-01", "c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = Counter((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_classes(docs).collect())
    a, b, c = "2024-01-01", "2024-01-02", "2024-01-03"
    assert got == Counter([(c, c, 3, True), (b, c, 3, False), ("None", c, 3, False), (a, a, 2, True), (a, a, 2, False), ("None", "None", 1, True)])


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 0])
def test_rows_stay_by_row(spark, monkeypatch, most):
    """Null and repeated ids over different texts lose no row, whether dropped rows are broadcast or shuffled."""
    full = common.without_rows
    for module in (exact_dedup, simhash):
        monkeypatch.setattr(module, "without_rows", lambda docs, gone, row: full(docs, gone, row, most))
    one, two, three = "red fox runs over the hill", "green boats sail to far islands", "old clocks tick in empty halls"
    rows = [(None, one), (None, two), (None, two + " "), (5, one), (5, three), (7, three), (7, two), (8, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", __row int, __Row_ string")
    exact = exact_dedup.drop_copies(docs)
    assert exact.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == Counter([(5, one), (None, two + " "), (5, three), (8, None)])
    near = simhash.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter([(5, one), (7, two), (5, three), (8, None)])


def test_clashing_names_in_stages(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", "h", "i", 3, 0.5), (2, "one two three four", "h", "i", 3, 0.5)], DOCS + ", __hits string, __items string, __words int, __score double")
    benchmark = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 1):
        kept = decontaminate.drop_contaminated(docs, benchmark.union(spark.createDataFrame([(2, "zzz")], "item_id long, text string")), block_bytes=size)
        assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "one two three four", "h", "i", 3, 0.5)]
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = quality.drop_poor(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and sorted(r["__score"] for r in kept.collect()) == [0.5, 0.5]


def test_the_shared_folder_is_no_local_one(spark):
    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 0])
def test_bytes_are_compared_where_a_hash_repeats(spark, monkeypatch, most):
    """With a hash of one byte different texts collide; whether repeated hashes are broadcast or shuffled changes nothing."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
    draw = random.Random(9)
    rows = [(i, draw.choice(["", " ", "a", "b", "ab", " a b ", "abc", None, f"text {draw.randrange(40)}", f"own {i}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    weak = exact_dedup.exact_classes(docs, hash128=lambda text: F.substring(F.md5(text), 1, 1).cast("binary"))
    sizes = Counter(re.sub(r"[ \t\n\x0b\x0c\r]", "", t or "") for _, t in rows)
    for df in (weak, exact_dedup.exact_classes(docs)):
        got = {r.doc_id: r for r in df.collect()}
        assert len(got) == len(rows) and all(got[i].group_size == sizes[re.sub(r"[ \t\n\x0b\x0c\r]", "", t or "")] for i, t in rows)
        assert sum(r.kept for r in got.values()) == len(sizes)
