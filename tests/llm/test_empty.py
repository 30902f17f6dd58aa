"""Empty tables, and documents without any text, pass through every operator with their stated result."""

import public_tokenizers
import pytest

from strandline.llm import bpe, decontaminate, exact_dedup, html_main, language, licenses, lm, pii, quality, queries, secrets, simhash
from strandline.llm.common import table

SF = "/root/testdata/sf0.001"

OPERATORS = {
    "op1": lambda docs, bench, labels: decontaminate.contamination(docs, bench),
    "op2": lambda docs, bench, labels: licenses.license_scan(docs),
    "op3": lambda docs, bench, labels: simhash.near_duplicates(docs),
    "op4": lambda docs, bench, labels: quality.scores(docs, labels),
    "op5": lambda docs, bench, labels: secrets.secret_spans(docs),
    "op6": lambda docs, bench, labels: language.predict(docs),
    "op7": lambda docs, bench, labels: bpe.round_trip(docs, queries.BPE_PATH, public_tokenizers.PATTERN),
    "op8": lambda docs, bench, labels: lm.lm_scores(docs),
    "op9": lambda docs, bench, labels: exact_dedup.exact_classes(docs),
    "op11": lambda docs, bench, labels: pii.personal_spans(docs),
}


@pytest.fixture(scope="module")
def tables(spark):
    return [table(spark, SF, name) for name in ("documents", "benchmark", "labels")]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(tables, name):
    docs, bench, labels = tables
    assert OPERATORS[name](docs.limit(0), bench, labels).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_only_null_texts(spark, tables, name):
    docs = spark.createDataFrame([(i, None, None, None, None) for i in range(1, 8)], tables[0].schema)
    got = OPERATORS[name](docs, *tables[1:]).collect()
    assert sorted(r.doc_id for r in got) == list(range(1, 8))
    want = {"op1": {"n_words": 0, "contaminated": False}, "op2": {"n_licenses": 0}, "op3": {"fingerprint": "0" * 16, "component_id": 1}, "op4": {}, "op5": {"spans": ""}, "op6": {"lang_pred": "und"}, "op7": {"n_tokens": 0}, "op8": {"n_tokens": 1}, "op9": {"keep_id": 1, "group_size": 7}, "op11": {"spans": "", "n_email": 0, "n_added": 0}}[name]
    assert all(r[k] == v for r in got for k, v in want.items())
    if name == "op4":
        assert len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1


def test_nothing_to_learn_or_to_find(tables):
    docs, bench, labels = tables
    n = docs.count()
    assert [tuple(r) for r in quality.scores(docs, labels.limit(0)).groupBy("held_out").count().groupBy().sum("count").collect()] == [(n,)]
    assert decontaminate.contamination(docs, bench.limit(0)).where("NOT contaminated AND n_hit = 0").count() == n
    assert licenses.license_scan(docs, licenses.default_templates(docs.sparkSession).limit(0)).where("n_licenses = 0").count() == n


def test_no_pages(spark):
    assert html_main.main_text(table(spark, SF, "pages").limit(0)).collect() == []
