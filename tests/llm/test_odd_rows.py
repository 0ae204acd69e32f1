"""Every operator over rows of nulls, repeats and clashing names, and over empty tables."""

import public_tokenizers as P
import pytest

from quernlight.llm import op1_token_counts, op2_url_filter, op3_token_store, op4_byte_bpe, op5_near_duplicates, op6_decontaminate, op7_toxicity, op8_quality_rules, op9_main_text, op10_license_scan
from quernlight.llm.common import shared_path

CLASHING = ["words", "row", "node", "raw", "seed", "pos", "bands", "size", "score", "hit", "key", "host", "path", "item", "text_", "leak_id", "labelled", "template", "blocks", "class"]


def store(docs, labels, benchmark):
    path = shared_path(docs.sparkSession, "odd")
    op3_token_store.write_store(docs, path, P.path("word_bpe_49k.json"))
    return op3_token_store.read_store(docs.sparkSession, path)


OPERATORS = {
    "op1": (lambda d, lab, b: op1_token_counts.token_counts(d, P.path("byte_bpe_50k.json")), 5),
    "op3": (store, 5),
    "op4": (lambda d, lab, b: op4_byte_bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken")), 5),
    "op4 encode, decode": (lambda d, lab, b: op4_byte_bpe.decode(op4_byte_bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), with_offsets=True), P.path("byte_bpe_multi_50k.tiktoken")), 5),
    "op5": (lambda d, lab, b: op5_near_duplicates.near_duplicates(d), 5),
    "op5 keep": (lambda d, lab, b: op5_near_duplicates.without_copies(d), 2),
    "op6": (lambda d, lab, b: op6_decontaminate.overlaps(d, b), 1),
    "op6 keep": (lambda d, lab, b: op6_decontaminate.without_overlaps(d, b), 3),
    "op7": (lambda d, lab, b: op7_toxicity.score(d, op7_toxicity.fit(d, lab)), 5),
    "op7 keep": (lambda d, lab, b: op7_toxicity.score(d, op7_toxicity.fit(d, lab), keep=True), 0),  # only label 1 is known
    "op8": (lambda d, lab, b: op8_quality_rules.rate(d, op8_quality_rules.fit(d, lab)), 5),
    "op8 keep": (lambda d, lab, b: op8_quality_rules.rate(d, op8_quality_rules.fit(d, lab), keep=True), 0),
    "op10": (lambda d, lab, b: op10_license_scan.scan(d), 5),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "few words"), (1, "few words")]
    docs = spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    labels = spark.createDataFrame([(None, None, None, "x"), (1, None, 1, "x"), (1, 0, None, "x"), (7, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    benchmark = spark.createDataFrame([(None, None, "x"), (1, None, "x"), (None, "few words", "x")], "item_id long, text string, words string")
    return docs, labels, benchmark


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_nulls_and_repeats(tables, name):
    operator, n = OPERATORS[name]
    assert operator(*tables).count() == n


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(tables, name):
    docs, labels, benchmark = tables
    made = OPERATORS[name][0](docs.limit(0), labels.limit(0), benchmark.limit(0))
    assert made.count() == 0 and (not name.endswith("keep") or made.columns == docs.columns)


def test_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (None, None, None, "x"), (1, "http://a.net/", None, None), (1, "http://a.net/", "<p>t", None)], "page_id long, url string, html string, key string")
    assert sorted(r["n_chars"] for r in op9_main_text.extract(pages).collect()) == [0, 0, 0, 1]
    assert [r["verdict"] for r in op2_url_filter.judge(pages).orderBy("page_id").collect()] == ["allow", "allow", "block", "block"]
