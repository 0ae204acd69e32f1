import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_documents import brute_classes, brute_overlaps

from quernlight.llm import op4_byte_bpe, op7_toxicity, op8_quality_rules

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages_hand_documents_on(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and (docs.columns == columns or k == 4)
        ids = now
    assert {r[0] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids


def test_stages_keep_what_the_operators_say(spark, tmp_path):
    """Each stage over what its predecessor kept, against the operator's own verdicts on those rows."""
    labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))

    def toxic(docs):
        return {r["doc_id"] for r in op7_toxicity.score(docs, op7_toxicity.fit(docs, labels)).collect() if not r["predicted"]}

    def good(docs):
        return {r["doc_id"] for r in op8_quality_rules.rate(docs, op8_quality_rules.fit(docs, labels)).collect() if r["kept"]}

    def first_of_class(docs):
        rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        return {rows[c][0] for c in brute_classes([t for _, t in rows])}

    def clean(docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        leaks = brute_overlaps([t for _, t in rows], [(r["item_id"], r["text"]) for r in benchmark.collect()])
        return {i for i, _ in rows} - {rows[k][0] for k, _ in leaks}

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, ((_, stage), kept) in enumerate(zip(corpus_pipeline.STAGES, (toxic, good, first_of_class, clean))):
        texts, expected = {r["doc_id"]: r["text"] for r in docs.collect()}, kept(docs)
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == {i: texts[i] for i in expected}
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op4_byte_bpe.read_ranks(ranks), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist() for r in rows} == {i: whole.encode_ordinary(t) for i, t in texts.items()}


def test_stages_over_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 20_000, "en", "s", 1), (2, "word " * 20_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, DATA).count() <= 4
