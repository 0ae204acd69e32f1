"""Queries that SQL can express against DuckDB, and the others against the libraries, on the smallest tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from test_documents import brute_classes, brute_counts
from tokenizers import Tokenizer

from quernlight.llm import op4_byte_bpe
from quernlight.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df, relation = QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name])
    assert df.columns == relation.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, relation.fetchall()))


def test_token_store(spark, texts):
    whole, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    rows = {r["doc_id"]: r for r in QUERIES["op3_token_store"](spark, DATA).collect()}
    assert rows.keys() == texts.keys()
    for key, text in texts.items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(rows[key]) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_byte_bpe(spark, texts):
    ranks = op4_byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op4_byte_bpe"](spark, DATA).collect():
        ids = np.array(whole.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_near_duplicates(spark, texts):
    rows = dict(map(tuple, QUERIES["op5_near_duplicates"](spark, DATA).collect()))
    keys = list(texts)
    assert rows == {k: keys[c] for k, c in zip(keys, brute_classes(list(texts.values())))}


def test_rule_counts(spark, texts):
    for r in QUERIES["op8_quality_rules"](spark, DATA).collect():
        n, *rest = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest)
        assert r["base_failed"] == (n < 20 or 100 * rest[3] > 30 * n) and not (r["base_failed"] and r["kept"])
