"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a BPE model whose merges are, for each token by rank, all of its splits into two tokens; bytes
stand for characters by the byte-level table, as the library's ByteLevel step maps them. Text is first cut where the
pattern must cut too (before white space that follows other characters), so that cuts can be remembered; each match of
the pattern is encoded by itself. Decoding looks the tokens' characters up in the model's vocabulary and reverses the
byte table; characters split between tokens come out whole because bytes, not strings, are put together at the end.

Nulls: a null text is an empty one, a null id list decodes to nothing; empty texts give no ids. Ids of documents are
whole numbers or text that reads as such (other text is an error of the cast). Very long texts are encoded whole, very
long matches of the pattern aren't remembered. Repeated rows and ids (ties) stay as they are, each with its own row.
Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .op3_token_store import Memo, byte_characters

#: Unicode's White_Space characters, which the pattern's \s means.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters whose neighbours are letters too where they aren't ASCII, as far as the cuts below can tell.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Runs of letters, digits and marks (an apostrophe may begin a clitic, so not beside one), each with a blank before it;
#: whatever else stands between white space; and white space, less the last character before other text.
_CUT = rf" ?[{_LETTERS}]++(?![^\x00-\x7f])| ?[0-9]++(?![^\x00-\x7f])| ?[!-&(-/:-@\[-`{{-~]++(?=[ \t\n\r0-9A-Za-z]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes; one a worker and rank file."""

    def __init__(self, path: str, pattern: str):
        import re

        from tokenizers import models

        ranks, chars = read_ranks(path), byte_characters()
        named = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            parts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(named[a], named[b]) for a, b in sorted(parts, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
        self.model = models.BPE({named[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
        self.table = dict(enumerate(chars))
        self.back = {ord(c): b for b, c in enumerate(chars)}
        self.token = {r: named[t] for t, r in ranks.items()}
        self.cut, self.match = re.compile(_CUT).findall, regex.compile(pattern).findall
        self.memo = Memo(self._encode_cut)

    def _encode_cut(self, cut: str) -> bytes:
        ids = [t.id for piece in self.match(cut) for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.cut(text)))

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token, and the one after its last; tokens that split a character both cover it."""
        ends = np.cumsum([len(self.token[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return (char[starts], char[ends - 1] + 1) if len(ends) else (ends, ends)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the tokens' characters stand for."""
        return "".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).translate(self.back).encode("latin-1")

    def split_tokens(self, text: str, ids: bytes) -> int:
        """Tokens that begin inside a character."""
        if text.isascii():
            return 0
        starts = np.cumsum([0, *(len(self.token[i]) for i in np.frombuffer(ids, "<u4").tolist())][:-1], dtype=np.int64)
        return int(((np.frombuffer(text.encode(), np.uint8)[starts] & 0xC0) == 0x80).sum())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(df: DataFrame, each, schema: pa.Schema, ddl: str) -> DataFrame:
    """each: lists of values of the two columns -> columns of the result."""

    small_batches(df.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(each(part.column(0), part.column(1).to_pylist()), schema=schema)

    return df.mapInArrow(run, ddl)


def encode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """doc_id, token_ids (binary: little-endian unsigned 32-bit), and first and end character of each token if asked for."""
    lists = [pa.list_(pa.int64())] * 2 * with_offsets

    def each(keys, texts):
        c = codec(ranks_path, pattern)
        ids = [c.encode(t) for t in texts]
        spans = list(zip(*[c.offsets(t, i) for t, i in zip(texts, ids)]))[:2] if with_offsets else []
        return [keys, pa.array(ids, pa.binary()), *(pa.array([x.tolist() for x in s], k) for s, k in zip(spans, lists))]

    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.binary()), *zip(("first_char", "end_char"), lists)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _mapped(rows, each, schema, "doc_id long, token_ids binary" + ", first_char array<long>, end_char array<long>" * with_offsets)


def decode(coded: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, decoded (binary), and text: the bytes as UTF-8, with replacement characters where ids end inside one."""

    def each(keys, ids):
        raw = [codec(ranks_path, pattern).decode(i or b"") for i in ids]
        return [keys, pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw])]

    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary()), ("text", pa.string())])
    return _mapped(coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), each, schema, "doc_id long, decoded binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """encode() and decode() in one pass: number of ids, digests of the ids and of the bytes they decode to, and tokens that begin inside a character."""

    def each(keys, texts):
        c = codec(ranks_path, pattern)
        ids = [c.encode(t) for t in texts]
        return [keys, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids]), pa.array([c.split_tokens(t, i) for t, i in zip(texts, ids)], pa.int64()), *[pa.array(ids, pa.binary())] * with_ids]

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64()), *[("token_ids", pa.binary())] * with_ids])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _mapped(rows, each, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long" + ", token_ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
