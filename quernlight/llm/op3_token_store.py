"""Token-ID output: whole documents as token ids in directly addressable files, in ascending id order.

write_store() deals the documents out by ranges of their id, so that shard after shard is in order; each task encodes
its documents once and packs them into containers (see dac.py), which Spark's committer writes as Parquet rows.
read_store() gives every document back with its place in the whole stream.

Nulls: a null text is an empty one; null ids come first. Ids are whole numbers or text that reads as such (other text is
an error of the cast). Repeated ids are kept, ordered by the first BEGINNING characters of their texts, then by the hash
of the whole; repeated rows each get a place, and may be dealt to several tasks. A very long text is encoded whole, and a
document longer than a container gets a container of its own. Empty tables give an empty store. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .common import WRITING, shared_path, small_batches, table

CONTAINER_IDS = 1 << 20
#: Characters of texts by which rows of one id are put in order.
BEGINNING = 64
#: Chunks longer than this are encoded without being remembered; at most MEMO chunks are remembered by a worker.
LONGEST, MEMO = 48, 600_000
#: Where no normal form and no lower case depends on what stands beside, a text is cut into letters that follow and
#: precede ASCII, digits, and marks between them; elsewhere, and otherwise, at white space only. The tokenizer's own
#: pattern (letters, single digits, runs of other marks, clitics after an apostrophe) cuts at all of these places.
_LETTERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_FINE = re.compile(rf"[{_LETTERS}]++(?![^\x00-\x7f])|[!-&(-/:-@\[-`{{-~]++(?=[ \t\n\r0-9{_LETTERS}]|\Z)|[0-9]|[^ \t\n\r]+")
_SINGLE = re.compile(rf"[{_LETTERS}]+|[!-&(-/:-@\[-`{{-~]+|[0-9]")
_COARSE = re.compile(r"[^ \t\n\r]+")


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte at byte level: itself where printable, else the next free one from U+0100."""
    free = iter(range(256, 512))
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Memo(dict):
    """Encodings of chunks that were seen, up to a bound."""

    def __init__(self, encode, most: int = MEMO):
        self.encode, self.most = encode, most

    def __missing__(self, chunk):
        found = self.encode(chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """text -> little-endian unsigned 32-bit ids, for the tokenizer file of lower-cased words that end in </w>."""
    from tokenizers import Tokenizer

    tokenizer, chars = Tokenizer.from_file(path), byte_characters()
    single, model = _SINGLE.fullmatch, tokenizer.model

    def encode(chunk: str) -> bytes:
        if single(chunk):  # normal, lower-case and one match of the pattern: the merges are all that is left to do
            ids = [t.id for t in model.tokenize(chunk if chunk.isascii() else "".join(chars[b] for b in chunk.encode()))]
        else:
            ids = tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    memo = Memo(encode)

    def whole(text: str) -> bytes:
        plain = text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u03a3" not in text)
        plain = plain and "<|" not in text
        return b"".join(map(memo.__getitem__, _FINE.findall(text.lower()) if plain else _COARSE.findall(text)))

    return whole


STORE = "shard int, seq int, base long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, container_ids: int = CONTAINER_IDS) -> None:
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        ids, texts, size, seq, base = [], [], 0, 0, 0
        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

        def container():
            blob = dac.pack(np.frombuffer(b"".join(texts), "<u4"))
            return pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "base": base, "n_ids": size, "doc_ids": ids, "lengths": [len(x) // 4 for x in texts], "payload": blob}], schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = encode(text.as_py()) + end
                ids.append(key)
                texts.append(coded)
                size += len(coded) // 4
                if size >= container_ids:
                    yield container()
                    base, seq = base + size, seq + 1
                    ids, texts, size = [], [], 0
        if ids:
            yield container()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one id may have any number of rows: they are dealt out by how their texts begin, by their texts' hash, and by a salt
    order = ["id", F.substring("text", 1, BEGINNING), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    dealt.mapInArrow(pack, STORE).write.options(**WRITING).parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids) of each document, from the files alone."""
    fields = [("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, base, keys, lengths = (batch.column(n)[row].as_py() for n in ("shard", "base", "doc_ids", "lengths"))
                ids = dac.Reader(batch.column("payload")[row].as_py())
                ends = np.cumsum(lengths)
                whole = ids.slice(0, len(ids)).astype("<u4", copy=False)
                parts = [whole[b - n : b] for b, n in zip(ends, lengths)]
                out = {"shard": [shard] * len(keys), "doc_id": keys, "start": base + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(x.tobytes()) for x in parts]}
                if with_ids:
                    out["ids"] = [x.astype(np.int32) for x in parts]
                yield pa.RecordBatch.from_pydict(out, schema)

    stored = spark.read.schema(STORE).parquet(path)
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = stored.mapInArrow(unpack, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return docs.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_token(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole stream, by random access: one container is fetched, no other is decoded."""
    stored = spark.read.schema(STORE).parquet(path)
    sizes = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ends = sizes.select("shard", "n", F.sum("n").over(Window.orderBy("shard")).alias("end"))
    shard = ends.filter(F.col("end") > position).orderBy("end").limit(1).collect()[0]
    inside = position - (shard["end"] - shard["n"])
    row = stored.filter((F.col("shard") == shard["shard"]) & (F.col("base") <= inside) & (F.col("base") + F.col("n_ids") > inside)).select("base", "payload").collect()[0]
    return dac.Reader(row["payload"])[inside - row["base"]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, path)
