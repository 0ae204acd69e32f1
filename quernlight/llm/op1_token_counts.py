"""Token counts by offset-mapped attribution.

A document's fields are joined to one whole text, which is encoded once; the character spans of its tokens are then
interval-joined (by binary search, both sides being in order) to the spans of its sections: its fields, or their lines.
A separator or line break belongs to the section before it. A token whose characters lie in more than one section is
counted by an explicit rule: "first" gives it to the section of its first character, "most" to the section with most of
its characters (the earlier of equals), "share" divides it by characters. Sections' counts add up to the whole text's.

Nulls: a null field is an empty one. Empty texts have one empty section for each field, without tokens. Very long texts
are encoded whole. Repeated rows and ids each get their sections. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .op3_token_store import Memo, byte_characters
from .op4_byte_bpe import _CUT

#: ASCII that the pattern matches as one.
_SINGLE = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+")
RULES, JOINER, MOST_REMEMBERED = ("first", "most", "share"), "\n\n", 250_000


@lru_cache(maxsize=2)
def span_encoder(path: str):
    """text -> first and end character of each token; for tokenizers that split as the byte-level pattern does."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    model, table, single = tokenizer.model, dict(enumerate(byte_characters())), _SINGLE.fullmatch

    def encode(cut: str) -> tuple[int, int, bytes, bytes]:
        if single(cut):  # one match of the pattern, a byte a character: the merges are all that is left to do
            ends = list(accumulate(len(t.value) for t in model.tokenize(cut.translate(table))))
            spans = list(zip([0, *ends], ends))
        else:
            spans = tokenizer.encode(cut, add_special_tokens=False).offsets
        n = len(spans)
        return n, len(cut), struct.pack(f"<{n}I", *(a for a, _ in spans)), struct.pack(f"<{n}I", *(b for _, b in spans))

    memo, cuts_of = Memo(encode, MOST_REMEMBERED), re.compile(_CUT).findall

    def whole(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(memo.__getitem__, cuts_of(text)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts, lengths, first, end = zip(*found)
        at = np.cumsum(lengths) - lengths
        shift = np.repeat(at, counts)
        return np.frombuffer(b"".join(first), "<u4") + shift, np.frombuffer(b"".join(end), "<u4") + shift

    return whole


def sections_of(fields: list[str], by_line: bool, joiner: str = JOINER) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The whole text, and of each section its field, first and end character; the ends include line breaks and joiners."""
    starts, owners, at = [], [], 0
    for k, field in enumerate(fields):
        lines = field.split("\n") if by_line else [field]
        sizes = np.array([len(x) + 1 for x in lines[:-1]], np.int64)
        starts.append(at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        owners += [k] * len(lines)
        at += len(field) + len(joiner)
    text, first = joiner.join(fields), np.concatenate(starts)
    return text, np.array(owners), first, np.concatenate([first[1:], [len(text)]])


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many of the tokens that begin in it reach beyond it."""
    n = len(starts)
    # of sections that begin at one place all but the last are empty, and the last holds the characters
    a, b = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, np.maximum(end - 1, first), "right") - 1
    over = np.flatnonzero(a != b)
    counts, crossing = np.bincount(a, minlength=n).astype(float), np.bincount(a[over], minlength=n)
    if rule != "first":
        for t in over:
            held = np.arange(a[t], b[t] + 1)
            chars = np.minimum(ends[held], end[t]) - np.maximum(starts[held], first[t])
            counts[a[t]] -= 1
            if rule == "most":
                counts[held[np.argmax(chars)]] += 1
            else:
                counts[held] += chars / chars.sum()
    return counts, crossing


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", fields: Sequence[str] = ("text",), by_line: bool = True, rule: str = "first", joiner: str = JOINER) -> DataFrame:
    """doc_id, section, field, first_char, end_char, n_tokens (double under "share"), n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    count = pa.float64() if rule == "share" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = span_encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parts = []
                for row in zip(*(c.to_pylist() for c in part.columns[1:])):
                    text, owners, starts, ends = sections_of(list(row), by_line, joiner)
                    first, end = spans(text)
                    counts, crossing = attribute(first, end, starts, ends, rule)
                    parts.append((np.arange(len(starts)), owners, starts, ends, counts, crossing, np.full(len(starts), len(first))))
                section, owner, starts, ends, counts, crossing, total = (np.concatenate(x) for x in zip(*parts))
                rows = np.repeat(np.arange(part.num_rows), [len(p[0]) for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(section, pa.int64()), pa.array([fields[k] for k in owner]), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(counts).cast(count), pa.array(crossing, pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "section", "field", "first_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field{k}") for k, f in enumerate(fields)))
    return rows.mapInArrow(run, f"doc_id {kind}, section long, field string, first_char long, end_char long, n_tokens {'double' if rule == 'share' else 'long'}, n_crossing long, doc_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
