"""Quality rules: an isolation forest over rule statistics.

Each document gets counts that rules of thumb use (words, symbols, repeated lines and windows, capitals and so on).
Trees of random splits, each over SUBSAMPLE labelled rows, isolate odd documents along short paths; a document's score
is 2^(-mean path / expected path). The threshold is the one that best parts rows labelled good from rows labelled bad
among those that reject at most LOSS of the good ones. A document is kept if neither the base rules nor the forest
reject it.

The forest is fitted on at most MAX_LABELLED labelled rows, those with the smallest hash of their id; the statistics and
the scores are of every whole text. What the forest looks at is bounded (shares of symbols, exclamation marks and bars a
word at 2, of commas and stops at 1), so that one odd text doesn't stretch the range that splits are drawn from; the
counts that are returned are not.

Nulls: a null text has no words (and fails the base); null labels and null ids don't train. With no labelled rows the
forest rejects nothing; with one kind only, nothing either. Repeated rows each get a row, and train each, as far as the
bound goes; rows that are equal in id and statistics (ties) are interchangeable. Very long texts are read whole, one at a
time. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import small_batches, table

TREES, SUBSAMPLE, SEED = 200, 128, 20_240_229
MAX_LABELLED, LOSS = 20_000, 0.005
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list[str], k: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of k words that the text has twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.unique(twice)
    at = np.searchsorted(found, h)
    hit = found[np.minimum(at, len(found) - 1)] == h
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[k : k + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS, and the features that the forest looks at."""
    words = _WORD.findall(text)
    n, lines = len(words), text.split("\n")
    full = [x for x in lines if x.strip(BLANKS)]
    chars, symbols = len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS))
    counts = [n, chars, symbols, len(full) - len(set(full)), _repeated(words)]
    seen = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    letters = seen[65:91].sum() + seen[97:123].sum()
    m = max(1, n)
    return counts, [
        np.log1p(n),
        chars / m,
        min(symbols / m, 2.0),
        counts[3] / max(1, len(full)),
        counts[4] / m,
        seen[65:91].sum() / max(1, letters),
        min(seen[33] / m, 2.0),
        seen[48:58].sum() / max(1, chars),
        min(seen[124] / m, 2.0),
        (1 - len(set(words)) / m) / np.log2(m + 2),
        min((seen[44] + seen[46]) / m, 1.0),
        letters / max(1, chars),
    ]


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: a node's feature (-1 at a leaf), split, first child, and path length if it is a leaf."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    subsample: int
    threshold: float = 2.0  # scores are below 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                right = x[rows, np.maximum(f, 0)] >= split[at]
                at = np.where(f < 0, at, child[at] + right)
            total += path[at]
        return 2 ** (-total / len(self.feature) / max(float(_expected(self.subsample)), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest:
    """Random trees over x; rows of x must be in a repeatable order."""
    size = min(subsample, len(x))
    depth = int(np.ceil(np.log2(max(2, size))))
    if size < 2:
        return Forest(np.zeros((0, 1), np.int16), np.zeros((0, 1)), np.zeros((0, 1), np.int32), np.zeros((0, 1)), depth, size)
    rng, most, made = np.random.default_rng(seed), 2 ** (depth + 1), []
    for _ in range(trees):
        feature, split, child, path = np.full(most, -1, np.int16), np.zeros(most), np.zeros(most, np.int32), np.zeros(most)
        todo, used = [(0, x[rng.choice(len(x), size, replace=False)], 0)], 1
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if level == depth or len(part) < 2 or not len(open_):
                path[node] = level + float(_expected(len(part)))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            feature[node], split[node], child[node] = f, cut, used
            right = part[:, f] >= cut
            todo += [(used, part[~right], level + 1), (used + 1, part[right], level + 1)] if right.any() and not right.all() else [(used, part, depth), (used + 1, part, depth)]
            used += 2
        made.append((feature, split, child, path))
    return Forest(*(np.stack(a) for a in zip(*made)), depth, size)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, loss: float = LOSS) -> Forest:
    """Set the threshold: reject as many bad rows less good ones (by share) as can be, and at most `loss` of the good."""
    if not len(x) or good.all() or not good.any():
        return forest
    s = forest.scores(x)
    cuts = np.unique(s)
    bad_share = 1 - np.searchsorted(np.sort(s[~good]), cuts) / (~good).sum()
    good_share = 1 - np.searchsorted(np.sort(s[good]), cuts) / good.sum()
    allowed = good_share <= loss
    if allowed.any() and (bad_share - good_share)[allowed].max() > 0:
        k = int(np.flatnonzero(allowed)[np.argmax((bad_share - good_share)[allowed])])
        forest.threshold = float((cuts[k] + cuts[k - 1]) / 2 if k else cuts[k])
    return forest


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def _features_of(docs: DataFrame) -> DataFrame:
    """labelled, good, features of the labelled rows (docs: labelled, good, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for _, f in got], pa.list_(pa.float64())), pa.array([base_failed(c[0], c[4]) for c, _ in got])], ["labelled", "good", "features", "base_failed"])

    kind = docs.schema["labelled"].dataType.simpleString()
    return docs.mapInArrow(run, f"labelled {kind}, good boolean, features array<double>, base_failed boolean")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_LABELLED) -> Forest:
    small_batches(docs.sparkSession)
    # whole numbers meet as such whatever their width, all other ids as text
    whole = all(isinstance(df.schema[id_col].dataType, IntegralType) for df in (docs, labels))
    key = F.col(id_col).cast("long" if whole else "string")
    known = labels.filter(F.col(label_col).isin(0, 1) & key.isNotNull()).select(key.alias("labelled"), (F.col(label_col) == 1).alias("good"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("labelled"), "labelled", "good").limit(most))  # `most` ids at most
    found = _features_of(docs.select(key.alias("labelled"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "labelled").select("labelled", "good", "text"))
    # an id may have any number of rows: the bound holds for rows too
    rows = found.orderBy(F.xxhash64("labelled"), "labelled", "good", "features").limit(most).toArrow()
    if not rows.num_rows:
        return grow(np.zeros((0, 1)))
    x, good, ids = np.array(rows["features"].to_pylist()), np.array(rows["good"].to_pylist(), bool), np.array(rows["labelled"].to_pylist())
    order = np.lexsort((*x.T[::-1], ids))
    x, good, failed = x[order], good[order], np.array(rows["base_failed"].to_pylist(), bool)[order]
    # the base rejects its rows whatever the forest says, so they don't move the threshold
    return calibrate(grow(x), x[~failed], good[~failed])


def rate(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Counts and verdicts of every document; or, with keep, the rows of docs that are kept, as they were."""
    small_batches(docs.sparkSession)
    names = docs.columns
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [statistics(t) for t in part.column(part.num_columns - 1).to_pylist()]
                s = forest.scores(np.array([f for _, f in got]).reshape(len(got), -1))
                failed = np.array([base_failed(c[0], c[4]) for c, _ in got], bool)
                kept = ~failed & (s < forest.threshold)
                if keep:
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(pa.array(kept))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*(c for c, _ in got))), pa.array(failed), pa.array(kept), pa.array(s)], ["doc_id", *COUNTS, "base_failed", "kept", "oddness"])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    if keep:
        return docs.select("*", text).mapInArrow(run, docs.schema)
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, oddness double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, fit(docs, table(spark, sf_dir, "labels")))
