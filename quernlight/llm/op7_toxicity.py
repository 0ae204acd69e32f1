"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A document's features are the n-grams of 3 to 5 characters of its lower-cased words, with a blank before and after each
word, present or not, hashed to 2^22 places. On labelled rows the log ratio of a feature's smoothed share among label-1
and among label-0 rows scales it; logistic regression with an L2 penalty weighs the scaled features, and sums of
weights that haven't seen a row, fitted on three quarters of the others, are mapped to probabilities; the weights that
are kept are fitted on all. Features whose shares under the two labels lie within APART standard errors of each other
don't count, nor those beyond the furthest FEATURES: both bound the model, and are parameters of this module.

Training takes at most MAX_PER_LABEL labelled rows of each label, those with the smallest hash of their id: a bounded,
repeatable sample. Their n-grams are hashed where the rows are; the driver gets numbers, of a bounded number of rows.
Labels, languages, sources and ids are never inputs of a score. Every whole text is scored.

Nulls: a null text is an empty one; empty texts score by the intercept alone; null labels and null ids don't train.
Repeated rows each get a row, and train once; an id of several texts trains with each, ordered by their hash, as far as
the bound goes; an id with both labels trains under both. Very long texts are read whole, one at a time. With no labels,
or only one, every score is that label's share (0 if none). Empty tables give no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SIZES, BITS, FEATURES = (3, 4, 5), 22, 16_384
#: Features count whose shares under the two labels lie so many standard errors apart, the furthest FEATURES of them.
APART = 3.25
#: Parts of the training rows whose sums come from weights that haven't seen them.
FOLDS = 4
MAX_PER_LABEL, THRESHOLD = 1_500, 0.3
#: Characters of texts that are looked at in one go; a longer text has a go of its own.
AT_ONCE = 1 << 18


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield first, k
            first, size = k, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number of the text and hash of each n-gram of it, with repeats, for one size at a time."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    lengths = np.array([len(t.lower()) for t in texts]) + 1
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (code >= 128) | ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57))
    code = np.where(word, code, 32).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for n in SIZES:
        m = len(code) - n + 1
        if m < 1:
            continue
        h, inner = np.full(m, n, np.uint32), np.ones(m, bool)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= code[j : j + m] * np.uint32(0x9E3779B1)
            if 0 < j < n - 1:
                inner &= word[j : j + m]
        h ^= h >> 15
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - BITS)
        # the first blank stands before the first text; a gram belongs to the text of its second character
        inner &= np.arange(m) + 1 <= len(owner)
        yield owner[np.flatnonzero(inner)], h[inner]


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text."""
    out = []
    for a, b in _runs(texts):
        keys = np.unique(np.concatenate([np.zeros(0, np.int64)] + [(o.astype(np.int64) << BITS) | h for o, h in _grams(texts[a:b])]))
        cuts = np.searchsorted(keys, np.arange(1, b - a, dtype=np.int64) << BITS)
        out += [(x & ((1 << BITS) - 1)).astype(np.int32) for x in np.split(keys, cuts)]
    return out


@dataclass
class Model:
    places: np.ndarray  # hashed n-grams that count
    weights: np.ndarray  # of each, with its log-count ratio multiplied in
    intercept: float

    def __post_init__(self):
        self._table = None

    def __getstate__(self):
        return {"places": self.places, "weights": self.weights, "intercept": self.intercept, "_table": None}

    def sums(self, texts: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.full(1 << BITS, -1, np.int32)
            self._table[self.places] = np.arange(len(self.places), dtype=np.int32)
        out = np.full(len(texts), self.intercept)
        for a, b in _runs(texts):
            keys = [np.zeros(0, np.int64)]
            for owner, h in _grams(texts[a:b]):
                f = self._table[h]
                hit = f >= 0
                keys.append(np.unique(owner[hit].astype(np.int64) * FEATURES + f[hit]))
            owner, f = np.divmod(np.unique(np.concatenate(keys)), FEATURES)
            out[a:b] += np.bincount(owner, self.weights[f], b - a)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(texts), -30, 30)))


def _logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent; rows, cols: places of ones."""
    w, b, n, values = np.zeros(len(scale)), 0.0, len(y), scale[cols]
    step = 4 * n / max(1.0, float(np.bincount(rows, values**2, n).max()) * n * 0.02 + n)
    vw, vb, momentum = np.zeros_like(w), 0.0, 0.9
    for _ in range(steps):
        z = np.bincount(rows, values * (w + momentum * vw)[cols], n) + b + momentum * vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(cols, values * g[rows], len(w)) / n + penalty * (w + momentum * vw)
        vw, vb = momentum * vw - step * gw, momentum * vb - step * g.mean()
        w, b = w + vw, b + vb
    return w, b


def _ones(found: list[np.ndarray], part: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature that rows of the part have."""
    where = np.full(1 << BITS, -1, np.int32)
    where[places] = np.arange(len(places))
    cols = [c[c >= 0] for c in (where[found[i]] for i in part)]
    return np.repeat(np.arange(len(part)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int32), *cols])


def _fit(found: list[np.ndarray], y: np.ndarray, part: np.ndarray, penalty: float, steps: int) -> Model:
    """Choose, scale and weigh features by the rows of the part."""

    def counted(label: int) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        for i in part:
            if y[i] == label:
                out[found[i]] += 1
        return out

    one, zero = counted(1), counted(0)
    n1, n0 = max(1, int(y[part].sum())), max(1, int((1 - y[part]).sum()))
    both = (one + zero) / (n1 + n0)
    apart = np.abs(one / n1 - zero / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    apart[(one + zero < 3) | (apart < APART)] = 0
    places = np.argsort(-apart, kind="stable")[:FEATURES]
    places = np.sort(places[apart[places] > 0]).astype(np.int32)
    ratio = np.log(((one[places] + 1) / (one[places].sum() + len(places))) / ((zero[places] + 1) / (zero[places].sum() + len(places))))
    w, b = _logistic(*_ones(found, part, places), ratio, y[part], penalty, steps)
    return Model(places, w * ratio, b)


def train(found: list[np.ndarray], labels: np.ndarray, share: float | None = None, steps: int = 200, penalty: float = 3e-3) -> Model:
    """found: features() of each row. share: of label 1 among all labelled rows, which a sample of even labels does not show."""
    y = np.asarray(labels, float)
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(p / (1 - p))))
    z, a, c, t = np.zeros(len(y)), 1.0, 0.0, y
    for fold in range(FOLDS):
        held = np.arange(len(y)) % FOLDS == fold
        part, rest = np.flatnonzero(~held), np.flatnonzero(held)
        model = _fit(found, y, part, penalty, steps)
        rows, cols = _ones(found, rest, model.places)
        z[rest] = np.bincount(rows, model.weights[cols], len(rest)) + model.intercept
    if 0 < t.sum() < len(t):
        # smoothed targets, as in Platt's method, by Newton steps; then the sample's even labels are put back to their share
        t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
        x = np.stack([z, np.ones_like(z)], 1)
        ac = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ ac, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
            ac -= np.clip(np.linalg.solve(h, x.T @ (p - t)), -2, 2)
        a, c = float(max(ac[0], 1e-3)), float(ac[1])
    mean = float(y.mean())
    prior = np.log(share / (1 - share)) - np.log(mean / (1 - mean)) if 0 < share < 1 else 0.0
    # the weights that are kept are fitted on all rows
    model = _fit(found, y, np.arange(len(y)), penalty, steps)
    return Model(model.places, a * model.weights, a * model.intercept + c + prior)


def _grams_of(rows: DataFrame) -> DataFrame:
    """rows: labelled, label, mark, text. The distinct hashed n-grams for the text."""
    kind = rows.schema["labelled"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = features(part.column(3).to_pylist())
                ends = np.cumsum([0, *map(len, found)])
                grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], grams], ["labelled", "label", "mark", "grams"])

    return rows.mapInArrow(run, f"labelled {kind}, label int, mark long, grams array<int>")


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_PER_LABEL) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Features and labels of the rows to train on, and the share of label 1 among all labels that may train."""
    small_batches(docs.sparkSession)
    key = F.col(id_col)
    known = labels.filter(F.col(label_col).isin(0, 1) & key.isNotNull() & (F.pmod(F.crc32(key.cast("string")), F.lit(4)) != 2)).select(key.alias("labelled"), F.col(label_col).cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    order = F.xxhash64("labelled")
    chosen = [known.filter(F.col("label") == v).distinct().orderBy(order, "labelled").limit(most) for v in (0, 1)]
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * most ids at most
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _grams_of(docs.select(key.alias("labelled"), text.alias("text")).join(ids, "labelled").select("labelled", "label", F.xxhash64("text").alias("mark"), "text"))
    # an id may have any number of rows: the bound holds for rows too
    once = rows.groupBy("labelled", "label", "mark").agg(F.first("grams").alias("grams"))
    bounded = [once.filter(F.col("label") == v).orderBy(order, "labelled", "mark").limit(most) for v in (0, 1)]
    got = [part.toArrow() for part in bounded]
    keys = [k for part in got for k in zip(part["labelled"].to_pylist(), part["label"].to_pylist(), part["mark"].to_pylist())]
    found = [x.values.to_numpy() for part in got for x in part["grams"]]
    mixed = sorted(range(len(keys)), key=lambda i: (zlib.crc32(str(keys[i][0]).encode()), keys[i][1:]))
    return [found[i] for i in mixed], np.array([keys[i][1] for i in mixed], int), float(share)


def fit(docs: DataFrame, labels: DataFrame, **names) -> Model:
    found, y, share = sample(docs, labels, **names)
    return train(found, y, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted; or, with keep, the rows of docs that aren't predicted, as they were."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = model.scores([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                if keep:
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], names=names).filter(pa.array(s < threshold))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    if keep:
        return docs.select("*", text).mapInArrow(run, docs.schema)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
