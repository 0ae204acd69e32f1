"""The two trained models against plain versions of themselves."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import ODD, sentence

from quernlight.llm import op7_toxicity, op8_quality_rules

DATA = "/root/testdata/sf0.001"


def gram_hash(gram: str) -> int:
    h = len(gram)
    for c in gram:
        h = h * 0x01000193 % 2**32 ^ ord(c) * 0x9E3779B1 % 2**32
    return ((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> 10


def plain_features(text: str) -> list[int]:
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return sorted({gram_hash(s[i : i + n]) for s in (f" {w} " for w in words) for n in (3, 4, 5) for i in range(len(s) - n + 1)})


TEXTS = ["", " ", "a", "it's  A\nlong-ish LINE 42", *ODD, "x" * 5000, "\n".join(["one two"] * 3000), sentence(5, 4000)]


def test_features_as_by_words():
    assert [f.tolist() for f in op7_toxicity.features(TEXTS)] == [plain_features(t) for t in TEXTS]


def plain_fit(found: list[set], y, penalty, steps):
    """Dense: choice of features, log-count ratios, and accelerated gradient descent."""
    one, zero = (Counter(f for x, label in zip(found, y) if label == k for f in x) for k in (1, 0))
    n1, n0 = int(sum(y)), int(len(y) - sum(y))
    apart = {}
    for f in {*one, *zero}:
        both = (one[f] + zero[f]) / (n1 + n0)
        if one[f] + zero[f] >= 3:
            apart[f] = abs(one[f] / n1 - zero[f] / n0) / np.sqrt(max(both * (1 - both), 1e-12) * (1 / n1 + 1 / n0))
    places = sorted(f for f, a in apart.items() if a >= op7_toxicity.APART)
    s1, s0 = sum(one[f] + 1 for f in places), sum(zero[f] + 1 for f in places)
    ratio = np.array([np.log((one[f] + 1) / s1) - np.log((zero[f] + 1) / s0) for f in places])
    x = np.array([[f in d for f in places] for d in found], float) * ratio
    w, b, vw, vb, n = np.zeros(len(places)), 0.0, np.zeros(len(places)), 0.0, len(y)
    step = 4 * n / max(1.0, float((x**2).sum(1).max()) * n * 0.02 + n)
    for _ in range(steps):
        at = w + 0.9 * vw
        g = 1 / (1 + np.exp(-np.clip(x @ at + b + 0.9 * vb, -30, 30))) - y
        vw, vb = 0.9 * vw - step * (x.T @ g / n + penalty * at), 0.9 * vb - step * g.mean()
        w, b = w + vw, b + vb
    return places, w * ratio, b


def test_weights_as_by_a_dense_model():
    r = random.Random(3)
    texts = [" ".join([*sentence(i, 30).split(), *([r.choice(["zorg", "quux"])] * (i % 3 == 0))]) for i in range(90)]
    y = np.array([float(i % 3 == 0) for i in range(90)])
    found = op7_toxicity.features(texts)
    model = op7_toxicity._fit(found, y, np.arange(90), 3e-3, 60)
    places, weights, intercept = plain_fit([set(f.tolist()) for f in found], y, 3e-3, 60)
    assert model.places.tolist() == places and len(places) > 5
    assert np.allclose(model.weights, weights, atol=1e-4) and abs(model.intercept - intercept) < 1e-4
    for text, s in zip(texts + TEXTS, model.sums(texts + TEXTS)):
        own = set(plain_features(text))
        assert abs(s - model.intercept - sum(w for p, w in zip(model.places.tolist(), model.weights) if p in own)) < 1e-9


def test_rows_that_train_are_bounded(spark, docs_of):
    docs = docs_of([*((1, f"text {i}") for i in range(50)), *((4, "same") for _ in range(50)), (3, "other")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (3, 0)], "doc_id long, toxic int")
    assert all(__import__("zlib").crc32(str(i).encode()) % 4 != 2 for i in (1, 3, 4))
    found, y, share = op7_toxicity.sample(docs, labels, most=7)
    assert (len(found), y.tolist().count(1), y.tolist().count(0), share) == (9, 7, 2, 0.5)
    quality = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    assert op8_quality_rules.fit(docs, quality, most=7).subsample == 7


def test_ids_of_text(spark):
    docs = spark.createDataFrame([(f"d{i}", sentence(i, 60)) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(40)], "doc_id string, quality int, toxic int")
    assert op8_quality_rules.rate(docs, op8_quality_rules.fit(docs, labels)).count() == 40
    assert op7_toxicity.score(docs, op7_toxicity.fit(docs, labels)).count() == 40


def plain_score(forest, row) -> float:
    total = 0.0
    for feature, split, child, path in zip(forest.feature, forest.split, forest.child, forest.path):
        node = 0
        while feature[node] >= 0 and child[node]:
            node = child[node] + int(row[feature[node]] >= split[node])
        total += path[node]
    n = forest.subsample
    expected = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return 2 ** (-total / len(forest.feature) / expected)


def test_paths_through_trees_one_row_at_a_time():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:5] += 8
    forest = op8_quality_rules.grow(x, trees=30, subsample=64)
    s = forest.scores(x)
    assert np.allclose(s, [plain_score(forest, row) for row in x]) and s[:5].min() > np.median(s[5:])


def plain_threshold(s, good, loss):
    best, cuts = None, sorted(set(s.tolist()))
    for k, cut in enumerate(cuts):
        bad, lost = np.mean(s[~good] >= cut), np.mean(s[good] >= cut)
        if lost <= loss and (best is None or bad - lost > best[0] + 1e-12):
            best = (bad - lost, (cut + cuts[k - 1]) / 2 if k else cut)
    return best[1] if best and best[0] > 0 else 2.0


@pytest.mark.parametrize("shift", [0.0, 1.0, 6.0])
def test_thresholds_by_trying_every_cut(shift):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3))
    good = np.arange(200) >= 20
    x[~good] += shift
    forest = op8_quality_rules.grow(x, trees=20, subsample=32)
    expected = plain_threshold(forest.scores(x), good, 0.02)
    assert op8_quality_rules.calibrate(forest, x, good, 0.02).threshold == pytest.approx(expected)


def test_verdicts_follow_scores_and_threshold(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    forest = op8_quality_rules.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = op8_quality_rules.query(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert r["oddness"] == pytest.approx(plain_score(forest, op8_quality_rules.statistics(texts[r["doc_id"]])[1]))
    assert all(r["kept"] == (not r["base_failed"] and r["oddness"] < forest.threshold) for r in rows)
