import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import ODD, sentence

from quernlight.llm import bagminhash, op5_near_duplicates, op6_decontaminate, op7_toxicity, op8_quality_rules, op10_license_scan
from quernlight.llm.components import components


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


def brute_classes(texts):
    words = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 8 else Counter({("#", *w) if w else ("!", t or ""): 1}) for w, t in zip(words, texts)]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            low = sum((sets[i] & sets[j]).values())
            if low >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - low):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))]


NEAR = [None, "", "", "!!!", "!!! ", "One two", "one, TWO", "one two three"]
NEAR += [sentence(1), sentence(1).upper(), sentence(1) + " !", edited(sentence(1), 5, 1), edited(sentence(1), 6, 2), sentence(2), edited(sentence(2), 1, 40), "ha " * 300, "ha " * 310, "ha " * 1000, sentence(3, 4000), edited(sentence(3, 4000), 2, 30)]
NEAR += [edited(sentence(9, 150), 100 + i, 3) for i in range(60)]


def test_signatures_estimate_weighted_jaccard():
    rng, errors, truth = np.random.default_rng(0), [], []
    for _ in range(40):
        a = {int(k): int(rng.choice([1, 1, 2, 3, 9, 40])) for k in rng.integers(0, 2**63, 30)}
        b = {k: max(1, int(v * rng.choice([0.5, 1, 1, 2]))) for k, v in a.items() if rng.random() < 0.9} or {1: 1}
        parts = [sorted(x.items()) for x in (a, b)]
        s = bagminhash.signatures(np.array([k for p in parts for k, _ in p], np.uint64), np.repeat([0, 1], [len(p) for p in parts]), np.array([v for p in parts for _, v in p]), 2, 1920)
        j = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        truth.append(j)
        errors.append((s[0] == s[1]).mean() - j)
    assert abs(np.mean(errors)) < 0.006 and np.sqrt(np.mean(np.square(errors))) < 1.5 * math.sqrt(np.mean([j * (1 - j) / 1920 for j in truth]))


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_as_by_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(op5_near_duplicates, "BLOCK_MEMBERS", block)
    rows = op5_near_duplicates.near_duplicates(docs_of(NEAR).repartition(3)).collect()
    assert [r["class_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == brute_classes(NEAR)


def test_near_duplicates_of_a_thousand_documents(spark):
    texts = dict(sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()))
    keys, words = list(texts), [" ".join(re.findall(r"[^\W_]+", t.lower())) for t in texts.values()]
    raw = [w.encode() for w in words]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, owner, n = bagminhash.shingles(*bagminhash.word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds), 5)
    s = bagminhash.similarities(h, owner, n, len(keys))
    own = {}
    for k, w in enumerate(words):
        own.setdefault(w or "\0" + texts[keys[k]], []).append(k)
    enough = np.bincount(owner, n, len(keys)) >= 4
    parent = list(range(len(keys)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(g[0], k) for g in own.values() for k in g[1:]] + [(a, b) for a, b in zip(*np.nonzero(np.triu(s >= 0.8 - 1e-9, 1))) if enough[a] and enough[b]]
    for a, b in links:
        low, high = sorted((top(int(a)), top(int(b))))
        parent[high] = low
    rows = dict(map(tuple, op5_near_duplicates.query(spark, "/root/testdata/sf0.01").collect()))
    assert rows == {k: keys[top(i)] for i, k in enumerate(keys)}


def test_one_of_each_class_stays(docs_of):
    docs = docs_of([*((i, t) for i, t in enumerate(NEAR)), (8, sentence(1)), (8, sentence(1)), (None, sentence(2)), (None, "only here, without an id")])
    kept = op5_near_duplicates.without_copies(docs).collect()
    expected = sorted(set(brute_classes(NEAR)))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == expected and [r["text"] for r in kept if r["doc_id"] is None] == ["only here, without an id"]
    assert op5_near_duplicates.without_copies(docs).columns == docs.columns
    assert op5_near_duplicates.without_copies(docs_of([])).count() == 0


@pytest.mark.parametrize("run", [op5_near_duplicates.near_duplicates, op5_near_duplicates.without_copies])
def test_thresholds_that_banding_would_miss_are_refused(docs_of, run):
    with pytest.raises(ValueError, match="threshold 0.6"):
        run(docs_of(["a", "b"]), threshold=0.6)


def test_words_of_long_texts_are_hashed_in_parts(monkeypatch):
    texts = [sentence(1, 900), "", sentence(2, 3), "x" * 500, sentence(3, 2000)]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    whole = bagminhash.word_hashes(data, bounds)
    monkeypatch.setattr(bagminhash, "SEGMENT", 100)
    for a, b in zip(whole, bagminhash.word_hashes(data, bounds)):
        assert (a == b).all()
    assert whole[1].tolist() == [i for i, t in enumerate(texts) for _ in t.split()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(500, i) for i in range(501, 530)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 200: 100, 150: 100, **{i: 500 for i in range(501, 530)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_overlaps(texts, items):
    """Every item laid beside every text at every offset: (text, item) -> words that agree in the best window."""
    numbers = {}
    words = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in re.findall(r"[^\W_]+", (t or "").lower())], np.int64)
    found, split = {}, [(k, words(t)) for k, t in items]
    for i, t in enumerate(texts):
        d = words(t)
        for k, w in split:
            n = len(w)
            if n < 5:  # only as the whole text
                if n and w.tolist() == d.tolist():
                    found[i, k] = n
                continue
            width, gap = min(16, n), np.full(n, -1)
            beside = np.lib.stride_tricks.sliding_window_view(np.concatenate([gap, d, gap]), n)
            best = 0
            for a in range(0, len(beside), 4096):
                sums = np.cumsum(beside[a : a + 4096] == w, axis=1, dtype=np.int64)
                sums[:, width:] = sums[:, width:] - sums[:, :-width]
                best = max(best, int(sums[:, width - 1 :].max()))
            if best >= (0.8 * width if width >= 8 else width):
                found[i, k] = best
    return found


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_overlaps_as_by_brute_force(spark, docs_of, monkeypatch, broadcast):
    monkeypatch.setattr(op6_decontaminate, "BROADCAST_SEEDS", broadcast)
    items = [(i, sentence(50 + i, n)) for i, n in enumerate((8, 12, 16, 30, 60, 5))] + [(6, None), (7, ""), (8, "yes no maybe"), (9, "one"), (10, sentence(70, 7)), (11, "Yes, no. MAYBE")]
    passage, long_ = items[3][1], items[4][1]
    replaced = " ".join("other" if k % 7 == 3 else w for k, w in enumerate(long_.split()))
    texts = [None, "", sentence(1), passage, sentence(2) + " " + passage.upper() + "! " + sentence(3), " ".join(passage.split()[:20]), " ".join(passage.split()[15:]), replaced, sentence(4) + " " + replaced, items[0][1], "x " + items[1][1], items[5][1], passage + " " + long_, (sentence(5, 3000) + " " + long_ + " ") * 2, " ".join(passage.split()[:9])]
    texts += ["Yes: no, maybe!", "yes no maybe so", "one", "one one", "x " + sentence(70, 7) + " y", " ".join(sentence(70, 7).split()[:6] + ["z"]), "no maybe"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = op6_decontaminate.overlaps(docs_of(texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_matched"] for r in rows} == brute_overlaps(texts, items)
    kept = op6_decontaminate.without_overlaps(docs_of(texts), benchmark)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(texts))) - {r["doc_id"] for r in rows})
    empty = benchmark.limit(0)
    assert op6_decontaminate.overlaps(docs_of(texts), empty).count() == 0 and op6_decontaminate.overlaps(docs_of([]), benchmark).count() == 0


def test_overlaps_of_every_substitution_pattern(spark, docs_of):
    items, texts, pairs = [], [], set()
    for n in range(8, 17):
        word = [f"w{n}x{j}" for j in range(n)]
        items.append((n, " ".join(word)))
        most = next(k for k in range(n, -1, -1) if n - k >= 0.8 * n)
        for places in itertools.combinations(range(n), most):
            pairs.add((len(texts), n, n - most))
            texts.append(" ".join(["before", *("other" if j in places else w for j, w in enumerate(word)), "after"]))
        texts.append(" ".join("other" if j <= most else w for j, w in enumerate(word)))
        cut = word[most:]
        for text in (cut, ["before", *cut], word[: n - most]):
            pairs.add((len(texts), n, n - most))
            texts.append(" ".join(text))
    rows = op6_decontaminate.overlaps(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_matched"]) for r in rows} == pairs


def test_only_rows_that_overlap_go(spark, docs_of):
    a, b, clean = sentence(60, 30), sentence(61, 30), sentence(62, 30)
    docs = docs_of([(None, a), (None, clean), (None, None), (1, "x " + b), (1, clean), (2, clean)])
    benchmark = spark.createDataFrame([(None, a), (7, b), (None, sentence(63, 30))], "item_id long, text string")
    kept = op6_decontaminate.without_overlaps(docs, benchmark)
    assert kept.columns == docs.columns and sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == sorted([(0, clean), (0, ""), (1, clean), (2, clean)])
    assert {(r["doc_id"], r["item_id"]) for r in op6_decontaminate.overlaps(docs, benchmark).collect()} == {(None, None), (1, 7)}


def test_toxicity_on_held_out_rows(spark, docs_of):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(900):
        words = sentence(i, r.randint(20, 90)).split()
        if toxic := i % 6 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zorgblat", "quuxified", "vexnard"]) + r.choice(["", "s", "!"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = docs_of(texts + ["", None, "zorgblat " * 20_000])
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    rows = op7_toxicity.score(docs, op7_toxicity.fit(docs, known)).collect()
    held = [(x["predicted"], labels[x["doc_id"]][1]) for x in rows if x["held_out"] and x["doc_id"] < 900]
    assert len(held) > 150 and np.mean([p == y for p, y in held]) > 0.97
    last = {x["doc_id"]: x for x in rows if x["doc_id"] >= 900}
    assert last[900]["score"] == last[901]["score"] < 0.3 <= last[902]["score"] <= 1
    kept = op7_toxicity.score(docs, op7_toxicity.fit(docs, known), keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x["predicted"] for x in rows)


def test_toxicity_without_labels(spark, docs_of):
    docs, none = docs_of(["a b", ""]), spark.createDataFrame([], "doc_id long, toxic int")
    assert [x["predicted"] for x in op7_toxicity.score(docs, op7_toxicity.fit(docs, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert op7_toxicity.score(docs_of([]), op7_toxicity.fit(docs, one)).count() == 0


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_rule_counts_and_base(spark, docs_of):
    base = sentence(3, 30)
    texts = [None, "", " \n\t", *ODD, base, base + " " + base, base + "\n" + base + "\n\n \n" + base, "ha " * 500, "ha " * 9, "a|b #c*d $%&<>", "\u00a0\u2003 x\x0by\x1cz", sentence(1, 3000), "x" * 50_000]
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = op8_quality_rules.rate(docs_of(texts), op8_quality_rules.fit(docs_of(texts), none)).collect()
    for r in rows:
        counts = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in op8_quality_rules.COUNTS) == counts, texts[r["doc_id"]]
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)


def test_forest_rejects_odd_documents_and_keeps_good_ones(spark, docs_of):
    texts = [sentence(i, 60 + i % 90) for i in range(400)] + [" ".join(w.upper() + "!!" for w in sentence(i, 80).split()) for i in range(400, 430)] + ["### ".join(sentence(i, 80).split()) for i in range(430, 460)]
    docs, labels = docs_of(texts), spark.createDataFrame([(i, int(i < 400)) for i in range(0, 460, 2)], "doc_id long, quality int")
    rows = op8_quality_rules.rate(docs, op8_quality_rules.fit(docs, labels)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert np.mean([kept[i] for i in range(400)]) > 0.97 and np.mean([kept[i] for i in range(400, 460)]) < 0.2
    left = op8_quality_rules.rate(docs, op8_quality_rules.fit(docs, labels), keep=True)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, k in kept.items() if k)
    assert op8_quality_rules.rate(docs_of([]), op8_quality_rules.fit(docs, labels)).count() == 0


def test_spans_of_licences(docs_of):
    long_ = sentence(90, 150)
    templates = [*op10_license_scan.TEMPLATES, (long_, "zz-long")]
    texts = ["", "x " + op10_license_scan.TEMPLATES[2][0], long_ + " " + sentence(1), " ".join(w for i, w in enumerate(long_.split()) if i % 40 != 7), " ".join(long_.split()[:80]), "under the mit license " * 3]
    rows = op10_license_scan.spans(docs_of(texts), templates=templates).collect()
    found = {(r["doc_id"], r["label"], r["is_phrase"]): (r["first_word"], r["last_word"]) for r in rows}
    assert found[1, "gpl-3", False] == (1, 12) and found[2, "zz-long", False] == (0, 149) and found[3, "zz-long", False] == (0, 145)
    assert {k[0] for k in found} == {1, 2, 3, 5} and {k[1] for k in found if k[0] == 5} == {"mit"}
    labels = {r["doc_id"]: r["labels"] for r in op10_license_scan.scan(docs_of(texts), templates=templates).collect()}
    assert labels == {0: "", 1: "gpl-3", 2: "zz-long", 3: "zz-long", 4: "", 5: "mit"}
    with pytest.raises(ValueError, match="fewer than 3 words"):
        op10_license_scan.scan(docs_of(texts), templates=[("two words", "x")])


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in op10_license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(docs_of):
    template = op10_license_scan.TEMPLATES[3][0]
    broken = template.split()
    broken.insert(10, "really")
    del broken[20]
    texts = [None, "", "mit", *ODD, "Released under the MIT License.", "under the MIT\nLicense, under\u00a0the MIT license under the mit license", "CC BY-NC 4.0 cc by nc", "Licensed under the Apache License, Version 2.0.", sentence(1) + " " + template, " ".join(broken) + " " + sentence(2), "This work is licensed under the GNU General Public License, version 3.", " ".join(template.split()[:9]), (sentence(3, 3000) + " under the mit license ") * 2, "gnu public general license"]
    rows = {r["doc_id"]: r for r in op10_license_scan.scan(docs_of(texts).repartition(3)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(text), text
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    n = 3 + len(ODD)
    assert [rows[i]["labels"] for i in range(n, n + 10)] == ["mit", "mit", "cc-by-nc", "apache-2", "gpl", "gpl", "gpl-3", "", "mit", ""]
    repeated = op10_license_scan.scan(docs_of([(1, "under the mit license"), (1, "under the mit license"), (None, "x")])).collect()
    assert sorted(r["n_base"] for r in repeated) == [0, 1, 1]
    assert op10_license_scan.scan(docs_of([])).count() == 0
