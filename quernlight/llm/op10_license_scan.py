"""License scans by diagonal voting, with DataFrame functions only.

Every run of K words of every document is hashed; runs whose hash is in a bitmap of the templates' runs are joined to
the templates' places. A hit votes for the diagonal (its place in the text less its place in the template); votes are
summed by diagonal, diagonals at most GAP apart are merged (words put in or left out move a match to a neighbouring
one), and a merged span is kept if it covers enough of its template within a span that isn't much longer.
A phrase stands consecutively where one diagonal has all of its runs. Which places of a template a diagonal has is a
bit mask, so that a state is as large as the templates, not as the text.

Nulls: a null text has no words; empty and short texts get a row without labels. Ties and repeated rows or ids: a row
each, told apart by a row key. Very long texts are scanned whole; their words are hashed to numbers before they are laid
out by place. Empty tables give no rows. Templates of fewer than K words are refused (ValueError). Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, in_bitmap, literal_table, lower_ascii, table

K, GAP, COVERAGE, STRETCH = 3, 3, 0.75, 1.5
#: Words are what stands between these.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases to count, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Sentences by which licences are told, as their publishers word them.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
]
#: Templates beyond so many runs are joined by shuffling, not broadcast.
BROADCAST_RUNS = 200_000
#: Bits of a mask.
MASK = 63


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def places(spark: SparkSession, phrases, templates, k: int = K) -> DataFrame:
    """run, template, at, n_runs, label, is_phrase: each run of k words of each template."""
    every = [(t, words.split(), label, t < len(phrases)) for t, (words, label) in enumerate([*phrases, *templates])]
    if short := [" ".join(w) for _, w, _, _ in every if len(w) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    names = sorted({label for _, _, label, _ in every})
    rows = [(" ".join(w[i : i + k]), t, i, len(w) - k + 1, names.index(label), is_phrase) for t, w, label, is_phrase in every for i in range(len(w) - k + 1)]
    return literal_table(spark, rows, "run string, template int, at int, n_runs int, label int, is_phrase boolean")


def _bits(place: Column, n: int) -> list[Column]:
    """Masks of n bits in all with the bit of a place set; the place may be null."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(MASK)))
    return [F.when(F.floor(place / MASK) == j, one).otherwise(F.lit(0).cast("bigint")) for j in range(-(-n // MASK))]


def _merged(docs: DataFrame, phrases, templates, id_col: str, text_col: str, coverage: float) -> DataFrame:
    """A row for each merged span, held or not, and one without a template for each document."""
    spark = docs.sparkSession
    known = places(spark, phrases, templates)
    n = sum(len(w.split()) for w, _ in [*phrases, *templates])
    longest = max([1, *(len(w.split()) for w, _ in [*phrases, *templates])])
    bits = bitmap_bits(n, 64)
    map_bits = bitmap(known.select(F.xxhash64(*[F.xxhash64(F.split("run", " ")[j]) for j in range(K)])), bits)
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    # after the last word comes a null, so that a row of every text is left, with or without hits
    hashed = split.select("row", "doc_id", "words", F.concat(F.transform("words", lambda w: F.xxhash64(w)), F.array(F.lit(None).cast("bigint"))).alias("hashes"))
    # no array is empty; the outer form keeps Catalyst from a filter on its size, which would hash every text twice
    placed = hashed.select("row", "doc_id", "words", "hashes", F.posexplode_outer("hashes").alias("pos", "hash"))
    run = [F.col("hash"), *(F.get("hashes", F.col("pos") + j) for j in range(1, K))]
    likely = run[-1].isNotNull() & in_bitmap(map_bits, F.xxhash64(*run), bits)
    words = F.concat_ws(" ", *[F.get("words", F.col("pos") + j) for j in range(K)])
    hits = placed.filter(F.col("hash").isNull() | likely).select("row", "doc_id", (F.size("hashes") - 1).cast("long").alias("n_words"), "pos", F.when(F.col("hash").isNotNull(), words).alias("run"))
    # one exchange, by row, serves every grouping below
    votes = hits.join(F.broadcast(known) if n <= BROADCAST_RUNS else known, "run", "left").withColumn("diagonal", F.col("pos") - F.col("at")).repartition("row")
    key, masks = ["row", "doc_id", "n_words", "template", "n_runs", "label", "is_phrase"], [f"m{j}" for j in range(-(-longest // MASK))]
    diagonals = votes.groupBy(*key, "diagonal").agg(*[F.bit_or(b).alias(m) for b, m in zip(_bits(F.col("at"), longest), masks)], F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int"), F.lit(0))
    spans = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    held = lambda: reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks])
    place = F.col("is_phrase") & (held() == F.col("n_runs"))
    merged = spans.groupBy(*key, "span").agg(
        *[F.bit_or(m).alias(m) for m in masks],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum(place.cast("long")).alias("places"),
        F.min(F.when(place, F.col("diagonal"))).alias("first_place"),
        F.max(F.when(place, F.col("diagonal"))).alias("last_place"),
    )
    share = held() / F.col("n_runs")
    reach = F.col("last") - F.col("first") + 1
    kept = F.when(F.col("is_phrase"), F.col("places") > 0).otherwise((share >= coverage) & (reach <= F.col("n_runs") * STRETCH))
    return merged.select(*key, "first", "last", "places", "first_place", "last_place", share.alias("share"), F.coalesce(kept, F.lit(False)).alias("held"))


def _labels(phrases, templates) -> list[str]:
    return sorted({label for _, label in [*phrases, *templates]})


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, label, is_phrase, first_word, last_word (the span's words, from 0), places (of a phrase), share (of the template's runs) of each span that is kept."""
    names = F.array(*[F.lit(x) for x in _labels(phrases, templates)])
    found = _merged(docs, phrases, templates, id_col, text_col, coverage).filter("held")
    return found.select("doc_id", F.get(names, F.col("label")).alias("label"), "is_phrase", F.col("first").cast("long").alias("first_word"), (F.col("last") + K - 1).cast("long").alias("last_word"), "places", "share")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = _labels(phrases, templates)
    sets = [f"l{j}" for j in range(-(-len(names) // MASK))]

    def joined(prefix: str) -> Column:
        held = lambda name, i: F.getbit(F.get(F.array(*[F.col(prefix + s) for s in sets]), F.floor(i / MASK).cast("int")), F.pmod(i, F.lit(MASK))) == 1
        return F.array_join(F.filter(F.array(*[F.lit(x) for x in names]), held), ",")

    found = _merged(docs, phrases, templates, id_col, text_col, coverage)
    own = _bits(F.col("label"), len(names))
    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(F.coalesce("places", F.lit(0))).cast("long").alias("n_base"),
            F.min("first_place").cast("long").alias("first_word"),
            F.max("last_place").cast("long").alias("last_word"),
            *[F.bit_or(F.when(F.col("places") > 0, b).otherwise(F.lit(0).cast("bigint"))).alias(f"base_{s}") for b, s in zip(own, sets)],
            *[F.bit_or(F.when(F.col("held"), b).otherwise(F.lit(0).cast("bigint"))).alias(f"all_{s}") for b, s in zip(own, sets)],
            F.coalesce(F.max(F.when(F.col("held"), F.least("share", F.lit(1.0)))), F.lit(0.0)).alias("score"),
        )
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_").alias("base_labels"), joined("all_").alias("labels"), "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(phrases=PHRASES, templates=TEMPLATES) -> str:
    """The same by DuckDB: runs by their words, every place of every document."""
    values = ", ".join(f"({t}, '{words}', '{label}', {t < len(phrases)})" for t, (words, label) in enumerate([*phrases, *templates]))
    run = "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]"
    labels = "array_to_string(list_sort(list_distinct(list(CASE WHEN {} THEN label END))), ',')"
    return f"""
WITH t AS (SELECT *, string_split(words, ' ') AS w FROM (VALUES {values}) v(template, words, label, is_phrase)),
runs AS (SELECT template, label, is_phrase, len(w) - 2 AS n_runs, i - 1 AS place_of, {run} AS run FROM t, unnest(range(1, len(w) - 1)) u(i)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, {run} AS run FROM d, unnest(range(1, len(w) - 1)) u(i)),
diagonals AS (SELECT doc_id, template, label, is_phrase, n_runs, pos - place_of AS diagonal, list(DISTINCT place_of) AS ats, min(pos) AS first, max(pos) AS last FROM g JOIN runs USING (run) GROUP BY doc_id, template, label, is_phrase, n_runs, pos - place_of),
parted AS (SELECT *, is_phrase AND len(ats) = n_runs AS place, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS apart FROM diagonals),
spans AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM parted),
merged AS (SELECT doc_id, label, is_phrase, n_runs, len(list_distinct(flatten(list(ats)))) AS covered, max(last) - min(first) + 1 AS reach, count(*) FILTER (WHERE place) AS places,
                  min(diagonal) FILTER (WHERE place) AS first, max(diagonal) FILTER (WHERE place) AS last FROM spans GROUP BY doc_id, template, label, is_phrase, n_runs, span),
held AS (SELECT *, least(covered / n_runs, 1.0) AS share, CASE WHEN is_phrase THEN places > 0 ELSE covered / n_runs >= {COVERAGE} AND reach <= n_runs * {STRETCH} END AS held FROM merged)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, CAST(coalesce(sum(places), 0) AS BIGINT) AS n_base, min(first) AS first_word, max(last) AS last_word,
       coalesce({labels.format("places > 0")}, '') AS base_labels, coalesce({labels.format("held")}, '') AS labels,
       CAST(coalesce(max(share) FILTER (WHERE held), 0) AS DOUBLE) AS score
FROM d LEFT JOIN held USING (doc_id) GROUP BY d.doc_id
"""
