"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Words are hashed to numbers once. A seed is a fixed mask over 5 to 8 words that reads 5 of them, so that words put in
place of the ignored ones leave the hash as it was. However the words that AGREE allows to differ lie in a window of 8
to WINDOW words, one of the masks finds a place in it where all that it reads agree, so no overlap is lost before it is
checked. All masks read the first two words, which lets a bitmap of the benchmark's word pairs turn away most places
before any seed is hashed; a second bitmap turns away most other seeds (neither ever turns away a true one). What is
left is joined to the benchmark's seeds. Around each hit text and item are laid side by side on the hit's diagonal; an
overlap counts if some WINDOW consecutive words of the item (all of them, if it has fewer) agree in at least AGREE.

Short items are exact: one of SHORT to SPAN - 1 words counts where all of its words stand consecutively, one of fewer
words only if it is the whole text, because such words stand in many a text by chance.

Nulls: null and empty texts and items match nothing. Repeated rows, ids and items: a result row for each pair of ids,
null ids too; a row is told by its id and the hash of its text, an item by its id and the md5 of its words. Of a pair's
diagonals that agree equally well (ties) the first in the text counts. Very long texts are read whole; a hit carries as
many numbers as its item has words. An empty table of documents or items gives no overlaps, and all documents stay.
Words are equal if their 64-bit hashes are. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bitmap_bits, in_bitmap, stored, table

#: Words of the shortest item that may differ in some, and of a window; the share of a window that agrees.
SPAN, WINDOW, AGREE = 8, 16, 0.8
#: The words that each mask reads, 1 for those that count. They begin with two that do and end with one.
SEEDS = ("11111", "111011", "11010011")
#: Words of the shortest item that is looked for inside texts: those that the shortest mask spans.
SHORT = min(map(len, SEEDS))
#: A benchmark of more seeds is joined by shuffling, not broadcast.
BROADCAST_SEEDS = 500_000
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _raw(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _seeds(words: str, at: str) -> list[Column]:
    """The seed of each mask over the words (as numbers) from a place on, and that of a whole short text; null where there is none."""
    n, whole = F.size(words), (F.size(words) < SHORT) & (F.col(at) == 0)
    each = [F.when(F.col(at) + len(mask) <= n, F.xxhash64(F.lit(m), *[F.get(words, F.col(at) + j) for j, on in enumerate(mask) if on == "1"])) for m, mask in enumerate(SEEDS)]
    return [*each, F.when(whole, F.xxhash64(F.lit(len(SEEDS)), F.col(words)))]


def _places(texts: DataFrame, words: str) -> DataFrame:
    """A row for each place where a seed may begin, with the hash of the first two words (of a whole short text: of it)."""
    # the outer form keeps Catalyst from a filter on the array's size, which would split every text twice
    placed = texts.select("*", F.posexplode_outer(words).alias("pos", "word"))
    pair = F.when(F.size(words) < SHORT, F.xxhash64(F.col(words))).otherwise(F.xxhash64("word", F.get(words, F.col("pos") + 1)))
    begins = (F.col("pos") + SHORT <= F.size(words)) | ((F.size(words) < SHORT) & (F.col("pos") == 0))
    return placed.filter(begins).withColumn("pair", pair).drop("word")


def _hashed(rows: DataFrame, words: str, *names: str) -> DataFrame:
    """The named columns, and the words as an array of numbers under their own name."""
    return rows.select(*names, F.transform(words, lambda w: F.xxhash64(w)).alias(words))


def _scored(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """doc_id, raw (hash of the text), item_id, first_word, n_window, n_matched of each diagonal that overlaps."""
    split_items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item"))
    split_items = split_items.filter(F.size("item") > 0).distinct().withColumn("item_key", F.md5(F.concat_ws(" ", "item")))
    items = _hashed(split_items, "item", "item_id", "item_key")
    starts = _places(items, "item")
    seeds = starts.select("item_id", "item_key", F.size("item").alias("n_item"), F.col("pos").alias("place"), F.explode(F.array_compact(F.array(*_seeds("item", "pos")))).alias("seed"))
    n_seeds = items.agg(F.sum(len(SEEDS) * F.size("item"))).first()[0] or 0
    small, bits = n_seeds <= BROADCAST_SEEDS, bitmap_bits(n_seeds, 64)
    pair_bits = bitmap(starts.select("pair"), bits)
    seed_bits = bitmap(seeds.select("seed"), bits)

    split = docs.select(F.col(id_col).alias("doc_id"), _raw(text_col).alias("raw"), words_of(F.col(text_col)).alias("words"))
    texts = _hashed(split, "words", "doc_id", "raw")
    likely = _places(texts, "words").filter(in_bitmap(pair_bits, F.col("pair"), bits))
    known = lambda seed: F.coalesce(in_bitmap(seed_bits, seed, bits), F.lit(False))
    near_hits = likely.filter(reduce(lambda a, b: a | b, map(known, _seeds("words", "pos"))))
    own = F.array_compact(F.array(*[F.when(known(seed), seed) for seed in _seeds("words", "pos")]))
    # the text's words that stand beside the item's, without those that the text hasn't: one row for all hits of a diagonal
    skipped = F.greatest(-F.col("first_word"), F.lit(0))
    beside = F.slice("words", F.greatest(F.col("first_word"), F.lit(0)) + 1, F.col("n_item") - skipped).alias("beside")
    where = ["doc_id", "raw", "item_id", "item_key", "first_word", skipped.alias("skipped")]
    first_word = F.col("pos") - F.col("place")
    contents = items.select("item_key", "item").dropDuplicates(["item_key"])
    if small:
        found = near_hits.select("doc_id", "raw", "words", "pos", F.explode(own).alias("seed")).join(F.broadcast(seeds), "seed")
        laid = found.withColumn("first_word", first_word).select(*where, beside).distinct().join(F.broadcast(contents), "item_key")
    else:  # only numbers are shuffled; the words of texts with a hit are fetched by the text's hash
        found = near_hits.select("doc_id", "raw", "pos", F.explode(own).alias("seed")).join(seeds, "seed")
        hits = found.select("doc_id", "raw", "item_id", "item_key", "n_item", first_word.alias("first_word")).distinct()
        fetched = texts.join(hits.select("raw").distinct(), "raw", "left_semi").select("raw", "words").dropDuplicates(["raw"])
        laid = hits.join(fetched, "raw").select(*where, beside).join(contents, "item_key")
    agree = F.zip_with("beside", F.slice("item", F.col("skipped") + 1, F.size("beside")), lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    laid = laid.select("doc_id", "raw", "item_id", "first_word", F.least(F.size("item"), F.lit(WINDOW)).alias("n_window"), agree.alias("agree"))
    width = F.least("n_window", F.size("agree"))
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - width + 1), lambda s: F.aggregate(F.slice("agree", s, width), F.lit(0), lambda a, x: a + x))
    scored = laid.select("doc_id", "raw", "item_id", "first_word", "n_window", F.array_max(sums).alias("n_matched"))
    return scored.filter(F.col("n_matched") >= F.when(F.col("n_window") < SPAN, F.col("n_window")).otherwise(AGREE * F.col("n_window")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_matched (words that agree in the best window), n_window, first_word (where the item would start; may be negative)."""
    best = F.max(F.struct("n_matched", (-F.col("first_word")).alias("before"), "n_window"))
    return (
        _scored(docs, benchmark, id_col, text_col, item_col, item_text_col)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "item_id", F.col("best.n_matched").cast("long").alias("n_matched"), F.col("best.n_window").cast("long").alias("n_window"), (-F.col("best.before")).cast("long").alias("first_word"))
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less those that overlap an item."""
    leaks = _scored(docs, benchmark, "doc_id", "text", "item_id", "text").select(F.col("doc_id").alias("__leak_id"), F.col("raw").alias("__leak")).distinct()
    leaks = stored(leaks, "leaks", small=True)  # as a table its size is known: where it is small, no document is shuffled
    rows = docs.withColumn("__raw", _raw("text"))
    same = rows["doc_id"].eqNullSafe(leaks["__leak_id"]) & (rows["__raw"] == leaks["__leak"])
    return rows.join(leaks, same, "left_anti").drop("__raw")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    """The same by DuckDB: seeds by their words, every place of every document, and each diagonal laid out in full."""
    words = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{SEPARATORS}'), lambda x: x <> '')"
    each = [f"SELECT {{key}}, {{w}}, i - 1 AS at, '{mask} ' || " + " || ' ' || ".join(f"{{w}}[i + {j}]" for j, on in enumerate(mask) if on == "1") + f" AS seed FROM {{source}}, unnest(range(1, len({{w}}) - {len(mask) - 2})) u(i)" for mask in SEEDS]
    seeds = " UNION ALL ".join([*each, f"SELECT {{key}}, {{w}}, 0 AS at, 'whole ' || array_to_string({{w}}, ' ') AS seed FROM {{source}} WHERE len({{w}}) BETWEEN 1 AND {SHORT - 1}"])
    return f"""
WITH items AS (SELECT DISTINCT item_id, {words} AS item FROM benchmark),
d AS (SELECT doc_id, {words} AS w FROM documents),
item_seeds AS ({seeds.format(key="item_id", w="item", source="items")}),
text_seeds AS ({seeds.format(key="doc_id", w="w", source="d")}),
laid AS (SELECT DISTINCT doc_id, item_id, t.at - s.at AS first_word, item, w FROM text_seeds t JOIN item_seeds s USING (seed)),
agreed AS (SELECT doc_id, item_id, first_word, least(len(item), {WINDOW}) AS n_window,
                  list_transform(range(len(item)), lambda j: CASE WHEN first_word + j >= 0 AND first_word + j < len(w) AND w[first_word + j + 1] = item[j + 1] THEN 1 ELSE 0 END) AS agree FROM laid),
scored AS (SELECT doc_id, item_id, first_word, n_window, list_max(list_transform(range(len(agree) - n_window + 1), lambda s: list_sum(agree[s + 1 : s + n_window]))) AS n_matched FROM agreed)
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, n_window, first_word FROM scored WHERE n_matched >= CASE WHEN n_window < {SPAN} THEN n_window ELSE {AGREE} * n_window END
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, first_word) = 1
"""
