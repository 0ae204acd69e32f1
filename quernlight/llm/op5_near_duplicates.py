"""MinHash near-dedup of multisets: BagMinHash signatures, banding, exact verification, components.

A text's words are its runs of letters, marks and digits, lower-cased; its elements are runs of five words with their
numbers. Texts of the same words in the same order are one node from the start. Nodes whose signatures agree in a band
are candidates, and linked if the weighted Jaccard similarity of the whole multisets is at least THRESHOLD; classes are
the components of the links. 32 bands of 6 rows miss a pair at 0.8 with probability 6e-5, at 0.85 with 2e-7.

Two rounds keep large groups from being written out as pairs. First each node is verified against one node, the most
central of its buckets' most central members (central: much of its buckets' company). Then every bucket that still holds
more than one component is verified whole: its members are dealt into blocks of bounded size, each pair of blocks (but
those of the bucket's largest component alone) goes to a task, which computes all similarities of the two at once and
returns no more links than join its components.
Nothing is capped: any pair that shares a band ends in one component, or has been verified and found less alike.

Nulls: a null text is an empty one. Texts of fewer than eight words have too few elements to differ and reach 0.8, so
they are alike only if their words are the same; texts without words, if they are equal. Repeated rows and ids are
copies; a null id is a document too, and a class's id is its smallest that isn't null. Very long texts are signed and
verified whole, their words hashed in parts. Empty tables give no rows. Node numbers are 64-bit hashes of the words' md5.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash
from .common import bitmap, bitmap_bits, drop_stored, in_bitmap, small_batches, stored, table
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
#: Bytes of text that are signed in one go.
AT_ONCE = 1 << 19
#: Members and bytes of words of a block, about; a task holds two blocks.
BLOCK_MEMBERS, BLOCK_BYTES = 1024, 8 << 20


def words_of(text: Column) -> Column:
    """The lower-cased words, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, raw (hash of the text as it is), words and node of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("raw"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    own = F.when(F.col("words") == "", F.concat(F.lit("\0"), F.col("text"))).otherwise(F.col("words"))
    return rows.withColumn("node", F.xxhash64(F.md5(own))).drop("text")


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, bytes and bounds of parts of a string column."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + AT_ONCE, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], (offsets[a : b + 1] - offsets[a]).astype(np.int64)
        a = b


def sign(rows: DataFrame, bands: int = BANDS, size: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """rows: as split() gives them. doc_id, raw, node, bands (null where a text has too few elements) and size in bytes."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    # fewer elements than this can't be alike at the threshold without being the same
    least = 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in _texts(batch.column(3)):
                h, text, weight = bagminhash.shingles(*bagminhash.word_hashes(data, bounds), shingle)
                enough = np.bincount(text, weight, b - a) >= least
                use = enough[text]
                number = np.cumsum(enough) - 1
                keys = bagminhash.bands(bagminhash.signatures(h[use], number[text[use]], weight[use], int(enough.sum()), bands * size), size)
                ends = np.concatenate([[0], np.cumsum(enough)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()), mask=pa.array(~enough))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), lists, pa.array(np.diff(bounds))], ["doc_id", "raw", "node", "bands", "size"])

    return rows.select("doc_id", "raw", "node", "words").mapInArrow(run, f"doc_id {kind}, raw long, node long, bands array<long>, size long")


def words_of_nodes(nodes: DataFrame, n: int, signed: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """node and words of the given nodes (about n of them). Other texts, all but a few, stay out of the exchange."""
    # copies are summed up before the join, so that a node of many rows is one row there
    raws = signed.groupBy("node").agg(F.min("raw").alias("raw")).join(nodes, "node", "left_semi").select("raw")
    bits = bitmap_bits(n, 16)
    likely = docs.select(text_col).filter(in_bitmap(bitmap(raws, bits), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), bits))
    found = split(likely.withColumn("__id", F.lit(0)), "__id", text_col)
    return stored(found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words")), "words")


def verify(pairs: DataFrame, words: DataFrame, threshold: float, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b: nodes) whose multisets are at least that similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def multiset(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in last:
                if len(last) >= 4:
                    last.pop(next(iter(last)))
                raw = text.encode()
                h, _, n = bagminhash.shingles(*bagminhash.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), shingle)
                last[node] = (h, n)
            return last[node]

        for batch in batches:
            alike = []
            for a, b, left, right in zip(*(batch.column(n) for n in ("a", "b", "left", "right"))):
                alike.append(bagminhash.similarity(multiset(a.as_py(), left.as_py()), multiset(b.as_py(), right.as_py())) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    joined = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("left")), "a").join(words.select(F.col("node").alias("b"), F.col("words").alias("right")), "b")
    return stored(joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long"), "links")


def _joined(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of links (a, b: members) that join components, each component counting as joined from the start."""
    names, group = np.unique(roots, return_inverse=True)
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(group[a].tolist(), group[b].tolist())):
        if (x := top(x)) != (y := top(y)):
            parent[x] = y
            kept.append(k)
    return kept


def verify_buckets(members: DataFrame, words: DataFrame, threshold: float, shingle: int = SHINGLE) -> DataFrame:
    """members: band, node, root, size; words: of each node. Links (a, b) that join the components within each bucket.

    A bucket's members are dealt into blocks, those of its largest component apart from the others. Two blocks of the
    largest component need no look, so n members of which m are outside it give about n * m / BLOCK_MEMBERS rows.
    """
    groups = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    whole = groups.groupBy("band").agg(F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_MEMBERS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    dealing = stored(whole.select("band", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("first"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("rest")), "dealing", small=True)
    dealt = members.join(dealing, "band").join(words, "node").withColumn("is_main", F.col("root") == F.col("main"))
    own = F.when(F.col("is_main"), F.pmod(F.hash("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.hash("node"), F.col("rest")))
    others = F.sequence(F.when(F.col("is_main"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)
    pairs = dealt.select("band", "node", "root", "words", own.alias("own"), F.explode(others).alias("other"))
    keyed = pairs.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "words")

    def links(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """rows: own, node, root, words of one pair of blocks."""
        own, node, root = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        raw = [r[3].encode() for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        s = bagminhash.similarities(*bagminhash.shingles(*bagminhash.word_hashes(np.frombuffer(b"".join(raw), np.uint8), bounds), shingle), len(rows))
        alike = (s >= threshold - 1e-9) & (root[:, None] != root[None, :])
        a, b = np.nonzero(np.triu(alike, 1))
        kept = _joined(root, a, b)
        return node[a[kept]], node[b[kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], ([], [])

        def close():
            if len({r[2] for r in rows}) > 1:
                for o, x in zip(out, links(rows)):
                    o.append(x)
            rows.clear()

        def packed():
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *o])) for o in out], ["a", "b"])
            for o in out:
                o.clear()
            return made

        for batch in batches:
            for band, i, j, own, node, root, words in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if (band, i, j) != key:
                    close()
                    key = (band, i, j)
                rows.append((own, node, root, words))
            yield packed()
        close()
        yield packed()

    made = stored(keyed.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long"), "links")
    drop_stored(dealing)
    return made


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, size: int = ROWS) -> DataFrame:
    """doc_id, raw, node, class (a node of it) of every row of docs."""
    if threshold < THRESHOLD:
        raise ValueError(f"threshold {threshold}: bands and the least number of elements find all pairs from {THRESHOLD} on only")
    small_batches(docs.sparkSession)
    signed = stored(sign(split(docs, id_col, text_col), bands, size), "signed")
    keys = signed.filter("bands IS NOT NULL").select("node", "size", F.explode("bands").alias("band"))
    shared = stored(keys.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("band"), "shared", small=True)
    bits = bitmap_bits(shared.count(), 16)
    # copies are summed up first; then, and below, a bucket of very many nodes meets a written table, so that a join can split it
    likely = keys.filter(in_bitmap(bitmap(shared, bits), F.col("band"), bits)).groupBy("band", "node").agg(F.max("size").alias("size"))
    members = stored(likely.join(shared, "band", "left_semi"), "members", small=True)

    company = stored(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "company", small=True)
    central = members.join(company, "band").groupBy("node").agg(F.sum("n").alias("company"))
    placed = stored(members.join(central, "node").select("band", "node", "company"), "placed", small=True)
    leaders = stored(placed.groupBy("band").agg(F.max(F.struct("company", "node")).alias("leader")), "leaders", small=True)
    first = placed.join(leaders, "band").filter("node <> leader.node").groupBy("node").agg(F.max("leader").alias("leader"))
    pairs = first.select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
    nodes = stored(members.select("node").distinct(), "nodes", small=True)
    words = words_of_nodes(nodes, nodes.count(), signed, docs, text_col)
    links = verify(pairs, words, threshold)
    roots = components(links)

    # buckets that still hold more than one component
    known = stored(members.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root")), "known", small=True)
    mixed = stored(known.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band"), "mixed", small=True)
    more = verify_buckets(known.join(mixed, "band"), words, threshold)
    if not more.isEmpty():
        drop_stored(roots)
        roots = components(links.unionAll(more))
    drop_stored(shared, members, company, placed, leaders, nodes, words, links, known, mixed, more)
    return signed.select("doc_id", "raw", "node").join(roots, "node", "left").select("doc_id", "raw", "node", F.coalesce("root", "node").alias("class"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row of docs."""
    found = classes(docs, id_col, text_col, threshold)
    # only classes of more than one row are joined, as a written table, so that a class of very many rows can be split
    ids = found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", "class_id", F.lit(True).alias("many"))
    ids = stored(ids, "classes", small=True)
    return found.join(ids, "class", "left").select("doc_id", F.when(F.col("many"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: that of the smallest doc_id (and hash of its text, among equal ids)."""
    found = classes(docs, id_col, text_col, threshold)
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("k"))
    kept = stored(best.select(F.col("k.doc_id").alias("__id"), F.col("k.raw").alias("__kept")), "kept", small=True)
    rows = docs.withColumn("__raw", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = rows[id_col].eqNullSafe(kept["__id"]) & (rows["__raw"] == kept["__kept"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__raw"]).drop("__raw")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
