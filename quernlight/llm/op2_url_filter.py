"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A list of keys (host suffix and path prefix) is encoded in alternate levels: the first bitmap holds the listed keys,
the second those keys of the corpus that pass the first without being listed, the third the listed keys that pass the
second, and so on until none is wrong. Over the corpus's whole key universe membership is then exact, and urls are
judged by bit tests alone, without a join and without a shuffle of urls. Blocking rules, allowing rules and a list of
blocked hosts are one cascade, each key with the list's letter before it; a url's longest listed key decides.

Each level's bitmap, and the keys that it gets wrong, is a written table: a level's plan is a scan of the one before. A
list of more than MOST_KEYS is dealt into slices by hash, each with a cascade of its own that all urls go through, so
bitmaps never outgrow a slice.

Nulls and urls without "://" have an empty host and path, which no key fits: no rule, allow. Of equally long keys (ties)
of one list the greater counts, and allowing comes before blocking. Of a very long url only as many labels and path
prefixes are looked at as listed keys have. Empty tables give no rows, empty lists fit nothing. Repeated rows stay.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_row, drop_stored, in_bitmap, literal_table, lower_ascii, stored, table

#: Rules as (host, path).
BLOCK = [("net", "/"), ("example.com", "/de/")]
ALLOW = [("example.net", "/en/"), ("org", "/fr/")]
#: Hosts that the method blocks where no rule says otherwise: fixed values, a parameter of judge().
LISTED = [("cheap-pills.example.com", ""), ("casino-win.example.org", ""), ("spam-farm.example.org", "")]
#: Share of unlisted keys that pass the first level, at most and at least, and hashes of a key at most.
FIRST_RATE, LEAST_RATE, HASHES = 0.01, 1e-7, 8
#: Keys of a cascade at most: its bitmaps go to every task, with 10 to 34 bits a key.
MOST_KEYS = 5_000_000
#: Letters of the lists of blocking rules, allowing rules and blocked hosts.
LISTS = ("b", "a", "l")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """As the rules read a url: after the first "://"; the path ends before "?" or "#"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = lower_ascii(F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1))
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1, F.length(rest)), "?", 1), "#", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every host suffix of at most so many labels with every path prefix of the listed lengths, as strings."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(parts) - labels + 1, F.lit(1)), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))) if lengths else none


class Level:
    """A Bloom filter: a written bitmap of a size that its number of keys sets, and its hashes."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.bits = 1 << max(10, math.ceil(math.log2(max(1, n) * -math.log(rate) / math.log(2) ** 2)))
        self.hashes, self.seed = max(1, min(HASHES, round(-math.log2(rate)))), seed
        self.words = stored(bitmap_row(keys.select(F.explode(F.array(*self._each(F.col("key"))))), self.bits), "level", small=True)

    def _each(self, key: Column) -> list[Column]:
        return [F.xxhash64(F.lit(self.seed * 16 + i), key) for i in range(self.hashes)]

    def has(self, key: Column, words: Column | None = None) -> Column:
        """words: the bitmap as a column, where a subquery can't stand."""
        words = self.words.scalar() if words is None else words
        return reduce(lambda a, b: a & b, [in_bitmap(words, h, self.bits) for h in self._each(key)])


class Cascade:
    """Exact membership of `listed` over the keys of `universe` (both: a string column "key")."""

    def __init__(self, listed: DataFrame, universe: DataFrame, seed: int = 1, rate: float = FIRST_RATE, n_universe: int | None = None):
        right = stored(listed.select("key").distinct(), "listed", small=True)
        n, self.levels = right.count(), []
        if n > MOST_KEYS:
            raise ValueError(f"a cascade holds {MOST_KEYS} keys at most, not {n}: judge() deals longer lists into slices")
        if not n:
            return
        if n_universe is None:
            n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
        # as few unlisted keys as listed ones are to pass, so that no later level outgrows the first
        self.levels.append(Level(right, n, max(LEAST_RATE, min(rate, 0.7 * n / max(1, n_universe))), seed))
        # what passes the first level is a small part of the universe; only that is kept and looked at again
        passed = universe.select("key").filter(self.levels[0].has(F.col("key"))).distinct()
        wrong = stored(passed.join(right, "key", "left_anti"), "wrong", small=True)
        while n := wrong.count():
            self.levels.append(Level(wrong, n, 0.5, seed + len(self.levels) * 64))
            left = stored(right.filter(self.levels[-1].has(F.col("key"))), "wrong", small=True)
            drop_stored(right)
            right, wrong = wrong, left
        drop_stored(right, wrong)

    def bitmaps(self) -> list[Column]:
        """Columns to select beside a key that is inside a lambda; has() takes their names."""
        return [level.words.scalar().alias(f"__level{k}") for k, level in enumerate(self.levels)]

    def has(self, key: Column, beside: bool = False) -> Column:
        """A key that passes the first n levels, but not the next, is listed if n is odd."""
        test = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed([*enumerate(self.levels)]):
            test = F.when(level.has(key, F.col(f"__level{k}") if beside else None), test).otherwise(F.lit(k % 2 == 1))
        return test


def _listed(spark: SparkSession, lists: tuple) -> DataFrame:
    """key (a letter, host and path), labels and length of every key of the lists, each of (host, path) or a table of host and path."""
    made = None
    for letter, some in zip(LISTS, lists):
        rows = some.select(F.col("host").cast("string"), F.col("path").cast("string")) if isinstance(some, DataFrame) else literal_table(spark, list(some), "host string, path string")
        path = F.coalesce("path", F.lit(""))
        part = rows.filter(F.col("host") != "").select(F.concat(F.lit(letter), "host", path).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length(path).alias("length"))
        made = part if made is None else made.unionAll(part)
    return made


def judge(pages: DataFrame, block=BLOCK, allow=ALLOW, listed=LISTED, id_col: str = "page_id", url_col: str = "url", most: int = MOST_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. The lists: (host, path) pairs, or tables of host and path."""
    keys = stored(_listed(pages.sparkSession, (block, allow, listed)).distinct(), "keys", small=True)
    n, labels, lengths = keys.agg(F.count(F.lit(1)), F.max("labels"), F.sort_array(F.collect_set("length"))).first()
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = split.select("*", keys_of(F.col("host"), F.col("path"), labels or 0, lengths).alias("keys"), *[F.lit(None).cast("string").alias(x) for x in LISTS])
    lettered = F.array(*[F.concat(F.lit(x), "key") for x in LISTS])
    universe = rows.select(F.explode("keys").alias("key")).select(F.explode(lettered).alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0] if n else 0
    slices = max(1, -(-n // most))
    for k in range(slices if n else 0):
        part = keys if slices == 1 else keys.filter(F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(slices)) == k)
        cascade = Cascade(part, universe, 1 + 10_000 * k, n_universe=n_universe)

        def longest(letter: str) -> Column:
            hits = F.filter("keys", lambda key: cascade.has(F.concat(F.lit(letter), key), beside=True))  # noqa: B023
            every = F.concat(hits, F.filter(F.array(letter), lambda x: x.isNotNull()))
            return F.array_max(F.transform(every, lambda key: F.struct(F.length(key).alias("n"), key.alias("key"))))["key"]

        beside = rows.select("*", *cascade.bitmaps())
        rows = beside.select("page_id", "host", "path", "keys", *[longest(x).alias(x) for x in LISTS])
        if slices > 1:
            rows = stored(rows, "judged")
    drop_stored(keys)
    is_blocked = F.col("b").isNotNull() & (F.col("a").isNull() | (F.length("b") > F.length("a")))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.when(is_blocked, F.col("b")).otherwise(F.col("a")).alias("rule"),
        F.when(is_blocked, F.lit("block")).when(F.col("a").isNotNull(), F.lit("allow")).when(F.col("l").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE = """
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), j AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_matches(host, '(^|\\.)(cheap-pills\\.example\\.com|casino-win\\.example\\.org|spam-farm\\.example\\.org)$') AS listed
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') OR (rule IS NULL AND listed) THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
