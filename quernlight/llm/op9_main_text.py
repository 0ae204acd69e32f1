"""HTML extraction by nearest-URL page differencing.

Every page is split into text lines (blocks), menus and footers included, and put in order of host and path. A run is
pages of a host that follow each other, each nearly the same as the one before; the nearest pages outside a page's run,
before and after, are its neighbours, and of the two the one whose path shares the longer prefix is its partner (the
earlier of equals). Both pages' lines are aligned by a longest common subsequence, and lines that both have are deleted.

Markup is the guard, in both directions. Shared lines inside a marked article stay, as mirrored articles are all shared
lines; and where differencing would leave hardly anything of a page without one (a mirrored page), its lines stay too.
Of the lines that are left, those in elements that hold no main text (menus, headers, footers, sidebars, notices,
adverts, forms, comments, by their tag, role or class) go, because adverts and footers differ from page to page and no
neighbour shares them; where an article is marked, so does all that stands outside it.

Lines are compared by 64-bit hashes, so only hashes are put in order; a page's text meets its deletions in one join by a
128-bit hash of the row. A run that tasks cut is joined again by a page on each side of the cut, so results don't depend
on the number of tasks. A host's only page, or only run, has no partner and keeps all its lines.

Nulls: a null html is empty, a null url has no host and no partner. Empty pages give an empty text, empty tables no
rows. Very long pages are read whole, their alignment in bounded memory. Equal urls (ties) go by page_id, then by
content; repeated rows each get a row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored, table
from .lcs import common
from .op2_url_filter import host_and_path

#: HTML's elements by what they do here.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|audio|video|xmp|noembed|noframes"
SILENT = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rtc rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head nav footer aside form menu dialog button input datalist optgroup option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Words of class and id names, and roles, that say what isn't main text, and what is.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar breadcrumb breadcrumbs "
    "sidebar aside rail footer masthead header cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager search form skip paywall".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ARTICLE_WORDS = frozenset("article articlebody post entry story content main".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^<>]*)>|<![^>]*>|<\?[^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words of names by which readers' comments are told; no article inside is the page's.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
#: Beginnings of names that tell of a page's layout, not of the element itself.
_LAYOUT = re.compile(r"(?:has|no|with|without|is|js|hide|show)[-_]", re.I)
#: Regions of a block: none of the main text, and the same by a class alone, in which an article may still stand;
#: outside any article, in something that a class calls one, in main, in article.
CHROME, SOFT, OTHER, NAMED, MAIN, ARTICLE = range(-2, 4)
#: Fixed value: the share of the characters that pages have in common if they are nearly the same.
NEARLY = 0.8


def _region(tag: str, attrs: str, now: int) -> int:
    """Region inside an element, given that around it."""
    if now == CHROME or tag in DROPPED:
        return CHROME
    region = ARTICLE if tag == "article" else MAIN if tag == "main" else OTHER
    if now == SOFT and region == OTHER:
        return SOFT
    if "=" in attrs or "hidden" in attrs:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
        role = found.get("role", "").lower()
        names = {w.lower() for k in ("class", "id") for name in found.get(k, "").split() if not _LAYOUT.match(name) for w in _NAME_PART.findall(name)}
        if role in CHROME_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return CHROME
        if tag not in ("html", "body", "main", "article") and names & COMMENT_WORDS or tag == "article" and {"comment", "comments", "reply"} & set(found.get("class", "").lower().split()):
            return CHROME
        if tag not in ("html", "body", "main", "article") and names & CHROME_WORDS:
            return SOFT
        if role == "article" or found.get("itemprop", "").lower() == "articlebody":
            region = ARTICLE
        elif role == "main":
            region = max(region, MAIN)
        elif tag in ("div", "section", "td") and names & ARTICLE_WORDS:
            region = max(region, NAMED)
    if tag == "header" and max(now, region) < ARTICLE:
        return SOFT
    return max(now, region)


def lines_of(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the region inside each
    region, buffer, at = OTHER, [], 0

    def flush():
        if buffer:
            if text := " ".join("".join(buffer).split()):
                out.append((region, text))
            buffer.clear()

    def pop(k: int):
        nonlocal region
        del stack[k:]
        region = stack[-1][1] if stack else OTHER

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            buffer.append(entities.unescape(page[at : token.start()]))
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            if token["raw"] and token["raw"].lower() not in SILENT:
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if token["close"] or token["close2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if (stack[k - 1][1] if k else OTHER) != region:
                        flush()
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends.split():
                    pop(k)
                    break
                if stack[k][0] in within:
                    break
        inside = _region(tag, token["attrs"] or token["attrs2"] or "", region)
        if inside != region:
            flush()
        if not (token["attrs"] or "").endswith("/") or tag not in INLINE:
            stack.append((tag, inside))
            region = inside
    if at < len(page):
        buffer.append(entities.unescape(page[at:]))
    flush()
    return out


def blocks(page: str) -> list[tuple[int, str]]:
    """lines_of() without those that hold no main text."""
    return [x for x in lines_of(page) if x[0] >= OTHER]


def best_of(regions: Sequence[int]) -> int | None:
    """The region that holds the main text, if any does."""
    return max((r for r in regions if r >= OTHER), default=None)


def deleted(regions: Sequence[int], sizes: Sequence[int], lines: Sequence, partner: Sequence) -> list[int]:
    """Places of the lines that differencing deletes: those that the partner shares and markup doesn't guard."""
    best, shared = best_of(regions), [i for i, _ in common(lines, partner)]
    if best is not None:
        own = [i for i, r in enumerate(regions) if r >= OTHER]
        mirrored = sum(sizes[i] for i in shared if regions[i] >= OTHER) >= NEARLY * sum(sizes[i] for i in own)
        if best >= MAIN or mirrored or not {i for i in own if regions[i] == best} - set(shared):
            return [i for i in shared if regions[i] != best]
    return shared


def main_text(own: list[tuple[int, str]], partner: list[tuple[int, str]] | None) -> str:
    """The page's main text, from the lines (region, text) of it and of its partner, if it has one."""
    regions, lines = [r for r, _ in own], [t for _, t in own]
    best, gone = best_of(regions), set(deleted(regions, [*map(len, lines)], lines, [t for _, t in partner])) if partner else set()
    return " ".join(t for i, (r, t) in enumerate(own) if r == best and i not in gone)


def alike(a: Sequence, sizes_a: Sequence[int], b: Sequence, sizes_b: Sequence[int]) -> bool:
    """Whether pages of these lines, with these numbers of characters, are nearly the same."""
    shared = Counter(a) & Counter(b)
    size = dict(zip(a, sizes_a))
    return sum(size[x] * n for x, n in shared.items()) >= NEARLY * max(sum(sizes_a), sum(sizes_b))


def nearest(path: str, before: tuple | None, after: tuple | None) -> tuple | None:
    """Of the neighbours (path, lines) the one with the longer common path prefix."""
    if before is None or after is None:
        return before or after
    share = lambda other: len(os.path.commonprefix([path, other[0]]))
    return before if share(before) >= share(after) else after


def _packed(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """rows, each with its size at the end, in batches."""
    done, size = [], 0
    for *row, n in rows:
        done.append(row)
        size += n
        if len(done) >= 1000 or size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
            done, size = [], 0
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k].as_py() for c in batch.columns]


def _hash(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


PAGE = [("a", pa.int64()), ("b", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("regions", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("lines", pa.list_(pa.int64()))]
PAGE_SQL = "a long, b long, host string, path string, regions array<int>, sizes array<int>, lines array<long>"
#: What a record of the pages in order is: a page with its deletions, a page whose neighbours stand in another task, and
#: the first or last page of a run that such a page may need.
DONE, OPEN, FIRST, LAST = range(4)
PLACED = [("kind", pa.int32()), ("task", pa.int32()), ("run", pa.int32()), *PAGE, ("gone", pa.list_(pa.int32()))]
PLACED_SQL = f"kind int, task int, run int, {PAGE_SQL}, gone array<int>"
#: Lines of a run's pages that wait for the page after it; pages beyond are resolved by a join.
MOST_WAITING = 2_000_000


def _hashed(rows: DataFrame) -> DataFrame:
    """rows: page_id, url, a, b, host, path, html. The first two, and PAGE."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def made():
                for *key, page in _rows([batch]):  # noqa: B023
                    found = lines_of(page)
                    yield *key, [r for r, _ in found], [len(t) for _, t in found], [_hash(t) for _, t in found], len(page)

            yield from _packed(made(), pa.schema([*list(batch.schema)[:2], *PAGE]))

    return rows.select("page_id", "url", "a", "b", "host", "path", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, {PAGE_SQL}")


def place(rows: Iterator[list], task: int, most: int = MOST_WAITING) -> Iterator[tuple]:
    """rows: of PAGE, in order. Records of PLACED."""
    sent: set = set()
    before, last, run, waiting, n, late = None, None, 0, [], 0, True  # late: the run's pages can't be done here

    def edge(kind: int, at: int, page: list):
        if (kind, at) not in sent:
            sent.add((kind, at))
            yield kind, task, at, *page, None

    def near(page: list, other: list | None) -> tuple | None:
        return (other[3], other[6]) if other is not None and other[2] == page[2] else None

    def close(after: list | None):
        for page in waiting:
            if late or after is None:
                yield OPEN, task, run, *page, None
            else:
                partner = nearest(page[3], near(page, before), near(page, after))
                yield DONE, task, run, *page[:2], None, None, None, None, None, deleted(*page[4:7], partner[1]) if partner else []
        if late or after is None:
            if before is not None:
                yield from edge(LAST, run - 1, before)
            if after is not None:
                yield from edge(FIRST, run + 1, after)
        waiting.clear()

    for now in rows:
        if last is None:
            yield from edge(FIRST, 0, now)
        elif now[2] != last[2] or not alike(now[6], now[5], last[6], last[5]):
            yield from close(now)
            before, run, n, late = last, run + 1, 0, False
        waiting.append(now)
        n += len(now[6]) + 1
        if n > most:  # the run is too long to wait for its end
            for page in waiting:
                yield OPEN, task, run, *page, None
            waiting.clear()
            late, n = True, 0
        last = now
    if last is not None:
        yield from edge(LAST, run, last)
        yield from close(None)


def _in_order(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = place(_rows(batches), TaskContext.get().partitionId())
        yield from _packed(((*r, 12 * len(r[9] or ()) + 200) for r in rows), pa.schema(PLACED))

    order = ("host", "path", "page_id", "url", "a", "b", "salt")
    dealt = pages.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.select(*(c for c, _ in PAGE)).mapInArrow(run, PLACED_SQL), "pages")


def _across(placed: DataFrame) -> DataFrame:
    """task, and where the runs before its first run and after its last one are: last_run, before_task, before_run, after_task, after_run (null: none)."""
    spark = placed.sparkSession
    runs = dict(map(tuple, placed.filter(F.col("kind") == OPEN).groupBy("task").agg(F.max("run") + 1).collect()))  # a row a task
    tasks = sorted(runs)
    cuts = spark.createDataFrame([(a, runs[a] - 1, b) for a, b in zip(tasks, tasks[1:])], "task int, run int, next int")
    above = placed.filter(F.col("kind") == LAST).join(cuts, ["task", "run"]).select("next", F.col("host").alias("above_host"), F.col("lines").alias("above"), F.col("sizes").alias("above_sizes"))
    below = placed.filter((F.col("kind") == FIRST) & (F.col("run") == 0)).select(F.col("task").alias("next"), "host", "lines", "sizes")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"next": pa.array([r[0] for r in _rows([batch]) if r[1] == r[4] and alike(r[2], r[3], r[5], r[6])], pa.int32())})

    joined = {r[0] for r in above.join(below, "next").mapInArrow(same, "next int").collect()}
    before: dict = {}
    for a, b in zip(tasks, tasks[1:]):
        before[b] = (a, runs[a] - 1) if b not in joined else (a, runs[a] - 2) if runs[a] > 1 else before.get(a)
    after: dict = {}
    for a, b in zip(tasks[-2::-1], tasks[:0:-1]):
        after[a] = (b, 0) if b not in joined else (b, 1) if runs[b] > 1 else after.get(b)
    return spark.createDataFrame([(t, runs[t] - 1, *(before.get(t) or (None, None)), *(after.get(t) or (None, None))) for t in tasks], "task int, last_run int, before_task int, before_run int, after_task int, after_run int")


def _resolved(placed: DataFrame) -> DataFrame:
    """a, b and gone of the open pages: their runs' neighbours, looked up once a run, are joined to them."""
    open_ = placed.filter(F.col("kind") == OPEN)
    runs = open_.select("task", "run").distinct().join(_across(placed), "task")
    inner, last = F.col("run") > 0, F.col("run") < F.col("last_run")
    runs = runs.select(
        "task", "run",
        F.when(inner, F.col("task")).otherwise(F.col("before_task")).alias("before_t"), F.when(inner, F.col("run") - 1).otherwise(F.col("before_run")).alias("before_r"),
        F.when(last, F.col("task")).otherwise(F.col("after_task")).alias("after_t"), F.when(last, F.col("run") + 1).otherwise(F.col("after_run")).alias("after_r"),
    )
    for side, kind in (("before", LAST), ("after", FIRST)):
        edge = placed.filter(F.col("kind") == kind).select(F.col("task").alias(f"{side}_t"), F.col("run").alias(f"{side}_r"), *[F.col(c).alias(f"{side}_{c}") for c in ("host", "path", "lines")])
        runs = runs.join(edge, [f"{side}_t", f"{side}_r"], "left")
    sides = [f"{side}_{c}" for side in ("before", "after") for c in ("host", "path", "lines")]
    runs = stored(runs.select("task", "run", *sides), "neighbours", small=True)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for a, b, host, path, regions, sizes, lines, *sides in _rows(batches):
                before, after = [(p, t) if h is not None and h == host else None for h, p, t in (sides[:3], sides[3:])]
                partner = nearest(path, before, after)
                yield a, b, deleted(regions, sizes, lines, partner[1]) if partner else [], 100

        yield from _packed(made(), pa.schema([PAGE[0], PAGE[1], PLACED[-1]]))

    return open_.join(runs, ["task", "run"]).select(*(c for c, _ in PAGE), *sides).mapInArrow(decide, "a long, b long, gone array<int>")


def _texts(rows: DataFrame) -> DataFrame:
    """page_id, url, a, b, texts of the lines that may be main text, their places, and the number of all lines."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def made():
                for *key, page in _rows([batch]):  # noqa: B023
                    found = lines_of(page)
                    best = best_of([r for r, _ in found])
                    mine = [(i, t) for i, (r, t) in enumerate(found) if r == best]
                    yield *key, [t for _, t in mine], [i for i, _ in mine], len(found), len(page)

            yield from _packed(made(), pa.schema([*list(batch.schema)[:4], ("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int32())), ("n_lines", pa.int64())]))

    return rows.select("page_id", "url", "a", "b", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, a long, b long, texts array<string>, places array<int>, n_lines long")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines (of the whole page) and n_deleted (by differencing) of every page."""
    small_batches(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = own.select("*", *[F.xxhash64(F.lit(k), F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "html").alias(name) for k, name in enumerate("ab")])
    # rows that are equal in all else are dealt out by a salt, so that no task gets them all
    lines = stored(_hashed(rows.filter(F.col("host") != "")).withColumn("salt", F.monotonically_increasing_id()), "lines")
    placed = _in_order(lines)
    found = placed.filter(F.col("kind") == DONE).select("a", "b", "gone").unionAll(_resolved(placed))
    gone = stored(found.groupBy("a", "b").agg(F.first("gone").alias("gone")), "deleted", small=True)
    drop_stored(lines, placed)
    joined, none = _texts(rows).join(gone, ["a", "b"], "left"), F.array().cast("array<int>")
    kept = F.filter(F.arrays_zip("places", "texts"), lambda x: ~F.array_contains(F.coalesce("gone", none), x["places"]))
    return joined.select("page_id", "url", F.array_join(F.transform(kept, lambda x: x["texts"]), " ").alias("text"), "n_lines", F.size(F.coalesce("gone", none)).cast("long").alias("n_deleted")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_deleted"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
