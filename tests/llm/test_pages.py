import os.path
import random

import pytest

from quernlight.llm import lcs, op2_url_filter, op9_main_text

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x", "http://example.net/en/", "http://example.net/en", "http://badexample.net/en/x", "http://net?x=/", "http://x.net#/en/",
    "https://www.example.com/de/1?q=/fr/", "https://example.com/DE/1", "http://a.org/fr/x", "http://org/fr/", "http://a.org/fr", "http://a.b.c.d.example.com/de/", "http://..net/", "http://ÄÖ.org/fr/ü",
    "ftp://x://y.net/", "http://www.cheap-pills.example.com/", "http://spam-farm.example.org/fr/1", "http://spam-farm.example.org", "http://example.net/de/", "http://user@example.net:80/en/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p) and host != ""
    rules = [(len(h + p), h + p, verdict) for verdict, some in (("block", op2_url_filter.BLOCK), ("allow", op2_url_filter.ALLOW)) for h, p in some if fits(h, p)]
    if rules:
        return host, path, max(rules)[1], max(rules)[2]
    return host, path, None, "block" if any(fits(h, p) for h, p in op2_url_filter.LISTED) else "allow"


def test_urls_as_by_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, None, "x", 1)], "page_id long, url string, html string, key int")
    rows = op2_url_filter.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert op2_url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in op2_url_filter.judge(pages, block=[], allow=[], listed=[]).collect()} == {"allow"}


def test_long_lists_are_dealt_into_slices(spark):
    pages = spark.createDataFrame([(i, u, "x", 1, "h", "b") for i, u in enumerate(URLS)], "page_id long, url string, html string, key int, host string, b string")
    whole = [tuple(r) for r in op2_url_filter.judge(pages).orderBy("page_id").collect()]
    hosts = spark.createDataFrame([(h, p, "x") for h, p in op2_url_filter.LISTED] + [(None, "/", "x"), ("", "", "x"), ("nowhere.example.com", None, "x")], "host string, path string, key string")
    for most in (op2_url_filter.MOST_KEYS, 2):
        assert [tuple(r) for r in op2_url_filter.judge(pages, listed=hosts, most=most).orderBy("page_id").collect()] == whole
    allowed = op2_url_filter.judge(pages, block=[], allow=[], listed=[("net", "/")]).filter("verdict = 'block'").collect()
    assert {r["page_id"] for r in allowed} == {i for i, u in enumerate(URLS) if (brute(u)[0] == "net" or brute(u)[0].endswith(".net")) and brute(u)[1].startswith("/")}


def test_plans_do_not_grow_by_level(spark):
    r = random.Random(2)
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    made = op2_url_filter.Cascade(spark.createDataFrame([(f"k{r.randrange(20_000)}",) for _ in range(3000)], "key string"), keys, rate=0.3)
    assert len(made.levels) > 3
    plan = keys.filter(made.has(keys["key"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and len(plan) < 20_000 * len(made.levels)


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 50_000 + "example.net/en/" + "x" * 100_000, "http://" + "b" * 100_000 + ".net/", "http://net/" + "/" * 100_000]
    rows = op2_url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == [brute(u) for u in urls]


def test_cascade_is_exact_over_its_universe(spark):
    r = random.Random(1)
    universe = sorted({f"key{r.randrange(10**7)}" for _ in range(4000)})
    listed = set(r.sample(universe, 900))
    keys = spark.createDataFrame([(k,) for k in universe], "key string")
    made = op2_url_filter.Cascade(spark.createDataFrame([(k,) for k in listed], "key string"), keys, rate=0.2)
    assert len(made.levels) > 2
    assert {x["key"] for x in keys.filter(made.has(keys["key"])).collect()} == listed


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_common_subsequences(monkeypatch, bits):
    monkeypatch.setattr(lcs, "MOST_BITS", bits)
    r = random.Random(2)
    for _ in range(500):
        a, b = ([r.randrange(r.choice((2, 6))) for _ in range(r.randrange(22))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = lcs.common(a, b)
        assert len(got) == table[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


PAGE = """<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><script>var t="</p>";</script><p><b>One<br><p>two &lt;x&gt;  three<ul><li>a<li>b</ul><aside>no</aside><div class="reader-comments">c</div></article><footer>&copy; F</footer></body></html>"""


def test_marked_articles():
    assert op9_main_text.main_text(op9_main_text.blocks(PAGE), None) == "Head & line One two <x> three a b"
    assert op9_main_text.blocks("") == [] and op9_main_text.blocks("<nav>x") == []
    assert [t for _, t in op9_main_text.blocks("a <b>b</b>c<p>d &amp e &am")] == ["a bc", "d & e &am"]


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content no-sidebar"><p>kept</div><div class="sidebar">x</div>', "kept"),
        ('<div class="sidebar-layout"><article>kept</article>x</div>', "kept"),
        ('<div id="comments"><article>x</article></div><article class="post has-comments">kept</article><article class="comment">y</article>', "kept"),
        ("<main><form>x</form><p>kept</p><div role=complementary>y</div></main>z", "kept"),
        ('<div class="post-body">kept<div class="social-share">x</div> too</div>other', "kept too"),
        ("<body><header>x</header><article><header><h1>kept</h1></header>too</article>", "kept too"),
        ("<table><tr><td>a<td>b</table><dl><dt>c<dd>d</dl>", "a b c d"),
        ("<p>one<!-- x -->two <script>y</script>three<noscript>z", "onetwo three"),
        ("<p hidden>x<p>a &lt;b&gt; &#233;&eacute;&nbsp;c", "a <b> éé c"),
        ("<nav>x<p>y</nav></div></p>kept", "kept"),
        ('<div class="left-sidebar">x</div><div id="cookieBanner">y</div><div class="main-text">kept</div>', "kept"),
    ],
)
def test_what_is_main_text(page, text):
    assert op9_main_text.main_text(op9_main_text.blocks(page), None) == text


def test_unmarked_pages_lose_what_their_neighbour_shares(spark):
    page = "<body><div>Site name</div><p>{}</p><p>{}</p><div>About us</div></body>"
    rows = [(i, f"http://a.com/{i}", page.format(f"text {i}", f"more {i}"), "x") for i in range(4)]
    rows += [(10, "http://b.com/1", page.format("same", "copy"), "x"), (11, "http://b.com/1", page.format("same", "copy"), "x"), (20, "http://c.com/1", page.format("lone", "page"), "x"), (30, None, None, "x"), (31, "http://d.com/", PAGE, "x"), (32, "http://d.com/", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in op9_main_text.extract(pages.coalesce(1)).collect()}
    assert [got[i]["text"] for i in range(4)] == [f"text {i} more {i}" for i in range(4)]
    assert got[10]["text"] == got[11]["text"] == "Site name same copy About us" and got[20]["text"] == "Site name lone page About us"
    assert got[30]["text"] == "" and got[31]["text"] == got[32]["text"] == "Head & line One two <x> three a b"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert op9_main_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 3, 8, 40])
def test_partners_stand_beyond_the_borders_of_tasks(spark, monkeypatch, tasks):
    page = "<body><div>Site name</div><div>Menu {}</div><p>{}</p><div>About us</div></body>"
    pages = spark.createDataFrame([(i, f"http://a.com/{i:03}", page.format(i // 2, f"text of page {i}")) for i in range(40)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(type(pages), "repartitionByRange", lambda self, *by, deal=type(pages).repartitionByRange: deal(self, tasks, *by))
    try:
        got = {r["page_id"]: r["text"] for r in op9_main_text.extract(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    paths = [f"/{i:03}" for i in range(40)]
    for i in range(40):
        near = [k for k in (i - 1, i + 1) if 0 <= k < 40]
        other = max(near, key=lambda k: (len(os.path.commonprefix([paths[i], paths[k]])), -k))
        assert got[i] == ("" if other // 2 == i // 2 else f"Menu {i // 2} ") + f"text of page {i}"


def test_partners_are_no_copies(spark):
    page = "<body><div>Site name, menu</div>{}<div>About us, footer</div></body>"
    article = lambda k, last: "".join(f"<p>article {k} line {j}</p>" for j in range(9)) + f"<p>{last}</p>"
    text = lambda k, last: " ".join(f"article {k} line {j}" for j in range(9)) + " " + last
    rows = [(i, f"http://a.com/1?copy={i}", page.format(article(1, "end"))) for i in range(5)]
    rows += [(i, f"http://a.com/2?near={i}", page.format(article(2, f"end {i}"))) for i in range(5, 30)]
    rows += [(i, f"http://b.com/1?near={i}", page.format(article(3, f"end {i}"))) for i in range(30, 33)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in op9_main_text.extract(pages).collect()}
    whole = {i: f"Site name, menu {text(3, f'end {i}')} About us, footer" for i in range(30, 33)}
    assert got == {i: text(1, "end") for i in range(5)} | {i: text(2, f"end {i}") for i in range(5, 30)} | whole
    # a page of little but what its partner has too keeps it
    lines = [(op9_main_text.OTHER, t) for t in text(1, "end").split()]
    assert op9_main_text.main_text(lines, lines[:-1]) == text(1, "end")
