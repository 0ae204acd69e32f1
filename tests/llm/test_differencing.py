"""Page differencing against a plain version over all pages in one list."""

import os.path
import random

import pytest

from quernlight.llm import op9_main_text as op9

DATA = "/root/testdata/sf0.001"


def lcs(a, b):
    """Its length."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def near_same(a, b):
    size, left = 0, [t for _, t in b]
    for _, t in a:
        if t in left:
            left.remove(t)
            size += len(t)
    return size >= op9.NEARLY * max(sum(len(t) for _, t in a), sum(len(t) for _, t in b))


def plain(pages):
    """page_id -> (lines, partner's lines or None); pages: (page_id, url, html) with urls of one form, http://host/path."""
    rows = sorted(((*url.split("://")[1].split("/", 1), i, html) for i, url, html in pages if url), key=lambda r: (r[0], "/" + r[1], r[2]))
    found = [(host, "/" + path, i, op9.lines_of(html or "")) for host, path, i, html in rows]
    out = {i: (op9.lines_of(html or ""), None) for i, _, html in pages}
    run = [0]
    for a, b in zip(found, found[1:]):
        run.append(run[-1] + (a[0] != b[0] or not near_same(b[3], a[3])))
    for k, (host, path, i, lines) in enumerate(found):
        before = next((found[j] for j in range(k, -1, -1) if run[j] < run[k]), None)
        after = next((found[j] for j in range(k, len(found)) if run[j] > run[k]), None)
        sides = [s for s in (before, after) if s and s[0] == host]
        partner = max(sides, key=lambda s: len(os.path.commonprefix([path, s[1]]))) if sides else None
        out[i] = (lines, partner and partner[3])
    return out


def unmarked(n: int, seed: int = 0):
    """Pages that no markup marks: of some hosts, with menus and footers of the host, copies, near copies and lone pages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    pages, i = [], 0
    for h in range(6):
        menu, foot = [word() for _ in range(4)], [f"about {word()}", f"imprint {word()}"]
        for p in range(1 if h == 5 else n):
            body = [" ".join(word() for _ in range(12)) for _ in range(r.randint(3, 9))]
            for copy in range(r.choice([1, 1, 1, 3])):
                lines = body if copy < 2 else [*body[:-1], f"edited {word()}"]
                html = "".join(f"<div>{x}</div>" for x in (*menu, *lines, *foot))
                pages.append((i, f"http://h{h}.org/{r.choice('ab')}/{p:03}", html))
                i += 1
    pages += [(i, None, "<p>no url"), (i + 1, "http://h0.org/a/x", None), (i + 2, "http://h0.org/a/y", "")]
    return pages


def extracted(spark, pages, parts=3):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string").repartition(parts)
    return {r["page_id"]: r for r in op9.extract(df).collect()}


def test_unmarked_pages_lose_exactly_what_the_plain_version_deletes(spark):
    pages = unmarked(12)
    got, expected, changed = extracted(spark, pages), plain(pages), 0
    assert got.keys() == expected.keys()
    for i, (lines, partner) in expected.items():
        assert got[i]["text"] == op9.main_text(lines, partner), i
        changed += partner is not None and got[i]["n_deleted"] > 0
        if partner is not None:
            assert got[i]["n_deleted"] in (0, lcs(lines, partner))
    assert changed > 0.8 * len(pages)
    # a page that its partner all but mirrors keeps its lines; all others lose the host's footer
    assert not [i for i, r in got.items() if r["n_deleted"] and {"about", "imprint"} & set(r["text"].split())]


def test_given_pages_as_by_the_plain_version(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op9.query(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        article = r["html"][r["html"].index("<article") :]
        assert got[r["page_id"]]["text"] == op9.main_text(op9.lines_of(article[: article.rindex("</article>")]), None)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["n_lines"] >= got[r["page_id"]]["n_deleted"]


@pytest.mark.parametrize("waiting", [op9.MOST_WAITING, 40])
def test_results_do_not_depend_on_tasks(spark, monkeypatch, waiting):
    monkeypatch.setattr(op9, "MOST_WAITING", waiting)
    pages = unmarked(8, 1)
    pages += [(1000 + k, "http://h0.org/a/003", pages[3][2] + f"<p>{k}") for k in range(30)]  # a long run
    expected = plain(pages)
    deal = type(spark.range(1)).repartitionByRange
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for tasks in (1, 7, 60):
            monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *by, n=tasks: deal(self, n, *by))
            got = extracted(spark, pages)
            assert {i: r["text"] for i, r in got.items()} == {i: op9.main_text(*x) for i, x in expected.items()}, tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def records(pages, cuts, most):
    """place() over tasks that cuts part."""
    rows = []
    for k, (i, url, html) in enumerate(pages):
        lines = op9.lines_of(html or "")
        rows.append([i, 0, url.split("/")[2], "/" + url.split("/", 3)[3], [x for x, _ in lines], [len(t) for _, t in lines], [op9._hash(t) for _, t in lines]])
    edges = [0, *cuts, len(rows)]
    return [r for t, (a, b) in enumerate(zip(edges, edges[1:])) for r in op9.place(iter(rows[a:b]), t, most)]


def test_every_page_is_done_or_open_once():
    pages = sorted((p for p in unmarked(9, 2) if p[1]), key=lambda p: (p[1], p[0]))
    for cuts, most in (((), 10**6), ((1, 2, 30), 10**6), ((20,), 25)):
        made = records(pages, cuts, most)
        assert sorted(r[3] for r in made if r[0] in (op9.DONE, op9.OPEN)) == sorted(p[0] for p in pages)
        edges = [r[:3] for r in made if r[0] in (op9.FIRST, op9.LAST)]
        assert len(edges) == len(set(edges))
        runs = {(r[1], r[2]) for r in made if r[0] == op9.OPEN}
        assert {(t, run - 1) for t, run in runs if run} <= {e[1:] for e in edges if e[0] == op9.LAST}


def test_very_long_pages_and_repeats(spark):
    long_ = "".join(f"<p>line {i} of a long page" for i in range(20_000))
    pages = [(1, "http://a.org/1", "<div>menu</div>" + long_), (2, "http://a.org/2", "<div>menu</div><p>short"), (2, "http://a.org/2", "<div>menu</div><p>short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = sorted(op9.extract(df).collect(), key=lambda r: r["page_id"])
    assert [r["text"] for r in rows[1:]] == ["short", "short"] and rows[0]["text"].startswith("line 0 of a long page line 1") and rows[0]["n_lines"] == 20_001
