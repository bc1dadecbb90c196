import html
import random
import re
import time

import pyarrow as pa

from glossa.llm import html as H
from glossa.llm.html import _extract, extract_pages, lines, main_text, shared

from .conftest import SF


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def subsequence(x, y):
    it = iter(y)
    return all(c in it for c in x)


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    rnd = random.Random(3)
    for _ in range(1500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        s = shared(a, b)
        assert len(s) == lcs(a, b) and subsequence([a[i] for i in sorted(s)], b)
    for _ in range(300):  # halved alignments
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        monkeypatch.setattr(H, "ALIGNED", rnd.choice((1, 60, 500)))
        s = shared(a, b)
        assert len(s) == lcs(a, b) and subsequence([a[i] for i in sorted(s)], b)
    monkeypatch.undo()
    same = ["x"] * 5000
    assert len(shared(same, same[:-7] + ["y"])) == 4993


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-banner">We use cookies <div>ok</div></div>
<main><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;para <b>bold</b>.<br>Next line<p>Second&#233; <!-- ad --> para
<aside>Aside text</aside><div class="ad slot-1">Buy now</div><form><input><button>Send</button></form><ul><li>one<li>two</ul>
<table><tr><td>c1</td><td>c2</td></tr></table></article><section id="comments"><p>Nice!</p></section></main>
<div class="sidebar">Side</div><footer>&copy; me</footer></body></html>""".format()


def text(page, other=None):
    return main_text(lines(page), None if other is None else lines(other))


def test_roles():
    assert text(PAGE) == "Title & more First para bold. Next line Secondé para one two c1 c2"
    assert text(None) == text("") == text("<nav>x</nav>") == ""
    assert text("plain words") == "plain words"
    assert text("a < b <i>c</i>d") == "a < b cd"
    assert text("<p class=ad>buy<p>kept") == "kept"
    assert text("<article><p>open <b>never closed") == "open never closed"
    assert text("<article>x<!-- never closed") == "x"
    assert text("<div class='content with-sidebar'><p>kept</p></div>") == "kept"
    assert text("<article><div class='entry-header'>T</div>x<div class='share-bar'>y</div></article>") == "T x"
    assert text("<div class='page notice'><p>n</p><main>body</main></div><div id=comments><article>me</article></div>") == "body"
    assert text("<article>a</article><article class='comment'>b</article><section class='comments'><article>c</article></section>") == "a"
    assert text("<article><p title='a > b'>q</p></article>") == "q"


def test_pages_without_marked_main_part_are_differenced():
    page = lambda body: f"<body><div>Top stories</div><div>World</div>{body}<div>All rights reserved</div></body>"
    a = page("<div>First story.</div><div>It goes on here for a while longer than the furniture does.</div>")
    b = page("<div>Another story.</div><div>World</div><div>It ends quite differently, and at some length as well.</div>")
    assert text(a, b) == "First story. It goes on here for a while longer than the furniture does."
    assert text(a, a) == text(a)  # a copy loses nothing


def test_lines_that_two_neighbours_share_go_from_marked_pages():
    page = lambda *body: "<body><nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in body) + "</article></body>"
    own = [(f"Story {i}.", f"It goes on with words of its own, {i} of them, for a while.") for i in range(4)]
    a, b, c, d = (page("Share this page", x, y, "Subscribe now") for x, y in own)
    assert text(a, b) == text(a)  # an article may quote another
    assert main_text(lines(a), lines(b), lines(c)) == " ".join(own[0])
    assert main_text(lines(a), lines(a), lines(b)) == " ".join(own[0])  # published twice
    assert main_text(lines(a), lines(a), lines(a)) == text(a)
    rows = pa.RecordBatch.from_pylist([{"page_id": i, "url": "", "host": "h", "path": f"/{i}", "html": x, "to": 0, "own": True} for i, x in enumerate((a, b, c, d))])
    got = [x for out in _extract(iter([rows])) for x in out.column(2).to_pylist()]
    assert got == [" ".join(x) for x in own]


def test_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = extract_pages(pages.withColumn("text", pages.html)).collect()
    assert sorted(r.page_id for r in got) == sorted(source)
    for r in got:
        a = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        a = re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub("<!--.*?-->", "", a, flags=re.S)))
        assert r.text == " ".join(html.unescape(a).split()) and r.n_chars == len(r.text)


def test_neighbours_across_partitions_and_nulls(spark):
    rows = [(i, f"http://h.example/{i:03d}", f"<body><div>Menu of the site</div><div>Own text number {i} with words.</div></body>") for i in range(60)]
    rows += [(100, None, None), (101, "http://alone.example/x", "<body><div>Menu</div><div>words</div></body>"), (102, "http://alone.example/y", ""), (None, "notaurl", "t"), (103, "http://h.example/003", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert len(got) == len(rows) and got[100] == "" and got[102] == "" and got[101] == "Menu words" and got[None] == "t"
    plain = [i for i in range(60) if i != 3]
    assert sum(got[i] == f"Own text number {i} with words." for i in plain) >= 55  # a lone first or last row of a partition keeps its menu
    assert all(got[i] in (f"Own text number {i} with words.", f"Menu of the site Own text number {i} with words.") for i in plain)
    assert extract_pages(df.limit(0)).count() == 0


def test_copies_are_told_by_a_second_neighbour():
    page = lambda body: "<body>" + "".join(f"<div>A long line of the menu, number {i}, on every page.</div>" for i in range(9)) + f"<div>{body}</div></body>"
    a, b, c = (lines(page(x)) for x in ("One short story.", "Two is another.", "And a third."))
    assert main_text(a, b, c) == "One short story."  # shared lines are most of the text
    assert main_text(a, a, b) == "One short story."  # the nearest is a copy
    assert main_text(a, a, a) == main_text(a, a) == " ".join(t for t, _ in a)


def test_every_page_meets_its_neighbours_however_many_ranges(spark):
    rows = [(i, f"http://h{i // 20}.example/{i:03d}", f"<body><div>Menu of the site</div><div>Own text number {i} with words.</div></body>") for i in range(63)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (8, 40, 150):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in extract_pages(df).collect()}
            assert got == {i: f"Own text number {i} with words." for i in range(63)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hostile_pages_take_linear_time():
    n = 1 << 20
    pages = ["<p " * (n // 3), "<p a=\"" * (n // 6), "<p '\">" * (n // 6), "<" * n, "<!-- " * (n // 5), "<article>x" * (n // 10), "<div class=ad>" * (n // 14) + "x", "</p" * (n // 3), "<script>" * (n // 8), "&amp" * (n // 4)]
    for page in pages:
        began = time.perf_counter()
        lines(page)
        assert time.perf_counter() - began < 5, page[:20]
    a, b = ("".join(f"<p>{c}" for c in random.Random(k).choices("abc", k=20_000)) for k in (1, 2))
    began = time.perf_counter()
    assert main_text(lines(a), lines(b)) == text(a)  # most lines are shared: a copy
    assert time.perf_counter() - began < 30


def test_nested_and_unclosed_articles():
    assert text("<article>a<article>b</article>c</article>out") == "a b c"
    assert text("<article>kept <p class='x") == "kept"
    assert text("<article><p title='x>kept</p></article>") == "kept"
    assert text("<main>one</main><p>two</p><main>three</main>") == "one three"


def test_furniture_inside_the_main_part_goes_by_differencing():
    page = lambda i: f"<body><main><p>Site menu entry one</p><p>Trending now</p><p>Story {i} with text of its own, long enough to read.</p><p>All rights reserved</p></main></body>"
    a, b, c = (lines(page(i)) for i in range(3))
    assert main_text(a, b, c) == "Story 0 with text of its own, long enough to read."
