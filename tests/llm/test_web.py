import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftwell.llm import html_text, url_filter


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words only", "plain words only"),
        ("<p>one<p>two &lt;b&gt;&nbsp; x<br>y</p>", "one\n\ntwo <b> x y"),
        ("<nav>menu</nav><article><h1>T</h1><p>Short.<p>" + "long " * 40 + "</article><footer>foot</footer>", "T\n\nShort.\n\n" + ("long " * 40).strip()),
        ("<div class='ad'>buy<article><p>Hello there</article>", "Hello there"),
        ("<main><p>a &amp;&amp; b</p><aside>side</aside><form>f</form><!-- c --><script>var t='</p>';</script><p>c</p><div id=comments><p>" + "bla " * 60 + "</div></main>", "a && b\n\nc"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\n\ntwo\n\nx\n\ny"),
        ("<article><p>a <a title='x>y' href=z>link</a> b</article>", "a link b"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<header>Site</header><div class='header'>Site</div><article class='post'><header><h1>Title</h1></header><p>Text of the post.</p><div class='post-share'>kept</div><div class=share>x</div></article>", "Title\n\nText of the post.\n\nkept"),
        ("<article><p>Text.</p></article><article class='comment'><p>" + "bla " * 60 + "</article>", "Text."),
        ("<p>x < y and y > z</p>", "x < y and y > z"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_unmarked_pages_by_surge_and_dive():
    links = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{'Some longer sentence of the text. ' * 4}</p>" for _ in range(5))
    page = f"<html><body><div><ul>{links}</ul></div><div><p>Intro.</p>{body}<p>End.</p></div><div><ul>{links}</ul></div></body></html>"
    got = html_text.main_text(page).split("\n\n")
    assert got[0] == "Intro." and got[-1] == "End." and len(got) == 7
    assert html_text.spans([0, 50, 60, 0, 0, 5, 0], 3, 86) == [(1, 3)]


def test_a_light_run_is_kept():
    first, last = "word " * 60, "tail " * 25
    parts = f"<section><p>{first}<p>{first}</section><div class=ad>Buy</div><section><p>{last}<p><a href=x>More</a></section>"
    wanted = [first.strip(), first.strip(), last.strip(), "More"]
    assert html_text.main_text(f"<div id=c>{parts}</div>").split("\n\n") == wanted
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(f"<div>{menu}<div>{parts}</div></div>").split("\n\n") == wanted


LONG = "Some longer sentence of the text. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a last paragraph in a second container
        (f"<div id=content><div><p>{LONG}<p>{LONG}</div><div><p>The end.</p></div></div>", [LONG, LONG, "The end."]),
        # a paragraph that is one link, and more behind it
        (f"<body><ul><li><a href=/>Home</a></ul><p>{LONG}</p><p><a href=x>A link</a></p><p>More.</p><p>Copyright 2020 x</p></body>", [LONG, "A link", "More."]),
        (f"<body><p>{LONG}</p><p><a href=x>A link</a></p><p>{LONG}</p></body>", [LONG, "A link", LONG]),
        # classes of paragraphs inside an article
        (f"<article><p class=alert>Mind this.</p><p>{LONG}</p><p class='ad-free note'>Noted.</p><div class=alert>Buy!</div></article>", ["Mind this.", LONG, "Noted."]),
        # references are decoded within one run of text
        ("<p>a &<b>amp;</b> b &amp;amp; c&shy;d &#x41;&#66;</p>", ["a &amp; b &amp; c\u00add AB"]),
        # a table layout with a side column
        (f"<table><tr><td class=sidebar><p>{LONG}</p></td><td><h1>Title</h1>{LONG}<br>{LONG}<p>End.</td></tr></table>", ["Title", (LONG * 2).strip(), "End."]),
        # a forum page: reader comments below
        (f"<div class=header>Site</div><div class=post><h2>Head</h2><p>{LONG}</p></div><ol class='comment-list'><li id=comment-1><p>{LONG}</ol><div id=respond><form>x</form></div>", ["Head", LONG]),
        # two sections with an advert between
        (f"<main><section><p>{LONG}</section><div class='ad-slot'>Buy</div><section><p>Short.</section></main><footer>&copy;</footer>", [LONG, "Short."]),
        # end tags missing or crossed
        (f"<article><ul><li>one<p>{LONG}<li><b>two</ul></b><p>three</div></article><p>out", ["one", LONG, "two", "three"]),
    ],
)
def test_templates(page, text):
    assert html_text.main_text(page).split("\n\n") == [x.strip() for x in text]


def test_block_sums_against_plain_loops():
    rng = random.Random(6)
    for _ in range(300):
        sizes = [rng.choice([0, 0, rng.randrange(120)]) for _ in range(rng.randrange(30))]
        sums = []
        for i in range(len(sizes)):
            total = 0
            for j in range(i, min(i + 3, len(sizes))):
                total += sizes[j]
            sums.append(total)
        limit = min(86, max(sums, default=0))
        want, i = [], 0
        while i < len(sizes):  # maximal stretches of filled lines in which some window reaches the limit
            j = i
            while j < len(sizes) and sizes[j]:
                j += 1
            if any(sums[k] >= limit and limit for k in range(i, j)):
                want.append((i, j))
            i = max(j, i + 1)
        assert html_text.spans(sizes) == want


def test_deep_and_long_pages_take_linear_time():
    def seconds(page):
        start = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - start

    for opened in ("<div>", "<b>", "<ul><li>", "<p><span>", "<table><tr><td>", "<blockquote>x"):
        small, large = (min(seconds(opened * n + LONG + "</div></b>" * 10) for _ in range(2)) for n in (2_000, 20_000))
        assert large < 30 * small + 0.3, opened
    assert html_text.main_text("<div>" * 50_000 + "<p>" + LONG + "</p>" + "</div>" * 50_000) == LONG.strip()
    text = html_text.main_text("<article>" + f"<p>{LONG}</p>" * 30_000 + "</article>")
    assert text.count("\n\n") == 29_999


def test_pages_of_the_tables_give_their_article(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    pages = spark.read.parquet(f"{big}/pages.parquet")
    for row in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" in article else "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert "".join(row["text"].split()) == "".join("".join(b) for b in blocks).replace(" ", "")


def test_extract_rows(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("text", F.lit("clash"))
    rows = html_text.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_urls_and_rules(spark):
    urls = [
        ("http://a.org", None, "allow"), ("http://A.ORG/x?y", "org/", "allow"), ("https://sub.example.org/es/1", "example.org/es/", "block"), ("https://example.org/en/12#f", "example.org/en/1", "block"),
        ("https://example.org/en/2", "org/", "allow"), ("http://notexample.org/es/", "org/", "allow"), ("http://x.com/fr/1", "com/fr/", "allow"), ("http://x.com/fr", None, "allow"), ("http://bad.com/de/1", "com/de/", "block"),
        ("http://bad.com/other", None, "block"), (None, None, "allow"), ("no scheme/org/", None, "allow"), ("http://", None, "allow"), ("x://y.com://z/de/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "x") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    for i, (url, rule, verdict) in enumerate(urls):
        assert (rows[i]["rule"], rows[i]["verdict"]) == (rule, verdict), url
    assert (rows[1]["host"], rows[1]["path"], rows[13]["host"], rows[13]["path"]) == ("a.org", "/x", "y.com:", "//z/de/")
    assert rows[10]["host"] == rows[11]["host"] == rows[10]["path"] == ""
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_propagation_against_plain_loops(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("c", "d", 3), ("d", "a", 1), ("e", "d", 1)]
    seeds = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.0), "d": (0.0, 1.0), "e": (0.0, 0.0)}
    t = {h: 0.15 * s[0] for h, s in seeds.items()}
    b = {h: 0.15 * s[1] for h, s in seeds.items()}
    outs = {h: sum(n for s, _, n in links if s == h) for h in seeds}
    ins = {h: sum(n for _, d, n in links if d == h) for h in seeds}
    for _ in range(url_filter.ROUNDS):
        t2, b2 = {h: 0.15 * s[0] for h, s in seeds.items()}, {h: 0.15 * s[1] for h, s in seeds.items()}
        for s, d, n in links:
            t2[d] += 0.85 * t[s] * n / outs[s]
            b2[s] += 0.85 * b[d] * n / ins[d]
        t, b = t2, b2
    got = url_filter.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(links, "source string, target string, n long")).collect()
    for r in got:
        assert (r["trust"], r["distrust"]) == (pytest.approx(t[r["host"]]), pytest.approx(b[r["host"]]))


def test_links_carry_distrust(spark):
    html = """<a href="http://bad.com/x">1</a> <A class=x HREF='//bad.com/y'>2</a> <a href="/own">3</a>"""
    pages = spark.createDataFrame([(1, "http://friend.net/", html), (2, "http://bad.com/de/1", ""), (3, "http://quiet.net/", "")], "page_id long, url string, html string")
    assert [tuple(r) for r in url_filter.host_links(pages).collect()] == [("friend.net", "bad.com", 2)]
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow"}
