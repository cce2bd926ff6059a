"""Main text of pages: templates recounted in plain Python, what decides, and awkward pages."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from rollkeep.llm import html

SF = "/root/testdata/sf0.01"
FORM = "page_id long, url string, html string"


def texts(spark, rows, form=FORM):
    return {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, form)).collect()}


def article(page):
    """The article of a sample page, read by pattern."""
    return html.main_text(html.parse(re.search("<article>(.*?)</article>", page, re.S)[1]), set(), exclusions=False)


@pytest.fixture(scope="module")
def sample(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]


def neutral(rows):
    """Sample pages on three hosts, each with one of four menus and notices of its host; no element tells what it is."""
    out = []
    for i, _, page in rows:
        host, kind = i % 3, i // 3 % 4
        body = re.sub(r".*<article>(.*)</article>.*", r"<div>\1</div>", page, flags=re.S)
        out.append((i, f"http://h{host}.example/{i}", f"<body><div><ul><li>Menu {host}<li>Page {kind}</ul></div><div>Notice {kind} of site {host}<p>More of it</p></div>{body}<div>Imprint {host} {kind}</div>"))
    return out


def test_sample_pages_give_their_article(spark, sample):
    assert texts(spark, sample) == {i: article(page) for i, _, page in sample}


def test_templates_decide_where_no_tag_tells(spark, sample, monkeypatch):
    rows = neutral(sample)
    want = {i: article(page) for i, _, page in sample}
    assert texts(spark, rows) == want
    monkeypatch.setattr(html, "LEAST_PAGES", 10**9)
    without = texts(spark, rows)
    assert all(without[i] != want[i] for i in want)


def test_templates_are_counted_as_in_plain_python(spark, sample):
    rows = [(i, url, re.sub("<(/?)(nav|footer|article)", r"<\1div", page).replace(' class="ad"', "")) for i, url, page in sample] + neutral(sample)
    rows += rows[:40] + [(9000 + i, rows[300][1], rows[300][2].replace("<body>", f"<body><script>{i}</script>")) for i in range(9)]
    holders, pages, trees = defaultdict(set), defaultdict(set), {}
    for i, url, page in rows:
        order, host = html.parse(page), re.sub("^[a-z]+://([^/?#]*).*", r"\1", url).lower()
        html.annotate(order)
        trees[url, page] = host, order
        pages[host].add(order[0].digest)
        for e in order:
            if e.counted:
                holders[host, e.digest].add(order[0].digest)
    want = {}
    for i, url, page in rows:
        host, order = trees[url, page]
        many = {k[1] for k, v in holders.items() if k[0] == host and len(v) >= 3 and (len(v) >= 0.01 * len(pages[host]) or len(v) >= 100)}
        want[i, url, page] = html.page_text(page, many)
    got = html.main_texts(spark.createDataFrame(rows, FORM).repartition(5)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((k[0], want[k]) for k in [r for r in rows])
    assert sum(want[k] != html.page_text(k[2], set()) for k in want) > len(want) / 2


def test_parts_that_are_no_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use</div><div id=ad-1><span>Buy {0} now</span></div><article><h1>Title &amp; more</h1><p>One<br>two <b>three<p>Four&nbsp;{1}</p><ul><li>a<li>b</ul><form><p>Your mail</p></form><section class=comments><p>nice</p></section><script>var a='</p>';</script><!-- no --></article><p>After {1}</p><div class=x1>Site wide words</div><footer>foot</footer></body>"
    rows = [(i, "http://h.example/x", page.format("x", i)) for i in range(6)]
    rows += [(7, None, None), (8, "http://h.example/", "<p>plain &lt;b&gt; text<div>Site wide words</div>"), (9, "x", "<art"), (10, "x", ""), (10, "x", "<p>a  b\n\tc")]
    got = texts(spark, [r + (1, "y") for r in rows], FORM + ", host string, copy string")
    assert got[2] == "Title & more\n\nOne two three\n\nFour 2\n\na\n\nb\n\nAfter 2"
    assert got[7] == "" and got[9] == "" and got[10] in ("", "a b c")
    assert got[8] == "plain <b> text"
    assert html.main_texts(spark.createDataFrame([], FORM)).count() == 0


def test_recurring_parts_go_and_recurring_articles_stay(spark):
    rows = [(i, "http://h.example/x", f"<body><div><div><i>Company news and views</i></div><div>Story number {i} is here</div></div></body>") for i in range(8)]
    rows += [(100 + i, "http://h.example/x", f"<body><script>{i}</script><div><i>Company news and views</i></div><div>Story number 99 is here</div></body>") for i in range(30)]
    rows += [(300 + i, "http://b.example/x", f"<div>Menu {i // 4}</div>{'<hr>' * (i % 4)}<div><p>An article that many pages hold</p><p>in two parts</p></div>") for i in range(20)]
    got = texts(spark, rows)
    assert all(got[i] == f"Story number {i} is here" for i in range(8))
    assert all(got[100 + i] == "Story number 99 is here" for i in range(30))
    assert all(got[300 + i] == "An article that many pages hold\n\nin two parts" for i in range(20))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep" + "<span>x" * 5000
    long = "".join(f"<p>para {i}</p>" for i in range(50_000))
    got = texts(spark, [(1, "u", deep), (2, "u", long), (3, "u", "<a title=\"" * 5000), (4, "u", "</p></div>" * 20_000 + "<li>" * 20_000 + "end")])
    assert got[1] == "deep" + "x" * 5000 and got[2].count("\n\n") == 49_999 and got[4] == "end"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<div id="ad">AD 1066 began</div>', "AD 1066 began"),
        ('<section class="menu">Soup of the day</section>', "Soup of the day"),
        ('<div class="legal-notice">Notice of the vote</div>', "Notice of the vote"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", "so x=2 holds"),
        ('<object data="a.swf"><p>in words</p></object>', "in words"),
        ('<div class="comments">first!</div>', ""),
        ('<div class="cookie-notice">we use them</div>', ""),
        ("<nav>a b</nav>", ""),
        ('<div role="dialog">sign up</div>', ""),
        ("<form>name <input></form>", ""),
        ("<aside>see also</aside>", ""),
        ("<script>1</script><style>p{}</style><svg><text>t</text></svg>", ""),
        ('<div hidden>not shown</div>', ""),
    ],
)
def test_parts_of_an_article(part, kept):
    page = f"<body><article><p>The text.</p>{part}</article></body>"
    assert html.page_text(page, set()) == "\n\n".join(["The text."] + [kept] * bool(kept))


@pytest.mark.parametrize("part", ['<div id="ad">buy</div>', '<div class="menu">home</div>', '<div class="notice">maintenance</div>', "<footer>c</footer>", '<div class="sidebar">s</div>', "<header>h</header>"])
def test_parts_beside_an_article(part):
    assert html.page_text(f"<body>{part}<article><p>The text.</p></article>{part}</body>", set()) == "The text."
