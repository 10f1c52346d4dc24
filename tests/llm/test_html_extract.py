import random
import time

import pytest

from docsift.llm import html_extract as hx

SCHEMA = "page_id long, url string, html string, text string, host int"

CASES = [
    ("<article><h1>T</h1><p>a  b<br>c<p><b>d</b>e &amp; f&eacute;&nbsp;g</article><footer>x</footer>", "T\na b c\nde & fé g"),
    ("<body><nav>menu</nav><div>one<div>two</div>three</div><script>var t='</p>'</script><p>4</body>", "one\ntwo\nthree\n4"),
    ("<main><p>in</p><aside>no</aside><form>no</form></main><p>out</p>", "in"),
    ("<article><p>t</p><div class='ad'>no</div><div class='post-comments'>no</div><section role=navigation>no</section></article>", "t"),
    ("<body class=no-sidebar><p>x<!-- y --><style>p{}</style>z</p><ul><li>1<li>2</ul>", "xz\n1\n2"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("plain & simple", "plain & simple"),
    ("<p>a</p></div></article><p>b", "a\nb"),
    ("<p title='a > b'>quoted</p><p hidden>h</p>", "quoted"),
    ("<header>Site</header><article><p>x</p></article><article class='comment'>no</article>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("", ""), (None, ""), ("<<<>>> <", "<<<>>> <"), ("<nav>only</nav>", ""),
    ("<div class='content has-sidebar'><article><p>story</p></article></div>", "story"),
    ("<div class='layout sidebar-right'><article><p>story</p></article><div class='sidebar'>no</div></div>", "story"),
    ("<article><header><h1>Title</h1></header><p>a</p><footer>no</footer></article>", "Title\na"),
    ("<header><h1>Site</h1></header><p>a</p>", "a"), ("<header><article><p>a</p></article></header>", "a"),
    ("<article><p>so <math><mi>x</mi></math> is</p><section class='related'><p>work</p></section></article>", "so x is\nwork"),
    ("<div id='banner-story'><p>kept</p></div><div id='top-banner'>no</div>", "kept"),
    ("<div class='related'><p>no</p></div><p>a longer text</p>", "a longer text"),
    ("<article class='teaser'><p>short</p></article><div><p>" + "much longer text " * 9 + "</p></div>", "short\n" + " ".join(["much longer text"] * 9)),
    ("<form id=aspnet><article><p>in a form</p></article><input></form>", "in a form"),
    ("<div style='display: none'>no</div><div class='login-form'>no</div><p>yes</p>", "yes"),
    ("<form><p>the whole page lies in one form</p></form><p>end</p>", "the whole page lies in one form\nend"),
    ("<article><p>t</p><div class='comments'><article class='comment'><p>no no no</p></article></div></article>", "t"),
    ("<article><p>t</p></article><div class='comments'><article class='comment'><p>no no no</p></article></div>", "t"),
    ("<a title=\"unclosed>x</a><p>y", "x\ny"), ("a <b", "a"), ("<p>1 < 2 <3</p>", "1 < 2 <3"), ("x<!-- open", "x"), ("<!doctype html><p>d<?php echo ?>e", "de"),
    ("<p>" + "long words " * 20000 + "</p>", " ".join(["long words"] * 20000)),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extract(page, text):
    assert hx.extract(page or "") == text


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "x", "<div>" * 100_000 + "x", "<p><div>" * 50_000, "<a " * 100_000, "<a \"" * 100_000, "<a b='" * 100_000, "<!" * 100_000, "<!-- " * 100_000,
    "<ul>" * 50_000 + "<li>" * 50_000, "<td>" * 100_000, "</div>" * 100_000, "<" * 200_000, "<div class='" + "a" * 300_000 + "'>x", "<div " + "a" * 300_000 + " b=c>x",
    "<div>x" * 50_000 + "</div>" * 50_000, "<script>" * 50_000, "&amp" * 100_000, "<b>" * 50_000 + "<p>y</p>" * 50_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    hx.extract(page)
    hx.subtrees(page)
    assert time.process_time() - began < 6  # both passes, on a slow machine


def test_template_counts_against_plain_ones(spark):
    rng = random.Random(8)
    parts = [f"<div class=c{k}>part {k}</div>" for k in range(12)]
    rows = []
    for i in range(60):
        body = "".join(p for k, p in enumerate(parts) if rng.random() < (k + 1) / 14)
        rows.append((i, "http://one.com/", f"<body>{body}<!-- {i} --><p>own text {i // 2} goes here</p></body>", "x", 1))
    want: dict = {}
    mains = {}
    for _, _, page, _, _ in rows:
        main, outside, _ = hx.subtrees(page)
        mains[main] = 1
        for h in outside:
            want.setdefault(h, set()).add(main)
    want = {h for h, m in want.items() if len(m) >= max(hx.PAGES, hx.PART * len(mains))}
    src = spark.createDataFrame(rows, SCHEMA).selectExpr("'one.com' AS host", "html")
    got = hx.templates(src).collect()
    assert len(got) == 1 and set(got[0].loose) == want and 0 < len(want)


def test_salted_join_gives_the_same(spark, monkeypatch):
    shell = "<body><div class=x1>Our site slogan</div><p>Page {} of it</p></body>"
    df = spark.createDataFrame([(i, "http://big.com/", shell.format(i), "x", 1) for i in range(40)], SCHEMA)
    want = sorted(tuple(r) for r in hx.main_text(df).collect())
    monkeypatch.setattr(hx, "BROADCAST", 0)
    assert sorted(tuple(r) for r in hx.main_text(df).collect()) == want and want[3][2] == "Page 3 of it"


def test_deep_and_unbalanced_pages_end():
    assert hx.extract("<div>" * 3000 + "x" + "</div>" * 10).strip() == "x"
    assert isinstance(hx.extract('<a "' * 2000 + "'<p>" * 2000), str)


def test_site_template_goes_and_copies_stay(spark):
    shell = "<body><div class=x1>Our site slogan</div><div class=x2><p>{}</p><p>Page {}</p></div><div>Follow us everywhere</div></body>"
    rows = [(i, f"http://Big.com/{i}", shell.format(f"own text {i}", i), "x", 1) for i in range(30)]
    art = "<article><p>the same article</p><p>twice told</p></article>"
    rows += [(100 + i, f"http://copy.com/{i}", art, "x", 1) for i in range(30)]
    rows += [(200, "http://small.com/", shell.format("a", 1), "x", 1), (201, None, None, "x", 1), (201, None, None, "x", 1)]
    rows += [(300 + i, f"http://tight.com/{i}", f"<article><p>text {i}</p><p>Subscribe now!</p></article>", "x", 1) for i in range(12)]
    got = {r.page_id: r for r in hx.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(30):
        assert got[i].text == f"own text {i}\nPage {i}"
        assert got[100 + i].text == "the same article\ntwice told"
    assert got[200].text == "Our site slogan\na\nPage 1\nFollow us everywhere"
    assert got[201].text == "" and got[201].n_chars == 0
    assert got[305].text == "text 5" and got[305].n_chars == 6


def test_empty(spark):
    assert hx.main_text(spark.createDataFrame([], SCHEMA)).count() == 0
