"""Main text of pages: templates, edge cases, and a table of pages."""

import html
import re

import numpy as np
import pytest

from communitylens.llm import html_text as ht

LONG = "A long paragraph with many words in it, going on and on until it is surely content."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar nav-open"><header><h1>The site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, and say so in a sentence that is as long as a paragraph would be.</p></div>
<div class="ad">Buy this</div>BODY
<aside><p>{LONG} aside</p></aside><section id="comments"><article class="comment"><p>{LONG} I say.</p></article></section>
<form><p>{LONG} form</p></form><footer><p>{LONG} foot</p></footer></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h1>Title &amp; more</h1><p>{0}</p><p>Short.</p><ul><li>One<li>Two</ul><p>{0}&nbsp; x\n y</p></article>",
    "<main><h1>Title &amp; more</h1><p>{0}<p>Short.<ul><li>One</li><li>Two</li></ul><p>{0} x y</main>",
    "<div class='post'><h1>Title &amp; more</h1><p>{0}</p><p>Short.</p><ul><li>One<li>Two</ul><p>{0} x y</p></div>",
    "<article><h1>Title &amp; more</h1><p><b>{0}<br><p>Short.</p><div>One</div>Two<p>{0} <i>x</i> y</p><div class=ads>{0}</div>",
])
def test_templates(body):
    assert ht.extract(PAGE.replace("BODY", body.format(LONG))) == f"Title & more\n{LONG}\nShort.\nOne\nTwo\n{LONG} x y"


def test_long_div_beside_a_short_article():
    """The tag decides only where it holds the bulk of the content text."""
    story = [f"{LONG} Part {i} of the story." for i in range(8)]
    div = "<div class='text'><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in story) + "</div>"
    teaser = "<article><h2>Other</h2><p>One sentence about another story that is a line of content.</p></article>"
    for body in (teaser + div, div + teaser, f"<div>{div}</div><div>{teaser}</div>"):
        got = ht.extract(PAGE.replace("BODY", body)).split("\n")
        assert [x for x in got if x in story] == story and "Title" in got and "Other" in got
        assert not any(w in x for x in got for w in ("aside", "I say", "form", "foot", "cookies"))
    stray = f"<article><h1>Title</h1>{''.join(f'<p>{p}</p>' for p in story)}</article><div><p>{LONG}</p></div>"
    assert ht.extract(PAGE.replace("BODY", stray)).split("\n") == ["Title", *story]


@pytest.mark.parametrize("between", ["<ul>" + "".join(f"<li><a href=/{i}>{i}</a>" for i in range(9)) + "</ul>",
                                     "<table>" + "<tr><td><b>1</b><td><i>2</i>" * 6 + "</table>"])
def test_sections_around_a_run_of_short_lines(between):
    first, second = ([f"{LONG} {name} {i}." for i in range(5)] for name in ("One", "Two"))
    section = lambda ps, more="": "<section>" + "".join(f"<p>{p}</p>" for p in ps) + more + "</section>"
    for body in (section(first, between) + section(second), section(first) + f"<div>{between}</div>" + section(second)):
        got = ht.extract(PAGE.replace("BODY", f"<div>{body}</div>")).split("\n")
        assert got[:5] == first and got[-5:] == second and len(got) > 15


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain", "plain"), ("<nav>only a menu</nav>", ""),
    ("<p>a &lt;b&gt; &#233;&euro;", "a <b> é€"), ("<article>x</article>", "x"), ("<p>a<!-- c --> b</p>", "a b"),
    ("<b><article><p>cut off in the mid", "cut off in the mid"), ("<script>never ends <p>x", ""),
])
def test_odd_pages(page, text):
    assert ht.extract(page) == text


def test_very_long_page_is_whole():
    paragraphs = [f"paragraph {i} of a page that goes on" for i in range(20_000)]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert ht.extract(page) == "\n".join(paragraphs)


def test_smoothing_keeps_a_constant_and_the_order_of_ratios():
    assert ht.smooth(np.full(9, 4.0)) == pytest.approx(np.full(9, 4.0))
    x = np.zeros(11)
    x[5] = 1
    s = ht.smooth(x)
    assert s.argmax() == 5 and s[4] == pytest.approx(s[6]) and s[3] < s[4]


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = ht.extract_pages(pages.selectExpr("*", "'x' AS text", "1 AS n_chars")).collect()
    assert len(got) == len(source)
    for r in got:
        h = source[r.page_id]
        inner = h[h.index("<article>"):h.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_null_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in ht.extract_pages(df).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert ht.extract_pages(df.limit(0)).count() == 0


def brute_weights(lines, sigma=1.0):
    """Ratio, smoothing and threshold by plain loops."""
    ratio = [0.0 if node.boiler else len(text) / max(1, tags) for text, tags, node in lines]
    s = []
    for i in range(len(ratio)):
        k = {j: np.exp(-(i - j) ** 2 / (2 * sigma ** 2)) for j in range(len(ratio)) if abs(i - j) <= 3 * sigma}
        s.append(sum(ratio[j] * w for j, w in k.items()) / sum(k.values()))
    cut = min(np.std(s), np.mean(s))
    return [x if x >= cut - 1e-12 and r > 0 else 0.0 for x, r in zip(s, ratio)]


def brute_container(nodes, weights):
    """Every container tried: the deepest one whose whole way from the root
    holds the share, each on it with two lines at least."""
    def way(n):
        return [] if n is None else way(n.up) + [n]

    def holds(c):
        inside = [w for n, w in zip(nodes, weights) if any(x is c for x in way(n))]
        return len(inside) >= 2 and sum(inside) >= ht.MAIN_SHARE * sum(weights)
    found = {id(c): c for n, w in zip(nodes, weights) if w for c in way(n)
             if all(holds(x) for x in way(c))}
    return max(found.values(), key=lambda c: len(way(c)), default=way(nodes[0])[0])


def _pages(n):
    import duckdb
    return [r[0] for r in duckdb.sql(f"SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id LIMIT {n}").fetchall()]


def without_names(page):
    page = re.sub(r"<(/?)(nav|article|footer|aside|header|main|section|form)\b", r"<\1div", page)
    return re.sub(r' (class|id|role)="[^"]*"', "", page)


def test_weights_and_containers_equal_plain_loops():
    for page in _pages(60):
        for h in (page, without_names(page)):
            p = ht._Lines()
            p.feed(h)
            p.close()
            w = ht.line_weights(p.lines)
            assert list(w) == pytest.approx(brute_weights(p.lines))
            nodes = [n for _, _, n in p.lines]
            if w.any():
                assert ht.main_container(nodes, w) is brute_container(nodes, w)


def test_without_names_the_ratios_find_the_article():
    """No class names, no semantic elements: nothing of the article is lost,
    and menus and adverts stay out of nearly all pages."""
    pages = _pages(250)
    menus = adverts = 0
    for h in pages:
        article = ht.extract(h).split("\n")
        got = ht.extract(without_names(h)).split("\n")
        assert set(article) <= set(got)
        nav = re.findall(r"<li><a[^>]*>([^<]*)</a>", re.search(r"<nav>.*?</nav>", h, re.S)[0])
        advert = re.findall(r'<div class="ad">([^<]*)</div>', h)
        menus += bool((set(nav) - set(article)) & set(got))
        adverts += bool((set(advert) - set(article)) & set(got))
    assert menus <= 0.01 * len(pages) and adverts <= 0.06 * len(pages)


def test_other_weights_give_other_texts(monkeypatch):
    rng = np.random.default_rng(1)
    pages = [without_names(h) for h in _pages(100)]
    before = [ht.extract(h) for h in pages]
    monkeypatch.setattr(ht, "line_weights", lambda lines, sigma=1.0: (rng.random(len(lines)) < .5) * 1.0)
    assert sum(ht.extract(h) != t for h, t in zip(pages, before)) > 50
