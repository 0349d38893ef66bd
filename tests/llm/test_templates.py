"""HTML extraction against a plain reading of the given pages' form, and pages built with known articles."""

from __future__ import annotations

import html
import re

import pytest

from stridelake.llm import templates as T

PAGES = "page_id long, url string, html string, text int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int = 9) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] for i in range(n)) + f" {seed}"


def portal(i: int) -> tuple[str, str]:
    """A page with everything around its article, and the article's text."""
    paragraphs = [f"{sentence(i)} & <more> {i}", sentence(i + 500), sentence(i + 900, 30)]
    body = "".join(f"<p class='t{i}'>{html.escape(p)}\n" for p in paragraphs)
    page = f"""<!doctype html><html><head><title>{sentence(i)}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies {i}</div><header><h2>Site {i}</h2></header><nav><ul>{''.join(f'<li><a href="/{k}">{sentence(i + k, 2)}</a>' for k in range(i % 4 + 2))}</ul></nav>
<div class="layout sidebar-right"><aside><p>{sentence(i + 3)}</p></aside><div class="adBanner">Buy {i}!</div>
<article id="post-{i}"><header><h1>{html.escape(paragraphs[0][:20])}</h1></header>{body}<div class="share-buttons"><span>Tell {i} friends</span></div>
<p>Read more of our reports</p><form><label>Mail</label><input><button>Go {i}</button></form>
<p>Last &eacute; one<br>in <b>bo</b>ld&nbsp;{i}</p></article></div>
<section class="comments"><article class="comment"><p>{sentence(i + 4)}</p></article><article><p>Great {i}</p></article></section>
<footer>&copy; {i}</footer></body></html>"""
    return page, "\n".join([paragraphs[0][:20].strip(), *paragraphs, f"Last é one in bold {i}"])


def bare(i: int) -> tuple[str, str]:
    """A page of a host without any article element."""
    own = [sentence(i), sentence(i + 100, 20)]
    rows = "".join(f"<div>{p}</div>" for p in own)
    page = f"<body><div class='menu'>Menu {i}</div><ul><li><a href=/>Home {i}</a></li></ul><div id=content><div>Welcome to our pages</div>{rows}<table><tr><td>a{i}<td>{i}</table></div><p>All rights kept"
    return page, "\n".join([*own, f"a{i}", str(i)])


def test_given_pages_equal_a_plain_reading(spark):
    from stridelake.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in queries()["op12_html_extraction"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in lines if x)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize("bound", [1 << 25, 0])
def test_templates_of_hosts(spark, monkeypatch, bound):
    """With both ways to join templates."""
    monkeypatch.setattr(T, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(T, "HELD_TOKENS", 50)
    monkeypatch.setattr(T, "HOT_SHARE", 3)
    rows, want = [], {}
    for i in range(24):
        for k, (make, host) in enumerate(((portal, "http://a.example"), (bare, "https://user@B.example:80"))):
            page, want[2 * i + k] = make(i)
            rows.append((2 * i + k, f"{host}/p?{i}", page, 0))
    got = {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == want


def test_few_pages_have_no_template(spark):
    """Texts that all pages share stay while a host has too few different texts, copies of one article among them."""
    page = "<article><p>Same words</p><p>{}</p></article>"
    rows = [(i, "http://few.example/", page.format(i), 0) for i in range(T.MIN_TEXTS - 1)] + [(100 + i, "http://copies.example/", page.format("x") + f"<aside>{i}</aside>", 0) for i in range(30)]
    got = {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(t.startswith("Same words\n") for t in got.values()) and len(got) == len(rows)


def test_nested_class_is_template(spark):
    """A text on every item of a list that grows from page to page shares the item's vector."""
    item = "<section><h3>{}</h3><p>Continue here</p></section>"
    rows = [(i, "http://c.example/", f"<article><h1>{sentence(i)}</h1>{''.join(item.format(sentence(i + 40 * k)) for k in range(1 + i % 3))}</article>", 0) for i in range(12)]
    got = {r.page_id: r.text for r in T.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: "\n".join([sentence(i), *(sentence(i + 40 * k) for k in range(1 + i % 3))]) for i in range(12)}


def test_edges(spark):
    deep = "<div>" * 30000 + "deep" + "</div>" * 30000
    cases = [
        (1, None, None, ""), (2, "u", "", ""), (3, "x", "plain & simple &am &copy", "plain & simple &am ©"), (4, "//h", "<!-- <p>x</p> --><p>a</p><!-- open", "a"), (5, "//h", "<p>1 < 2 <3", "1 < 2 <3"),
        (6, "//h", deep, "deep"), (7, "//h", "<p>" + "long word " * 100000, ("long word " * 100000).strip()), (8, "//h", "<article><b>one<p>two</b><p>three</article>four", "one\ntwo\nthree"),
        (9, "//h", "<p title='a>b'>q</p><script>x", "q"), (10, "//h", "<b title=\"x>lost", "lost"), (11, "//h", "<style>p{}</style>\x00\x0b  w x ", "\x00 w x"), (12, "//h", "<article></article>", ""),
        (13, "//h", "<div class=comments><article>talk</article></div><main>m<p>n</main>", "m\nn"), (14, "//h", "<div role=main>r</div><p>s", "r"), (14, "//h", "<div role=main>r</div><p>s", "r"),
        (None, "//h", "<table><tr><td><p>a<td>b<tr><th>c</table>", "a\nb\nc"),
    ]
    pages = spark.createDataFrame([(p, u, h, 5) for p, u, h, _ in cases], PAGES)
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in T.extract(pages).collect()), key=str)
    assert got == sorted(((p or 0, u, t, len(t)) for p, u, _, t in cases), key=str)
    assert T.extract(pages.limit(0)).count() == 0
