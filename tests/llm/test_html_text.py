from __future__ import annotations

import pytest

from finlens.llm import html_text as H
from tests.llm.helpers import by_id, with_clashes

PAGES = "page_id bigint, url string, html string"

ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- ad --><div class="ad">Buy</div><article><header><h1>Title&nbsp;one</h1><span>by X</span></header>
<p>First <b>bold
 text<br><p>Second &lt;x&gt; &eacute;.</p><aside>Side</aside><div class="share-bar">Share</div>
<ul><li>one<li>two</ul><form><input>Name</form><table><tr><td>a<td>b<tr><td>c</table></article>
<section id="comments"><article class="comment"><p>I agree</p></article></section>
<div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def test_article_of_a_full_page():
    assert H.Page(ARTICLE).text() == "Title one\n\nFirst bold text\n\nSecond <x> é.\n\none\n\ntwo\n\na b\n\nc"


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("</p></div>x<", "x<"),
    ("<div>Hello <b>w</b>orld<br>x</div>", "Hello world x"),
    ("<body><div class='no-sidebar'>only text</div>", "only text"),
    ("<main><h1>T</h1><p>x</p><div class='comments'><article>c</article></div></main><p>out</p>", "T\n\nx"),
    ("<p hidden>z</p><p style='display: none'>y</p><p aria-hidden=true>w</p><div role=navigation>n</div><p>t", "t"),
    ("<textarea><p>no</textarea><script>if (a<b) {}</script>yes", "yes"),
    ("<a title='1 > 2'>link</a> <a title='odd>end", "link end"),
    ("<div>" * 3000 + "deep", "deep"), ("<a" * 3000, "<a" * 3000), ("&#233;&#x41;&bogus;", "éA&bogus;"),
    ("a　b\t\n c", "a b c"), ("<title>x</title><h2>head</h2>", "head"),
])
def test_small_pages(source, text):
    assert H.Page(source).text() == text


def test_site_templates_go_and_content_stays(spark):
    """Unmarked boilerplate on every page of a host goes; the same text on
    another host, and paragraphs some pages share, stay."""
    rows = [(i, f"http://A.com/{i}", f"<div><p>Welcome to our site</p></div><div><h2>News</h2><p>text {i}</p>"
             + ("<p>shared by few</p>" if i % 4 == 0 else "") + "</div>") for i in range(40)]
    rows += [(100 + i, f"http://b.com/{i}", f"<p>Welcome to our site</p><p>other {i}</p>") for i in range(3)]
    rows += [(200, None, "<p>no host</p>"), (201, "x", None), (202, "http://a.com/", "")]
    df = with_clashes(spark.createDataFrame(rows, PAGES))
    got = by_id(H.main_text(df), "page_id")
    assert got[0].text == "News\n\ntext 0\n\nshared by few" and got[1].text == "News\n\ntext 1"
    assert got[100].text == "Welcome to our site\n\nother 0"
    assert (got[200].text, got[201].text, got[202].text) == ("no host", "", "")
    assert got[1].n_chars == len(got[1].text) and got[0].url == "http://A.com/0"


def test_repeated_pages_keep_their_article(spark):
    page = "<article><h1>Same</h1><p>Article text</p></article><div>Chrome</div>"
    df = spark.createDataFrame([(1, "http://a.com/", page)] * 30, PAGES)
    templates = H.site_templates(df.selectExpr("'a.com' host", "html")).collect()
    assert len(templates) == 1 and len(templates[0]["keys"]) == 3  # heading, paragraph and chrome
    assert {r.text for r in H.main_text(df).collect()} == {"Same\n\nArticle text"}


def test_repeated_boxes_inside_articles_go(spark):
    page = "<article><h1>Page {0}</h1><p>Shared line</p><p>own {0}</p><div><p>Read our guide</p></div></article>"
    df = spark.createDataFrame([(i, "http://a.com/", page.format(i)) for i in range(30)], PAGES)
    got = by_id(H.main_text(df), "page_id")
    assert got[7].text == "Page 7\n\nShared line\n\nown 7"


def test_templates_of_a_part_of_a_host_go(spark):
    """A box on all pages of a small part of a mixed host (one language) is
    template there; a box on few pages is not, nor a chance repeat under the
    small share."""
    rows = [(i, f"http://a.com/{i}", f"<div><p>text {i}</p></div>" + ("<div><p>Lisez notre guide</p></div>" if i < 40 else "")
             + ("<div><p>on few pages</p></div>" if i % 40 == 1 else "")) for i in range(320)]
    df = spark.createDataFrame(rows, PAGES)
    got = by_id(H.main_text(df), "page_id")
    assert got[7].text == "text 7" and got[1].text == "text 1\n\non few pages" and got[300].text == "text 300"
    got = by_id(H.main_text(df, many_share=0.2), "page_id")
    assert got[7].text == "text 7\n\nLisez notre guide"


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], PAGES)).collect() == []


def test_menus_with_changing_links_are_templates(spark):
    """Unmarked menus, and named parts outside an article, recur by shape
    though their words differ; lists of links in an article stay."""
    def menu(i, tag="div"):
        return f"<{tag}>" + "".join(f"<span><a href=/{k}>w{i}x{k}</a></span>" for k in range(3 + i % 4)) + f"</{tag}>"

    rows = [(i, f"http://a.com/{i}", menu(i) + f"<div><p>text {i}</p><p><a href=x>one link {i}</a></p></div>") for i in range(40)]
    rows += [(100 + i, f"http://b.com/{i}", f"<div class='x{i}'>frame {i}</div><article><p>words {i}</p>{menu(i, 'ul')}</article>"
              f"<footer>host {i}</footer>") for i in range(40)]
    got = by_id(H.main_text(spark.createDataFrame(rows, PAGES)), "page_id")
    assert got[5].text == "text 5\n\none link 5"
    assert got[105].text.startswith("words 105"[:6] + "5") and "w5x0" in got[105].text and "frame" not in got[105].text


def brute_templates(pages, min_pages, min_share, many_pages, many_share):
    """host -> keys, counted page by page."""
    from collections import Counter, defaultdict

    seen, size = defaultdict(Counter), Counter()
    for host, html in pages:
        size[host] += 1
        seen[host].update(H.Page(html or "").subtrees())
    return {h: {k for k, n in c.items() if n >= min_pages and n >= min_share * size[h]
                or n >= many_pages and n >= many_share * size[h]} for h, c in seen.items()}


def test_table_equals_brute_force_per_host(spark, small_dir):
    """Texts and templates of the whole table, host by host; most deletions
    come from templates, and without them the rules find the same article."""
    from finlens.llm.queries import QUERIES

    rows = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    host = {r.page_id: (r.url or "").split("://", 1)[-1].split("/")[0].split("?")[0].split("#")[0].lower() for r in rows}
    templates = brute_templates([(host[r.page_id], r.html) for r in rows], H.MIN_PAGES, H.MIN_SHARE, H.MANY_PAGES, H.MANY_SHARE)
    got = by_id(QUERIES["op1_html_main_text"](spark, small_dir), "page_id")
    by_template = by_rule = 0
    for r in rows:
        keys = frozenset(k.to_bytes(8, "big", signed=True) for k in templates[host[r.page_id]])
        page = H.Page(r.html or "")
        assert got[r.page_id].text == page.text(keys)
        a, b = page.removals(keys)
        by_template, by_rule = by_template + a, by_rule + b
    assert len(got) == len(rows) and by_template + by_rule > 0


def test_a_very_long_page(spark):
    body = "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(60_000))
    df = spark.createDataFrame([(1, "http://a.com/", f"<nav><a>x</a></nav><article>{body}</article>")], PAGES)
    text = H.main_text(df).first().text
    assert text.count("\n\n") == 59_999 and text.endswith("paragraph 59999 & more")
