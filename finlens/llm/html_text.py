"""Main text of web pages: site template removal plus element rules.

1. Every page is parsed to its elements; each element with content gets a hash
   of its subtree (tag, text, children).  Parts that differ in their words
   only, as menus do from page to page, get a second one of their shape (tags,
   class and id names, equal neighbours once, no text): elements outside the
   article that have a name, are a landmark (navigation, footer, ...), or hold
   at least ``MENU_LINKS`` links and no text beside them.
2. Spark counts, per host, the pages that hold each hash.  A subtree is
   template on ``MANY_PAGES`` pages of its host, however large the host, if
   they are ``MANY_SHARE`` of them (a guard against short texts that recur by
   chance on very large hosts), or on ``MIN_PAGES`` that are ``MIN_SHARE`` of a
   small host.  Counts are partially aggregated, so a hot host costs no more
   per task than any other.
3. The (host, hash) rows of templates are joined to the pages' own hashes, so
   a page gets the templates it holds, never a list of its host.  Each page is
   parsed once more with these; template subtrees are deleted, then what the
   rules below still find, and the text of the article is read off.  Pages meet their hashes by a
   digest of host and source, so copies share one row.

The article is the content of ``article`` elements, else of ``main``, else of
the whole body.  Dropped: navigation, page headers and footers (a header's
headings inside an article stay), asides, forms, scripts, styles, hidden
parts, and elements whose class, id or role names a menu, sidebar, notice,
advert, share bar, related links or reader comments, unless they hold the
article.  Article, main, what holds them, headings, and an article's running text
(paragraphs, list items) are never template, however many pages share them.

Text: character references are decoded, white space inside a block becomes
one space, blocks are joined in page order by an empty line.

Defined results: null and empty pages, and pages without text, give an empty
string; broken markup never fails (unclosed elements end with the page, stray
end tags are passed over); a page without an address belongs to host ''.
Repeated pages are pages of their own.  Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlens.llm.store import pick, save
from finlens.llm.url_filter import host_and_path

MIN_PAGES, MIN_SHARE = 8, 0.5
MANY_PAGES, MANY_SHARE = 32, 0.01
MENU_LINKS = 3

# comments, declarations, tags; a tag whose quotes do not pair ends at the next >
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|$))|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_DROP = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button "
    "select textarea input datalist dialog menu title".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody "
    "tfoot thead tr ul caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset("nav header footer aside form menu".split())
_NO_TEXT = frozenset("head script style noscript template title meta".split())
# inside an article only these can be template; its running text never is
_CONTAINERS = frozenset("center details div dl fieldset figure ol section table ul".split())
# an opening tag ends the nearest open one of these, if no barrier lies between
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_P_BARRIER = frozenset("table td th caption button object article section main aside div body html li blockquote".split())
_CLOSES_P = _BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "caption", "option", "legend"}
_END_BARRIER = frozenset("table article main body html".split())

_BOILERPLATE = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies disqus discussion footer gdpr login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notification pager pagination paywall popup promo promoted recommended related "
    "replies respond search share sharing sidebar signin signup social sponsor sponsored subscribe subscription tags "
    "teaser toolbar topbar widget widgets".split())
_PAIRS = frozenset({("side", "bar"), ("nav", "bar"), ("skip", "link"), ("sign", "up"), ("log", "in"), ("pop", "up"),
                    ("also", "like"), ("read", "more"), ("top", "bar")})
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                   "toolbar note".split())


class Page:
    """Elements (parent, tag, what the rules say, subtree hash) and the text
    pieces in page order, with block boundaries between them."""

    def __init__(self, source: str):
        self.parent, self.tag, self.dropped, self.header = [-1], [""], [False], [False]
        self.key: list[bytes] = [b""]
        self.shape: list[bytes] = [b""]
        self.items: list[tuple[int, str] | None] = []
        self._parts: list[list[bytes]] = [[]]
        # names of the element, shapes of its children, links in it, text beside them
        self._name, self._shapes, self._links, self._loose = [""], [[]], [0], [False]
        self._stack = [0]
        self._parse(source)

    def _text(self, raw: str) -> None:
        text = unescape(raw)
        at = self._stack[-1]
        self.items.append((at, text))
        words = " ".join(text.split())
        if words:
            self._parts[at].append(words.encode("utf-8", "surrogatepass"))
            self._loose[at] = True

    def _close(self) -> None:
        at = self._stack.pop()
        body = b"\x00".join([self.tag[at].encode("utf-8", "surrogatepass"), *self._parts[at]])
        self.key[at] = blake2b(body, digest_size=8).digest()
        if self._parts[at]:
            up = self.parent[at]
            self._parts[up].append(self.key[at])
            if self.tag[at] == "a":
                self._links[at], self._loose[at] = 1, False
            self._links[up] += self._links[at]
            self._loose[up] = self._loose[up] or self._loose[at]
            name = f"shape {self.tag[at]} {self._name[at]}".encode("utf-8", "surrogatepass")
            self.shape[at] = blake2b(b"\x00".join([name, *self._shapes[at]]), digest_size=8).digest()
            if self._shapes[up][-1:] != [self.shape[at]]:
                self._shapes[up].append(self.shape[at])
        if self.tag[at] in _BLOCK:
            self.items.append(None)

    def _close_nearest(self, tags, barrier) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in tags:
                while len(self._stack) > depth:
                    self._close()
                return
            if tag in barrier:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P:
            self._close_nearest({"p"}, _P_BARRIER)
        if tag in _CLOSES:
            self._close_nearest(*_CLOSES[tag])
        if tag in _BLOCK:
            self.items.append(None)
        if tag in ("br", "td", "th"):
            self.items.append((self._stack[-1], " "))
        if tag in _VOID:
            return
        dropped, header = _judged(tag, attributes)
        self.parent.append(self._stack[-1])
        self.tag.append(tag)
        self.dropped.append(dropped)
        self.header.append(header)
        self.key.append(b"")
        self.shape.append(b"")
        self._parts.append([])
        self._name.append(_names(attributes) if attributes.strip(" /") else "")
        self._shapes.append([])
        self._links.append(0)
        self._loose.append(False)
        self._stack.append(len(self.tag) - 1)

    def _parse(self, source: str) -> None:
        at, end = 0, len(source)
        last = source.rfind(">")
        while at < end:
            found = _TOKEN.search(source, at) if at <= last else None
            if not found:
                break
            if found.start() > at:
                self._text(source[at:found.start()])
            at = found.end()
            name = found[2]
            if not name:
                continue
            tag = name.lower()
            if found[1]:
                if tag == "p" and not any(self.tag[i] == "p" for i in self._stack):
                    self.items.append(None)
                barrier = _END_BARRIER - {tag} if tag not in ("body", "html") else frozenset()
                self._close_nearest({tag}, barrier)
                continue
            self._open(tag, found[3])
            if tag in _RAW:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                at = stop.start() if stop else end
                self._close()
                if stop:
                    gt = source.find(">", at)
                    at = gt + 1 if gt >= 0 else end
        if at < end:
            self._text(source[at:])
        while len(self._stack) > 1:
            self._close()

    def _holders(self) -> list[bool]:
        """Elements that are, or hold, the article or main part: those no rule
        drops, else those inside a part that only its class or role drops."""
        holds = [False] * len(self.tag)
        for strict in (True, False):
            for i, tag in enumerate(self.tag):
                if tag in ("article", "main") and not self.dropped[i] and not holds[i]:
                    j, path = i, []
                    while j > 0 and not holds[j] and not (self.dropped[j] and (strict or self.tag[j] in _DROP)):
                        path.append(j)
                        j = self.parent[j]
                    if j == 0 or holds[j]:
                        for j in path:
                            holds[j] = True
            if any(holds):
                break
        return holds

    def _has_shape(self, i: int, has_article: bool) -> bool:
        """Whether an element outside the article counts by its shape too."""
        named = self._name[i] or self.tag[i] in _LANDMARKS
        return bool(has_article and named or self._links[i] >= MENU_LINKS and not self._loose[i])

    def _judge(self, template: frozenset[bytes], only_tags: bool = False):
        """Per element: silent (deleted, or in a header outside the article's
        headings), inside an article, inside article or main, holding one, and
        what deletes it itself (2 template, 1 rule, 0 nothing)."""
        holds, n = self._holders(), len(self.tag)
        silent, gone, heading, header = ([False] * n for _ in range(4))
        article, scope, route = [False] * n, [False] * n, [0] * n
        has_article = any(holds)
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            free = holds[i] or tag in ("html", "body")
            heading[i] = heading[up] or tag in _HEADINGS
            article[i] = article[up] or tag == "article" and holds[i]
            scope[i] = article[i] or scope[up] or tag == "main" and holds[i]
            if not free and not gone[up]:
                ruled = self.dropped[i] and (not only_tags or tag in _DROP)
                fixed = heading[i] or scope[i] and tag not in _CONTAINERS
                if self._parts[i] and template and (
                        not fixed and self.key[i] in template
                        or not heading[i] and not scope[i] and self.shape[i] in template and self._has_shape(i, has_article)):
                    route[i] = 2
                elif ruled:
                    route[i] = 1
            gone[i] = gone[up] or route[i] > 0
            header[i] = not free and (header[up] or self.header[i])
            silent[i] = gone[i] or header[i] and not (heading[i] and scope[i])
        return silent, article, scope, holds, route

    def subtrees(self) -> set[int]:
        """Hashes of the elements with content, of text and of shape."""
        _, _, scope, holds, _ = self._judge(frozenset())
        has_article, found = any(holds), set()
        for i in range(1, len(self.tag)):
            if self._parts[i] and not holds[i] and self.tag[i] not in ("html", "body") and self.tag[i] not in _NO_TEXT:
                found.add(int.from_bytes(self.key[i], "big", signed=True))
                if not scope[i] and self._has_shape(i, has_article):
                    found.add(int.from_bytes(self.shape[i], "big", signed=True))
        return found

    def removals(self, template: frozenset[bytes] = frozenset()) -> tuple[int, int]:
        """Elements with content that templates delete, and that only a rule
        deletes."""
        route = self._judge(template)[4]
        kept = [r for r, parts, tag in zip(route, self._parts, self.tag, strict=True) if parts and tag not in _NO_TEXT]
        return kept.count(2), kept.count(1)

    def _read(self, silent: list[bool], scope: list[bool] | None) -> str:
        blocks, open_ = [], []
        for item in [*self.items, None]:
            if item is None:
                block = " ".join("".join(open_).split())
                if block:
                    blocks.append(block)
                open_ = []
            elif not silent[item[0]] and (scope is None or scope[item[0]]):
                open_.append(item[1])
        return "\n\n".join(blocks)

    def text(self, template: frozenset[bytes] = frozenset()) -> str:
        """The article's text; a page whose every part is ruled out by class
        names falls back to the element rules alone."""
        silent, article, scope, _, _ = self._judge(template)
        for part in (article, scope, None):
            if part is None or any(part):
                found = self._read(silent, part)
                if found:
                    return found
        return self._read(self._judge(template, only_tags=True)[0], None)


def _names(attributes: str) -> str:
    """Class and id names of an element, numbers blanked."""
    values = [m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id")]
    return " ".join(re.sub(r"\d+", "0", v) for v in values).strip()


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """(dropped by the rules, is a header) of an element."""
    if tag in _DROP:
        return True, False
    header = tag == "header"
    if tag in ("html", "body", "article", "main") and "comment" not in attributes.lower() or not attributes.strip(" /"):
        return False, header
    names: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = [w.lower() for w in _NAME.findall(value)]
            names += words
            if _BOILERPLATE.intersection(words) or _PAIRS.intersection(zip(words, words[1:])):
                return True, False
        elif name == "role" and value.lower() in _ROLES:
            return True, False
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
    return False, header or "header" in names


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [list(Page(html.as_py() or "").subtrees()) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page"), batch.column("host"), pa.array(keys, pa.list_(pa.int64()))], names=["page", "host", "keys"])


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(page, host, keys): the subtree hashes of each row of ``pages`` (page,
    host, html)."""
    return pages.select("page", "host", "html").mapInArrow(_subtrees, "page binary, host string, keys array<bigint>")


def template_keys(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                  many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """(host, key): the template subtrees, of ``subtrees`` (host, keys)."""
    n, pages, least = F.col("n"), F.col("pages"), min(min_pages, many_pages)
    seen = subtrees.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(
        F.count(F.lit(1)).alias("n")).where(n >= least)
    sizes = subtrees.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(pages >= least)
    few = (n >= min_pages) & (n >= min_share * pages)
    many = (n >= many_pages) & (n >= many_share * pages)
    return seen.join(sizes, "host").where(few | many).select("host", "key")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                   many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """(host, keys): the template subtrees of ``pages`` (host, html) as lists,
    to look at; ``main_text`` needs no list of a host."""
    found = page_subtrees(pages.withColumn("page", F.lit(None).cast("binary")))
    return template_keys(found, min_pages, min_share, many_pages, many_share).groupBy("host").agg(
        F.collect_list("key").alias("keys"))


def _extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, keys in batches:
        out = []
        for source, found in zip(html, keys, strict=True):
            template = frozenset(k.to_bytes(8, "big", signed=True) for k in found.as_py() or ())
            out.append(Page(source.as_py() or "").text(template))
        yield pa.array(out, pa.string())


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
              many_pages: int = MANY_PAGES, many_share: float = MANY_SHARE) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    pages = pick(df, id=id_col, _u=url_col, html=html_col)
    pages = pages.withColumn("host", host_and_path(F.col("_u"))[0]).withColumn("host", F.coalesce("host", F.lit("")))
    pages = pages.withColumn("page", F.unhex(F.md5(F.concat_ws("\n", F.length("host"), "host", "html").cast("binary"))))
    subtrees = save(page_subtrees(pages), "page-subtrees")
    templates = save(template_keys(subtrees, min_pages, min_share, many_pages, many_share), "site-templates")
    own = subtrees.select("page", "host", F.explode("keys").alias("key")).join(templates, ["host", "key"])
    own = own.groupBy("page").agg(F.collect_set("key").alias("keys"))
    rows = pages.join(own.withColumnsRenamed({"page": "_page"}), F.col("page") == F.col("_page"), "left")
    text = F.arrow_udf(_extract, "string")("html", "keys")
    return rows.select(F.col("id").alias(id_col), F.col("_u").alias(url_col), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))
