"""Main text of web pages: roles of elements first, then removal of site templates.

A page is parsed leniently into its elements. Elements whose tag or role says that they are not the article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles) are left out, and those with a class or id that consists of
nothing but such words and words of place: ``site-footer`` does, ``has-sidebar`` does not. Where the page marks articles, the
largest one is the page's, and others of at least a quarter of its size; articles within an article are reader comments or
teasers. Where the main part, or three times over the rest of the page, holds more text outside articles, the articles are
teasers and it is read without them.

What no mark gives away is found by repetition: the subtrees of all elements are hashed with the path of tags that leads to
them, and Spark counts in how many pages of its host each hash occurs. Outside a marked article a subtree that recurs in at
least ``TEMPLATE_PAGES`` pages of its host, or in all of at least ``FEW_PAGES``, is site template and is deleted; within one,
where phrases of authors recur as well, it takes ``ARTICLE_PAGES`` pages and ``TEMPLATE_SHARE`` of the pages of the host. Pages
of equal main text count as one there, so copies of an article do not make it a template.

The text of a block has its character references decoded, its white space turned into single spaces, and is trimmed;
blocks follow in page order, joined by line feeds.

Edge cases: a very long page is one row like any other; null or empty html gives an empty text; unclosed, misnested and unknown tags are read as browsers do, more
or less; a null url has the empty host; rows with equal ids are read each on its own; an empty table gives an empty
result.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, stash
from textloom.llm.urlrules import parts

TEMPLATE_PAGES, FEW_PAGES = 5, 3
ARTICLE_PAGES, TEMPLATE_SHARE = 8, 0.6

# Elements by kind, and words in roles, classes and ids of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript template head title nav aside footer form button select option textarea input iframe object canvas svg math dialog menu audio video map datalist noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset("nav navbar navigation menu topbar masthead footer sidebar aside ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget searchform skip".split())
#: Words that may stand beside them in a class or id.
PLACES = frozenset("site page main global top bottom left right upper lower primary secondary inner outer container wrapper wrap box block section area bar list item items link links icon icons button buttons unit slot col column row content header banner post posts article articles js is active open closed fixed sticky mobile desktop large small wide box1 box2".split())
#: In an article these hold its own heading.
HEADERS = frozenset(["header", "banner"])
#: An open element of the first kind ends where one of the second begins, unless one of the third is between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_ENDS_BY = BLOCKS - frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "legend", "figcaption"])
P_SCOPE = frozenset("table td th button object caption html".split())

MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)|<[!?/][^>]*>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Open:
    tag: str
    gone: bool
    start: int
    digest: xxhash.xxh64


@dataclass
class Page:
    """Blocks of text, which of them are the article's, whether these are within a marked article, and the subtrees: (hash,
    first block, end)."""

    blocks: list[str]
    chosen: list[bool]
    marked: bool
    subtrees: list[tuple[int, int, int]]

    def text(self, template: frozenset[int] = frozenset()) -> str:
        dead = np.zeros(len(self.blocks), bool)
        if template:
            for digest, start, end in self.subtrees:
                if digest in template:
                    dead[start:end] = True
        return "\n".join(b for b, c, d in zip(self.blocks, self.chosen, dead, strict=True) if c and not d)

    def hashes(self) -> set[int]:
        return {d for d, start, end in self.subtrees if any(self.chosen[start:end])}


def choose(blocks: list[str], places: list[tuple[bool, int, bool]]) -> tuple[list[bool], bool]:
    """Which blocks are the article's, by their places (in a main part, number of the outermost article, in an inner one),
    and whether they are within marked articles."""
    sizes: dict[int, int] = {}
    for b, (_, article, inner) in zip(blocks, places, strict=True):
        if article and not inner:
            sizes[article] = sizes.get(article, 0) + len(b)
    largest = max(sizes.values(), default=0)
    main = sum(len(b) for b, (m, article, _) in zip(blocks, places, strict=True) if m and not article)
    if main and main > largest:
        return [m and not article for m, article, _ in places], False
    around = sum(len(b) for b, (_, article, _) in zip(blocks, places, strict=True) if not article)
    if not largest or (not main and around > 3 * largest):
        return [not article for _, article, _ in places], False
    return [not inner and 4 * sizes.get(article, 0) >= largest for _, article, inner in places], True


def not_the_article(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes.strip():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True
        if name == "role" and value.strip().lower() in ROLES and not (in_article and value.strip().lower() in HEADERS):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                found = {w.lower() for w in WORD.findall(token)} or {token.lower()}
                if token.lower() in WORDS or (found & WORDS and found <= WORDS | PLACES) or (not in_article and (token.lower() in HEADERS or (found & HEADERS and found <= PLACES))):
                    return True
        elif name in ("class", "id") and tag == "article" and {"comment", "comments", "reply", "advert", "ad", "sponsored", "promo"} & {w.lower() for w in WORD.findall(value)}:
            return True
    return False


def parse(source: str | None) -> Page:
    source = source or ""
    blocks: list[str] = []
    places: list[tuple[bool, int, bool]] = []
    subtrees: list[tuple[int, int, int]] = []
    stack = [Open("", False, 0, xxhash.xxh64(seed=1))]
    buffer: list[str] = []
    depth = {"gone": 0, "article": 0, "main": 0}
    articles = 0

    def flush() -> None:
        if buffer:
            text = " ".join(references.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append(text)
                places.append((depth["main"] > 0, articles if depth["article"] else 0, depth["article"] > 1))
                stack[-1].digest.update(b"\x00" + text.encode("utf-8", "surrogatepass"))

    def pop() -> None:
        top = stack[-1]
        if top.tag in BLOCKS:
            flush()
        stack.pop()
        depth["gone"] -= top.gone
        if top.tag in depth:
            depth[top.tag] -= 1
        if top.tag in BLOCKS and not depth["gone"] and not top.gone and len(blocks) > top.start:
            digest = top.digest.intdigest()
            placed = xxhash.xxh64_intdigest(digest.to_bytes(8, "little") + "/".join(e.tag for e in stack[-8:]).encode())
            subtrees.append((placed - (1 << 64) if placed >> 63 else placed, top.start, len(blocks)))
            owner = next(e for e in reversed(stack) if e.tag in BLOCKS or not e.tag)
            owner.digest.update(b"\x01" + top.tag.encode() + top.digest.digest())

    def close_to(wanted: frozenset[str], barrier: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in wanted:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in barrier:
                return

    at, n = 0, len(source)
    while at < n:
        m = MARKUP.search(source, at)
        if m is None:
            if not depth["gone"]:
                buffer.append(source[at:])
            break
        if m.start() > at and not depth["gone"]:
            buffer.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        cut = source.find(">", at)
        at = n if cut < 0 else cut + 1
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                buffer.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:
                    break
            continue
        if tag in P_ENDS_BY:
            close_to(frozenset(["p"]), P_SCOPE)
        if tag in ENDS:
            close_to(*ENDS[tag])
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "wbr"):
            buffer.append(" " if tag == "br" else "")
        if tag in VOID:
            continue
        gone = not_the_article(tag, attributes, depth["article"] > 0 or depth["main"] > 0)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            at = n if end is None else end.start()
            if end is not None:
                cut = source.find(">", at)
                at = n if cut < 0 else cut + 1
            continue
        if attributes.endswith("/") and tag in ("svg", "math", "path"):
            continue
        stack.append(Open(tag, gone, len(blocks), xxhash.xxh64(tag.encode(), seed=1)))
        depth["gone"] += gone
        if tag in depth and tag != "gone":
            depth[tag] += 1
            articles += tag == "article" and depth["article"] == 1
    while len(stack) > 1:
        pop()
    flush()
    chosen, marked = choose(blocks, places)
    return Page(blocks, chosen, marked, subtrees)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The subtrees to delete: a row (host, subtrees) for each host that has any."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [parse(h) for h in b.column(1).to_pylist()]
        hosts = [parts(u)[0] for u in b.column(0).to_pylist()]
        mains = np.array([xxhash.xxh64_intdigest(p.text().encode("utf-8", "surrogatepass")) for p in found], np.uint64).view(np.int64)
        marked = pa.array([p.marked for p in found], pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(mains), marked, pa.array([list(p.hashes()) for p in found], pa.list_(pa.int64()))], ["host", "main", "marked", "subtrees"])

    read = arrow_map(pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), batch, "host string, main long, marked boolean, subtrees array<long>")
    read = stash(read, "subtrees")
    hosts = read.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= FEW_PAGES)
    each = read.select("host", "main", "marked", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree", "marked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FEW_PAGES)
    n, all_ = F.col("n"), F.col("pages")
    recurs = F.when(F.col("marked"), (n >= ARTICLE_PAGES) & (n >= TEMPLATE_SHARE * all_)).otherwise((n >= TEMPLATE_PAGES) | (n >= all_))
    return each.join(hosts, "host").where(recurs).groupBy("host").agg(F.collect_set("subtree").alias("subtrees"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row (id, url, text) for each row of ``pages``."""
    found = stash(templates(pages, url_col, html_col), "templates")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = rows.withColumn("host", host).join(found, "host", "left").select("id", "url", "html", "subtrees")

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [parse(h).text(frozenset(t or ())) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return arrow_map(joined, batch, f"id {kinds['id']}, url {kinds['url']}, text string")
