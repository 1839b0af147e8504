"""HTML extraction by composite text density.

Every node of the page's tree gets a density: its characters per tag, adjusted by how much of them is link text
(``C / T`` times a logarithm of ``C/LC * T/LT`` to a base that grows with the share of link text).  The density
sum of a node adds its children's densities.  The node of the greatest sum is the core; the least density on the
path from it to the body is the threshold.  Subtrees that reach the threshold are content, so that sections beside
the core are kept, and so are headings and loose text beside them.  Elements that only style a line (``b``, ``span``) don't count as tags.  The densities
alone choose; ``article`` and ``main`` have no say.

What doesn't belong to the article is cut before: by tag (menus, forms, scripts ...), by role, or by name.  A class or id counts
as a name when every part of it is one of the words below (``cookie-notice``, ``site-footer``), so ``has-sidebar``,
``comments-open`` or ``related-work`` cut nothing.  No cut takes the page with it: an element with more than half of the page's plain text (nine
tenths for names that leave no doubt, such as comments) is never cut by name, and a menu, form, dialog, header, footer or aside that holds more than half of the plain text
and four fifths of that in paragraphs and headings stays, so a form around the whole page, an open dialog or a menu that is never closed loses no article; their links and controls have
no density.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one line feed.

Edge cases: null and empty html, and pages without text, give an empty text.  Unclosed and stray tags are mended as browsers do for
the common cases (paragraphs, list items, table cells); bogus markup (``<![``, ``<?``) is a comment; an unclosed
comment or script reaches to the end.  Work grows in proportion to the page, however deep or broken it is, without recursion.
Of equal density sums the first node in page order is the core.  Repeated rows are each extracted.  A column ``text`` of
``pages`` is replaced; other columns stay as they are.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.batches import map_rows, table

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not markup, and is never part of an article.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style title textarea iframe xmp noembed noframes".split()}
#: Elements whose text is never part of an article, and those that may hold a whole page by mistake or design.
CUT = set("head noscript template svg button select".split())
BESIDES = set("nav header footer aside form dialog menu".split())
PROSE = set("p pre blockquote h1 h2 h3 h4 h5 h6".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot "
            "th thead tr ul caption".split())
#: Elements that only style a line; they don't count as tags.
STYLE = set("abbr b bdi bdo big br cite code del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strong strike sub sup time tt u var wbr".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"base", "link", "meta", "noscript", "template", *RAW}
#: What an opening tag closes when it is still open, and where the search for it ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ROLES = set("alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names of what is not the article: those that leave no doubt, and those that may also name a layout.
SURE = set("ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment commentlist comments consent "
           "cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter overlay pager pagination popup promo "
           "promos promotion replies reply respond sidebar signup sponsor sponsored sponsors subscribe subscription toolbar".split())
WEAK = set("alert alerts banner header login notice notices recommended recommendations related search share sharing social widget "
           "widgets".split())
#: Words that may stand beside them in a name without changing its meaning.
BESIDE = set("area articles author avatar bar bars block body bottom box button buttons col container count desktop element fixed form "
             "global group head heading icon icons info inline inner item items js left links list lower main meta message mini mobile "
             "module outer page panel policy posts primary privacy reader readers right row secondary section side site slot sticky "
             "stories text thread title top unit upper user users view visitor wrap wrapper".split())
ANY = re.compile("|".join(sorted(SURE | WEAK, key=len, reverse=True)), re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TAG = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+|=)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=["'>])))?""")


def tag_end(html: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at ``at``, and the place behind the tag."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(html, at):
        name, value, at = m[1].lower(), m[2], m.end()
        if value == "" and html[at : at + 1] in ("'", '"'):  # a quote that nothing closes: the tag ends at its next >
            end = html.find(">", at)
            return found, len(html) if end < 0 else end + 1
        if name in ("class", "id", "role"):
            found.setdefault(name, (value or "").strip("\"'"))
        if at < len(html) and html[at] == ">":
            return found, at + 1
        if at > last[">"]:
            break
    end = html.find(">", at) if at <= last[">"] else -1
    return found, len(html) if end < 0 else end + 1


def pieces(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """(text, "", None), ("", name, attributes) and ("", "/name", None) in page order."""
    at, size, last = 0, len(html), {">": html.rfind(">")}
    while at < size:
        open_at = html.find("<", at)
        if open_at != at:
            yield html[at : size if open_at < 0 else open_at], "", None
            if open_at < 0:
                return
        at = open_at
        close = html.startswith("</", at)
        if name := TAG.match(html, at + 1 + close):
            tag = name[0].lower()
            attributes, at = tag_end(html, name.end(), last)
            yield "", f"/{tag}" if close else tag, None if close else attributes
            if tag in RAW and not close:
                end = RAW[tag].search(html, at)
                at = end.start() if end else size
        elif html.startswith("<!--", at):
            end = at + 4 if html.startswith((">", "->"), at + 4) else html.find("-->", at + 4)
            at = size if end < 0 else html.find(">", end) + 1
        elif close or html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = size if end < 0 else end + 1
        else:
            yield "<", "", None
            at += 1


def named(names: str) -> int:
    """2 if a class or id surely names something else than an article, 1 if it may, else 0."""
    most = 0
    if ANY.search(names):
        for name in names.split():
            parts = [p.lower() for p in PARTS.findall(name.split("--")[0])]
            if all(p in SURE or p in WEAK or p in BESIDE or p.isdigit() for p in parts):
                most = max([most, *(2 if p in SURE else 1 for p in parts if p in SURE or p in WEAK)])
    return most


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "aside", "mark", "chars", "tags", "link_chars", "link_tags", "prose", "headings", "density", "sum")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.cut, self.aside, self.mark = tag, parent, [], False, False, 0


class Tree:
    """The page as nodes below ``top``; children are nodes or strings, in page order."""

    def __init__(self, html: str) -> None:
        self.top = Node("body", None)
        self.stack, self.places, self.blocks = [self.top], defaultdict(list), [0]
        for text, tag, attributes in pieces(html):
            if text:
                if self.places["head"] and not text.isspace():
                    self.close(self.places["head"][-1])
                self.stack[-1].children.append(unescape(text) if "&" in text else text)
            elif tag[0] == "/":
                self.end(tag[1:])
            else:
                self.start(tag, attributes)

    def close(self, depth: int) -> None:
        """Close all elements from ``depth`` of the stack on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if self.places["head"] and tag not in IN_HEAD:
            self.close(self.places["head"][-1])
        if tag in ("html", "body"):
            return
        if tag in ENDS_P and self.places["p"] and self.places["p"][-1] > self.blocks[-1]:
            self.close(self.places["p"][-1])
        if tag in CLOSES and (found := self.nearest(CLOSES[tag][0])) > self.nearest(CLOSES[tag][1]):
            self.close(found)
        node = Node(tag, self.stack[-1])
        node.cut = tag in CUT
        node.aside = tag in BESIDES or attributes.get("role", "").lower() in ROLES
        if tag == "header" and self.places["article"]:
            node.aside = None  # decided by its headings
        if tag not in ("article", "main"):
            node.mark = named(attributes.get("class", ""))
            if tag not in HEADINGS and node.mark < 2:
                by_id = named(attributes.get("id", ""))
                node.mark = max(node.mark, by_id if tag != "section" or by_id == 2 else 0)
        self.stack[-1].children.append(node)
        if tag not in VOID and tag not in RAW:
            self.places[tag].append(len(self.stack))
            if tag in BLOCK and tag != "p":
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def end(self, tag: str) -> None:
        """An end tag closes its element, but one inside a line closes none around the block it stands in."""
        if found := self.places[tag]:
            if tag in BLOCK or found[-1] > self.blocks[-1]:
                self.close(found[-1])


def in_order(top: Node) -> list[Node]:
    """Nodes below and with ``top`` that aren't cut, parents first."""
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.cut]
    return out


def count(nodes: list[Node]) -> None:
    """Characters and tags below each node, those of links, and headings and the plain characters of prose."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = node.prose = node.headings = 0
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(" ".join(child.split()))
            elif not child.cut:
                node.chars += child.chars
                node.tags += child.tags + (child.tag not in STYLE)
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
                node.prose += child.prose
                node.headings += child.headings + (child.tag in HEADINGS)
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag in PROSE:
            node.prose = plain(node)


def plain(node: Node) -> int:
    return node.chars - node.link_chars


def cut_asides(top: Node) -> None:
    """Settle which menus, forms, headers and named elements are cut."""
    nodes = in_order(top)
    count(nodes)
    for node in nodes:
        if node.aside is None:
            node.cut = not node.headings
        elif node.aside:
            holds_page = plain(node) * 2 > plain(top) and node.prose * 5 >= top.prose * 4 > 0
            node.cut = not holds_page
    nodes = in_order(top)
    count(nodes)
    for node in nodes:
        if node.mark and plain(node) * 10 <= plain(top) * (9 if node.mark == 2 else 5):
            node.cut = True


def measure(top: Node) -> list[Node]:
    """Densities and density sums of all nodes of the body."""
    nodes = in_order(top)
    count(nodes)
    share = top.link_chars / max(1, top.chars)
    for node in reversed(nodes):
        chars, tags, linked = node.chars, max(1, node.tags), max(1, node.link_chars)
        node.density = 0.0
        if chars:
            base = math.log(chars / max(1, chars - node.link_chars) * node.link_chars + share * chars + math.e)
            ratio = chars / linked * tags / max(1, node.link_tags)
            node.density = chars / tags * max(0.0, math.log(max(ratio, 1.0), base) if base > 1 else math.log(max(ratio, 1.0)))
        node.sum = sum(c.density for c in node.children if not isinstance(c, str) and not c.cut)
        if any(isinstance(c, str) and not c.isspace() for c in node.children):
            node.sum = max(node.sum, node.density)  # its own text makes it a leaf of the text as well
    return nodes


def content(top: Node) -> tuple[set[Node], set[Node]]:
    """Nodes on the way to the article, and those that belong to it whole."""
    cut_asides(top)
    core = max(measure(top), key=lambda n: n.sum)
    path = [core]
    while path[-1] is not top:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    way, whole, stack = set(path[1:]), {core}, [top]
    while stack:
        node = stack.pop()
        if node in way:
            stack += [c for c in node.children if not isinstance(c, str) and not c.cut]
        elif node.density >= threshold > 0 or node.tag in HEADINGS or node.tag not in BLOCK:
            whole.add(node)
    return way, whole


def blocks_of(top: Node, way: set[Node], whole: set[Node]) -> list[str]:
    """Texts of the blocks of the chosen nodes, white space folded; loose text on the way belongs to none if a whole element is scoped."""
    out, parts, loose = [], [], len(whole) > 1 or top in whole
    stack: list[tuple[Node | str, bool, bool]] = [(top, top in whole, False)]

    def end() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    while stack:
        here, inside, done = stack.pop()
        if isinstance(here, str):
            if inside:
                parts.append(here)
        elif done:
            end()
        elif here.tag == "br":
            parts.append(" ")
        elif not here.cut and (inside or here in way or here in whole):
            if here.tag in BLOCK:
                end()
                stack.append((here, inside, True))
            inside = inside or here in whole
            stack += [(c, inside or loose and isinstance(c, str), False) for c in reversed(here.children)]
    end()
    return out


def article(html: str | None) -> str:
    if not html:
        return ""
    top = Tree(html).top
    return "\n".join(blocks_of(top, *content(top)))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` in place of ``html``."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"text": pa.array([article(h) for h in batch.column("html").to_pylist()], pa.string())}

    return map_rows(pages, work, [("text", T.StringType())], [c for c in pages.columns if c not in ("html", "text")], 256)


def op8_html(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
