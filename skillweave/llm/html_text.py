"""Operator 5: main text of web pages by composite text density.

A page becomes a tree of block elements (inline markup dissolves into its block; links are counted). Every node gets its
composite text density: characters per tag, raised or lowered by the share of characters and tags that are links. A
node's density sum is the sum of its children's densities. The node with the greatest sum is the content root; the smallest
density on its way up to the body is the page's threshold, and in every subtree that reaches the threshold the node with the
greatest sum is content; a node without children counts with its own density. A density grows with the length of a block, so
the threshold is never above the lower quartile of the root's own link-poor blocks: a paragraph beside the root that is as
dense as three quarters of the root's is not lost for standing alone. If the root lies in an article (or else a main
element), all of that element is content but for subtrees that are mostly links and miss the threshold; else the headings
and paragraphs right before the root are, and the headings right before its ancestors.

Elements that are never article text are cut before densities are taken: by their tags, and by class, id or role where every
part of a name says so (related-posts, not related-work), articles only where another one is not so named; single
paragraphs, headings and the like are cut only by the names of adverts, comments and sharing. One page is one row: nothing
is shuffled.
"""

from __future__ import annotations

import bisect
import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm.common import table

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Tags whose quotes never close, of which a page may have so many before quotes are ignored: each is looked for to its end.
_UNCLOSED = 3
_HOMES = re.compile(r"<(article|main)((?:\s[^>]*)?)>", re.I)
_MARK = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CUT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "template", "svg", "annotation", "annotation-xml", "canvas", "object", "audio", "video", "map", "datalist", "fieldset", "head"}
_BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul head".split()
)
_ENDS_P = _BLOCK - {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "html", "body", "head"}
#: An open element of the set is ended by the start of the element, up to the given ancestors.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Parts of names in class, id or role that mark what is not article text.
_ASIDE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription signup sidebar comment comments disqus respond reply replies related "
    "recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer popup modal overlay widget toolbar "
    "pagination pager contentinfo complementary search".split()
)
#: Parts that may stand beside those without changing what a name says.
_PLAIN = set(
    "a and area articles bar block bottom box buttons button column container content form group header icons inner item items left "
    "links list main message outer page panel policy post posts primary right secondary section site slot stories strip text "
    "thread title top unit wrap wrapper zone".split()
)
#: Parts that cut a single paragraph, heading, list item or the like inside an article.
_SURE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments share sharing cookie cookies newsletter breadcrumb breadcrumbs".split())
_SINGLE = set("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote table tr td th figure figcaption details summary hgroup caption span em strong b i a".split())
_HEAD = {"header", "masthead", "topbar"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_LEADS = _HEADINGS | {"p", "blockquote"}
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent, self.kids = tag, parent, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the names of an element say that it is not article text; inside: it stands in an article or main."""
    telling = _SURE if inside and tag in _SINGLE else _ASIDE
    for _, value in _MARK.findall(attributes):
        for name in value.strip("\"'").lower().split():
            parts = {x.rstrip("0123456789") for x in _SPLIT.split(name)} - {""}
            if parts & telling and parts <= _ASIDE | _PLAIN | _HEAD or not inside and parts & _HEAD and parts <= _HEAD | _PLAIN:
                return True
    return False


def parse(source: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The tree below the body and its text blocks (node, text) in page order.

    What is open is known by tag and place on the stack, so a tag costs no walk down the stack but over what it closes: the
    time is that of the page's length, however deep it nests.
    """
    root = _Node("body", None)
    stack: list[tuple[str, _Node, bool, int]] = []  # open elements: tag, its block node, whether its text is cut, open links
    places: dict[str, list[int]] = {}  # where on the stack a tag is open, ascending
    homes = [_marked(m[1].lower(), m[2], False) for m in _HOMES.finditer(source)]
    spared = all(homes)  # every article bears a telling name, so none of these names tells
    blocks: list[tuple[_Node, str]] = []
    run: list[str] = []
    node, cut, linked, order = root, False, 0, [root]
    top = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                blocks.append((node, text))

    def close(at: int) -> None:
        nonlocal node, cut, linked
        if any(x[0] in _BLOCK for x in stack[at:]):
            flush()
        for x in stack[at:]:
            places[x[0]].pop()
            if x[0] in _BLOCK:
                places["#block"].pop()
        del stack[at:]
        _, node, cut, linked = stack[-1] if stack else ("", root, False, 0)

    def say(raw: str) -> None:
        if raw and not cut:
            text = _html.unescape(raw) if "&" in raw else raw
            run.append(text)
            n = len("".join(text.split()))
            node.chars += n
            if linked:
                node.link_chars += n

    at, end, last, unclosed, said = 0, len(source), source.rfind(">"), 0, 0
    while at < end:
        here = source.find("<", at)
        if here < 0:
            break
        m = _OTHER.match(source, here)
        if m:
            say(source[said:here])
            at = said = m.end()
            continue
        follows = source[here + 1 : here + 3].lstrip("/")
        if here > last or not (follows[:1].isascii() and follows[:1].isalpha()):
            at = here + 1
            continue
        m = _TAG.match(source, here) if unclosed < _UNCLOSED else _BARE.match(source, here)
        if m is None:
            unclosed += 1
            m = _BARE.match(source, here)
        if m is None:
            at = here + 1
            continue
        say(source[said:here])
        at = said = m.end()
        tag = m[2].lower()
        if m[1]:
            found = top((tag,))
            if found >= 0 and (tag in _BLOCK or found > top(("#block",))):
                close(found)
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = end if stop is None else stop.start()
            close_at = source.find(">", at)
            at = said = end if close_at < 0 else close_at + 1
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            found = top(("p",))
            if found > top(("table", "td", "th", "button", "object")):
                close(found)
        if tag in _IMPLIED:
            ended, limit = _IMPLIED[tag]
            bound = top(limit)
            above = [places[t][i] for t in ended if places.get(t) for i in [bisect.bisect_right(places[t], bound)] if i < len(places[t])]
            if above:
                close(min(above))
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            elif not cut:
                run.append(" ")
            continue
        if tag in _VOID:
            continue
        gone = cut or tag in _CUT
        if not gone and (m[3] or tag == "header"):
            inside = top(("article", "main")) >= 0
            named = bool(m[3]) and not (spared and tag in ("article", "main")) and _marked(tag, m[3], inside)
            gone = (tag == "header" and not inside) or named
        if tag in _BLOCK or tag == "dialog":
            flush()
            if not gone:
                child = _Node(tag, node)
                node.kids.append(child)
                order.append(child)
                node = child
        elif tag == "a" and not gone:
            node.links += 1
            node.tags += 1
        places.setdefault(tag, []).append(len(stack))
        if tag in _BLOCK:
            places.setdefault("#block", []).append(len(stack))
        cut, linked = gone, linked + (tag == "a")
        stack.append((tag, node, cut, linked))
        if m[3].endswith("/") and tag not in _BLOCK:
            close(len(stack) - 1)
    say(source[said:])
    flush()
    for x in reversed(order):
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + 1
            p.link_chars += x.link_chars
            p.links += x.links
    _weigh(order)
    return root, blocks


def _weigh(order: list[_Node]) -> None:
    """Composite density and density sum of every node; order has parents before children."""
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for x in reversed(order):
        if x.chars:
            tags, link_chars, links = max(1, x.tags), max(1, x.link_chars), max(1, x.links)
            base = math.log(x.chars / max(1, x.chars - x.link_chars) * link_chars + share * x.chars + math.e)
            x.density = x.chars / tags * max(0.0, math.log(max(1.0, x.chars / link_chars * tags / links))) / base
        if x.parent is not None:
            x.parent.total += x.density


def _content(root: _Node, blocks: list[tuple[_Node, str]]) -> tuple[set[int], set[int]]:
    """Ids of the nodes whose whole subtree is content, and of those below them whose subtree is not."""
    best, todo = root, [root]
    while todo:
        x = todo.pop()
        if x.total > best.total:
            best = x
        todo.extend(x.kids)
    threshold, x, home = best.density, best, None
    while x is not None:
        threshold = min(threshold, x.density)
        if x.tag == "article" and home is None or x.tag == "main" and (home is None or home.tag == "main"):
            home = x
        x = x.parent
    order, todo, inside = [], [root], {id(best)}
    while todo:
        x = todo.pop()
        order.append(x)
        if x.parent is not None and id(x.parent) in inside:
            inside.add(id(x))
        todo.extend(reversed(x.kids))
    own = sorted({id(x): x.density for x, _ in blocks if id(x) in inside and x.link_chars * 2 <= x.chars}.values())
    if own:
        threshold = min(threshold, own[len(own) // 4])
    # The node of the greatest sum below every node (or itself); a leaf counts with its own density.
    top: dict[int, tuple[float, _Node]] = {}
    for x in reversed(order):
        top[id(x)] = max([(x.total if x.kids else x.density, x), *(top[id(y)] for y in x.kids)], key=lambda t: t[0])
    kept = {id(best), *(id(top[id(x)][1]) for x in order if x.chars and x.density >= threshold)}
    out: set[int] = set()
    if home is None:
        kept |= _leads(best)
    if home is not None:
        kept.add(id(home))
        out = {id(x) for x in order if x.link_chars * 2 > x.chars and x.density < threshold and id(x) not in kept}
    return kept, out


def _leads(best: _Node) -> set[int]:
    """Headings and paragraphs right before the root, and headings right before its ancestors: the article's own, however short."""
    found, x, kinds = set(), best, _LEADS
    while x.parent is not None:
        before = x.parent.kids[: next(i for i, y in enumerate(x.parent.kids) if y is x)]
        for y in reversed(before):
            if y.tag not in kinds or y.link_chars * 2 > y.chars:
                break
            found.add(id(y))
        x, kinds = x.parent, _HEADINGS
    return found


def main_text(source: str | None) -> str:
    """The article's blocks, joined by an empty line; '' for null, empty or textless pages."""
    if not source:
        return ""
    root, blocks = parse(source)
    kept, out = _content(root, blocks)
    found: dict[int, bool] = {}

    def within(x: _Node | None) -> bool:
        path = []
        while x is not None and id(x) not in found and id(x) not in kept and id(x) not in out:
            path.append(x)
            x = x.parent
        good = x is not None and (id(x) in kept or found.get(id(x), False))
        for y in path:
            found[id(y)] = good
        return good

    return "\n\n".join(text for x, text in blocks if within(x))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html); other columns are ignored.

    A null, empty or textless page has empty text; rows that repeat are extracted alike; an empty table gives an empty
    result. Whole pages are parsed, whatever their length or depth.
    """
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
