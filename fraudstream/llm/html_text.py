"""Main text of web pages by scoring the element tree.

A page is parsed into a tree; elements that are boilerplate by tag, role or class are
cut, but for forms and elements cut by class or id that wrap the page's main element,
its articles, its h1 or most of its paragraphs' text. Each paragraph with some text passes points to its ancestors: one, one for each
comma, and up to three for length, all of it to the parent, half to the next, less
further up, discounted by the share of its text in links. The element with the most
points, again discounted by its link density, is the container. It widens to the main
element around it, of which all blocks that aren't half links are kept, or to the article
around it: sibling articles, siblings with enough points, plain paragraphs and headings
are kept then. In an article or main element a name cuts only if it is of boilerplate as a
whole (``share-buttons``, not ``related-work``). Without such an element it widens to its parent, and on
below the body as long as less than half of what it adds is links; what is added is each
block, and each run of text between blocks, that isn't half links or more. Without any
points the whole body is taken.

Defined results: null html is empty; a page without text gives an empty string;
unclosed, crossed and cut tags are closed where HTML closes them; pages are taken
whole; rows are extracted one by one, so repeated rows stay; an empty table gives an
empty result; columns other than id, url and html are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MARKS = frozenset(("main", "article", "h1"))
_CUT = frozenset(
    "head nav header footer aside form button select input label fieldset dialog menu search svg canvas audio video"
    " object embed map math".split()
) | _RAW
_CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status".split()
)
#: Parts of class names and ids that name boilerplate, and those that name the text.
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar"
    " sidenav aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar"
    " footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social related recommended recommendations comment comments commentlist disqus"
    " respond reply replies discussion responses toolbar pagination pager skip".split()
)
_TEXT_NAMES = frozenset("article content main body post entry story text".split())
#: Parts beside which a name stays one of boilerplate.
_PLAIN_NAMES = frozenset(
    "area articles bar block box buttons container content group inner items left links list module news outer panel"
    " posts right row section slot stories top bottom unit wrap wrapper".split()
)
_NEVER_TEXT = frozenset("comment comments commentlist disqus replies responses ad ads advert advertisement".split())
_COMMENT_NAMES = _NEVER_TEXT - frozenset("ad ads advert advertisement".split())
_ROOTS = frozenset(("html", "body", "main", "article"))
#: Elements that an opening tag closes first, and those that such closing doesn't cross.
_CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_LIMITS = {
    "li": frozenset(["ul", "ol", "menu", "dir"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "tr": frozenset(["table"]),
    "td": frozenset(["tr", "table"]),
    "th": frozenset(["tr", "table"]),
    "option": frozenset(["select"]),
}
_P_LIMITS = frozenset("table td th caption button object html body div article section main aside nav header footer".split())
#: A paragraph below this length passes no points.
_PARAGRAPH_CHARS = 25
#: A form, or an element cut by its names, with more of the paragraphs' text than this is kept.
_MOST = 2 / 3
#: Why an element is cut: for good, as a form or by its names, as comments. 0 is kept.
_GONE, _NAMED, _COMMENTS = 1, 2, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Element:
    __slots__ = ("tag", "parent", "children", "cut", "chars", "linked", "points")

    def __init__(self, tag: str, parent: Element | None, cut: bool = False):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.children: list[Element | str] = []
        self.chars = self.linked = 0
        self.points = 0.0


def boilerplate(tag: str, attributes: str, inside: bool = False) -> int:
    """Why an element is cut, by its tag and attributes; 0 if it isn't.

    ``inside`` an article or main element only names that are of boilerplate as a whole count.
    """
    if tag in _ROOTS:
        return 0
    if tag in _CUT and tag != "form":
        return _GONE
    named = _NAMED if tag == "form" else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return named
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return _GONE
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return _GONE
    if found.get("role", "").lower() in _CUT_ROLES:
        return _GONE
    tokens = [t for key in ("class", "id") for t in found.get(key, "").split()]
    parts = [{p.lower() for p in _NAME_PART.findall(t)} for t in tokens]
    if inside:
        parts = [p for p in parts if p & (_CUT_NAMES | _NEVER_TEXT) and p <= _CUT_NAMES | _NEVER_TEXT | _PLAIN_NAMES]
    names = set().union(*parts)
    if names & _COMMENT_NAMES:
        return _COMMENTS
    if names & _NEVER_TEXT or names & _CUT_NAMES and not names & _TEXT_NAMES:
        return _NAMED
    return named


def parse(html: str) -> Element:
    """The element tree under one root; what cut elements hold is not kept."""
    root = node = Element("html", None)
    named: dict[Element, int] = {}
    marks: list[Element] = []
    at, size = 0, len(html)
    scan = _TOKEN.finditer
    while at < size:
        for token in scan(html, at):
            if token.start() > at and not node.cut:
                node.children.append(unescape(html[at : token.start()]))
            at = token.end()
            name = token[2]
            if name is None:
                continue
            name = name.lower()
            if token[1]:
                node = _close(node, name)
                continue
            if name == "html":
                continue
            node = _make_room(node, name)
            why = _GONE if node.cut else boilerplate(name, token[3])
            if why in (_NAMED, _COMMENTS) and _in_text(node):
                why = boilerplate(name, token[3], True)
            inside = Element(name, node, why == _GONE)
            if why != _GONE:
                node.children.append(inside)
                if why:
                    named[inside] = why
                if name in _MARKS:
                    marks.append(inside)
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else size
                break
            if name not in _VOID:  # only void elements close themselves
                node = inside
        else:
            if at < size and not node.cut:
                node.children.append(unescape(html[at:]))
            at = size
    if named:
        _cut_named(root, named, marks)
    return root


def _in_text(node: Element | None) -> bool:
    """Whether an element is in an article or main element, or is one."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _cut_named(root: Element, named: dict[Element, int], marks: list[Element]) -> None:
    """Cut forms and elements with names of boilerplate, but for those that wrap what the page is about.

    These hold the main element; the h1s, if none is elsewhere; or, in pages with neither
    main nor articles elsewhere, an article and half of the paragraphs' text outside
    comments, or most of it. Comments are kept only for a main element or the h1s.
    """

    def around(node: Element) -> list[Element]:
        found, up = [], node
        while up is not None:
            if up in named:
                found.append(up)
            up = up.parent
        return found

    holds: dict[Element, set[str]] = {e: set() for e in named}
    free: set[str] = set()
    for mark in marks:
        above = around(mark)
        if not above:
            free.add(mark.tag)
        # An article in comments is one of them.
        if mark.tag != "article" or all(named[e] != _COMMENTS for e in above):
            for e in above:
                holds[e].add(mark.tag)
    total, chars = 0, dict.fromkeys(named, 0)
    if not free & {"main", "article"}:
        for owner, text, linked in blocks_of(root):
            if len(text) < _PARAGRAPH_CHARS or owner.tag in _HEADINGS:
                continue
            above = around(owner)
            if all(named[e] != _COMMENTS for e in above):
                total += len(text) - linked
                for e in above:
                    chars[e] += len(text) - linked
    for e in named:
        wraps = "main" in holds[e] or "h1" in holds[e] - free
        if not free & {"main", "article"}:
            wraps = wraps or chars[e] > _MOST * total or "article" in holds[e] and 2 * chars[e] >= total
        if not wraps:
            e.cut = True
    for parent in {e.parent for e in named if e.cut}:
        parent.children = [c for c in parent.children if isinstance(c, str) or not c.cut]


def _close(node: Element, name: str) -> Element:
    """The element that is open after an end tag; an end tag without its start is skipped."""
    found = node
    while found is not None and found.tag != name:
        if name == "p" and found.tag in _P_LIMITS:
            return node
        found = found.parent
    return node if found is None or found.parent is None else found.parent


def _make_room(node: Element, name: str) -> Element:
    """The element into which a start tag goes, after those it closes."""
    if name in _BLOCK:
        found = node
        while found is not None and found.tag != "p" and found.tag not in _P_LIMITS:
            found = found.parent
        if found is not None and found.tag == "p":
            node = found.parent
    closes = _CLOSES.get(name)
    if closes:
        found = node
        while found is not None and found.tag not in _LIMITS[name]:
            if found.tag in closes:
                node = found.parent
                if name != "tr":
                    break
            found = found.parent
    return node


def blocks_of(node: Element) -> Iterator[tuple[Element, str, int]]:
    """The blocks below an element in page order: their element, text, and characters in links."""
    run: list[str] = []
    linked = 0
    stack: list[tuple[Element, int, Element, bool]] = [(node, 0, node, node.tag == "a")]
    while stack:
        now, i, owner, link = stack.pop()
        if i == len(now.children):
            if now.tag in _BLOCK and run:
                if text := " ".join("".join(run).split()):
                    yield now, text, min(linked, len(text))
                run, linked = [], 0
            continue
        stack.append((now, i + 1, owner, link))
        child = now.children[i]
        if isinstance(child, str):
            run.append(child)
            if link:
                linked += len(" ".join(child.split()))
            continue
        if child.tag in _BLOCK:
            if run:
                if text := " ".join("".join(run).split()):
                    yield owner, text, min(linked, len(text))
                run, linked = [], 0
            stack.append((child, 0, child, link or child.tag == "a"))
        elif child.tag == "br":
            run.append(" ")
        else:
            stack.append((child, 0, owner, link or child.tag == "a"))
    if run and (text := " ".join("".join(run).split())):
        yield node, text, min(linked, len(text))


def _density(node: Element) -> float:
    return node.linked / node.chars if node.chars else 0.0


def score(root: Element) -> Element | None:
    """Give points to the ancestors of paragraphs; the best container, None without points."""
    scored: dict[int, Element] = {}
    for owner, text, linked in blocks_of(root):
        n = len(text)
        up: Element | None = owner
        while up is not None:
            up.chars += n
            up.linked += linked
            up = up.parent
        if n < _PARAGRAPH_CHARS or owner.tag in _HEADINGS:
            continue
        points = (1 + text.count(",") + min(n // 100, 3)) * (1 - linked / n)
        # A block's own element counts as its paragraph, unless it holds blocks itself.
        holds = any(isinstance(c, Element) and c.tag in _BLOCK for c in owner.children)
        up, level = owner if holds or owner.parent is None else owner.parent, 0
        while up is not None:
            up.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            scored.setdefault(id(up), up)
            up, level = up.parent, level + 1
    best = max(scored.values(), key=lambda e: e.points * (1 - _density(e)), default=None)
    return best if best is not None and best.points > 0 else None


def _around(best: Element) -> Element:
    """The outermost main element around the container, else the outermost article, else itself."""
    article = main = None
    up: Element | None = best
    while up is not None:
        if up.tag == "article":
            article = up
        elif up.tag == "main":
            main = up
        up = up.parent
    return main or article or best


def _of_main(main: Element) -> list[Element]:
    """The main element without its blocks that are half links or more."""
    kept = Element(main.tag, None)
    for child in main.children:
        block = not isinstance(child, str) and child.tag in _BLOCK and child.tag not in _HEADINGS
        if not block or child.tag == "article" or not _half_links([child]):
            kept.children.append(child)
    return [kept]


def _kept_siblings(best: Element) -> list[Element]:
    if best.parent is None:
        return [best]
    least = 0.2 * best.points * (1 - _density(best))
    kept = []
    for child in best.parent.children:
        if isinstance(child, str):
            continue
        density = _density(child)
        if (
            child is best
            or child.points and child.points * (1 - density) >= least
            or child.tag == "article" and not _half_links([child])
            or child.tag in _HEADINGS
            or child.tag == "p" and (child.chars > 80 and density < 0.25 or child.chars and not child.linked)
        ):
            kept.append(child)
    return kept


def _with_text_beside(best: Element) -> Element:
    """The container's parents below the body, without blocks and runs that are half links or more."""
    kept = best
    while (parent := best.parent) is not None:
        beside = Element(parent.tag, None)
        runs: list[list[Element | str]] = [[]]
        for child in parent.children:
            if child is best or not isinstance(child, str) and child.tag in _BLOCK:
                runs += [[child], []]
            else:
                runs[-1].append(child)
        for run in runs:
            if run and run[0] is best:
                beside.children.append(kept)
            elif not _half_links(run) or isinstance(run[0], Element) and run[0].tag in _HEADINGS:
                beside.children += run
        added, linked = parent.chars - best.chars, parent.linked - best.linked
        best, kept = parent, beside
        if best.parent is None or best.parent.parent is None or best.parent.tag == "body" or 2 * linked >= added > 0:
            break
    return kept


def _half_links(run: list[Element | str]) -> bool:
    """Whether neighbours, a block or what stands between blocks, are half links or more."""
    inside = Element("div", None)
    inside.children = run
    found = [(len(text), linked) for _, text, linked in blocks_of(inside)]
    return 2 * sum(linked for _, linked in found) >= sum(n for n, _ in found) > 0


def main_text(html: str) -> str:
    """The page's main text, a line for each block."""
    root = parse(html)
    best = score(root)
    if best is None:
        kept = [root]
    elif (around := _around(best)).tag == "main":
        kept = _of_main(around)
    elif around.tag == "article":
        kept = _kept_siblings(around)
    else:
        kept = [_with_text_beside(best)]
    return "\n".join(text for node in kept for _, text, _ in blocks_of(node))


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of each row."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"]
            )

    html = F.coalesce(plain(html_col), F.lit("")).alias("html")
    found = pages.select(plain(id_col).alias("id"), plain(url_col).alias("url"), html).mapInArrow(
        run, f"id {kinds[0]}, url {kinds[1]}, text string"
    )
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")
    )
