"""Main text of web pages by tree scoring.

A page is parsed into a tree that forgives missing and misplaced end tags. Paragraphs earn
points for their length and their commas and pass them to their ancestors, less at each step.
An ancestor's points are discounted by the share of its text that lies in links. The container
with most points is kept, with those of its siblings that score near it or read like prose, and
with the headings, lists, tables and other text that lie among or right beside them. If it lies
within an article, that is kept whole instead. In what is kept, what is not running text (menus,
forms, notices, adverts, comments) is left out.

Class words tell adverts and comments. Words that an article may use of its own parts as well
(``related``, ``search``) count inside one only where an element has little text or mostly links.
Parsing, measuring and scoring each pass once over a page, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.session import slices

# Fixed sets of HTML: elements without content, elements whose content is no markup, blocks, and where an end tag may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html li optgroup option tbody td tfoot th thead tr".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup"])), "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "body": (frozenset(["head"]), frozenset()),
}
#: Elements that hold no running text.
DROPPED = RAW | frozenset("head nav aside footer form button select option input label fieldset legend menu dialog template svg canvas object embed audio video map datalist".split())
#: Words of class, id or role by which sites mark what is not the article.
MARKED = frozenset(
    "ad ads adsense adslot banner cookie cookies consent gdpr notice popup modal newsletter signup login comment comments commentlist disqus respond replies sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar hidden complementary contentinfo".split()
)
MARKED_BEGINNING = ("advert", "sponsor", "promo", "subscri")
#: Words that may also name parts of an article: inside one, and on paragraphs, quotations, lists and tables, they count only with little text or many links.
DOUBTFUL = frozenset("related search share sharing social tags widget toolbar rail overlay discussion header recommended recommendations recommend".split())
#: Words beside those that change nothing: ``ad-box`` is an ``ad``, but ``notice-period`` is no ``notice``.
BESIDE = frozenset(
    "box wrap wrapper container block area section bar list item items inner outer content links posts post buttons button icons top bottom left right center main site form page global "
    "primary secondary message text label unit slot region user users reader readers visitor visitors module group panel title heading sticky fixed side skip link sr only screen row col js the and of no".split()
)
#: Compounds of such words that do mark.
COMPOUND = frozenset("side-bar skip-link sr-only screen-reader-text site-header page-header top-bar".split())
#: An element marked by a doubtful word goes if it has fewer characters than this or this share of them in links.
LITTLE, LINKED = 100, 0.3
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?:[\s_-]|$)", re.I)
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# A quoted value ends at a quote that something else may follow; where quotes do not close so, the tag ends at the next ">".
_AFTER = r"(?=[\s/>]|[\w:.-]+\s*=|\Z)"
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|(<!\[CDATA\[)|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"{_AFTER}|'[^']*+'{_AFTER})*+(?=>|\Z)|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

#: Points of a paragraph: one, one for each comma, one for each so many characters up to a limit; characters of one at least.
PER, MOST, SHORTEST = 100, 3, 25
#: Points of an ancestor's role; share of the best score by which a sibling is kept, and the least such score.
ROLE = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 3.0, "blockquote": 1.0, "td": 1.0, "body": 0.0, "ul": -3.0, "ol": -3.0, "form": -5.0, "header": -5.0}
SIBLING, LEAST = 0.2, 10.0


#: What may be kept beside the best container; headings are if something kept follows them.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PROSE = frozenset("p pre ul ol dl table blockquote figure".split())
_SCORED = frozenset("p pre td blockquote div section article dd li".split())
_LEAVES = frozenset("p pre td blockquote dd li".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAPITAL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


class Node:
    """An element: its children are nodes and strings. Measures are those of all its text that is not left out."""

    __slots__ = ("articles", "attributes", "chars", "children", "commas", "left_out", "links", "parent", "score", "tag", "titled")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.score: float | None = None
        self.chars = self.links = self.commas = self.articles = 0
        self.left_out = self.titled = False

    @property
    def density(self) -> float:
        """The share of the text that lies in links."""
        return self.links / self.chars if self.chars else 0.0


class _Tree:
    """The tree being built: the open elements, and how many of each tag are open."""

    def __init__(self):
        self.root = self.now = Node("#root", None, {})
        self.open: dict[str, int] = {}

    def enter(self, node: Node) -> None:
        self.now = node
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def leave(self, to: Node) -> None:
        """Close elements until ``to`` is the innermost open one."""
        while self.now is not to:
            self.open[self.now.tag] -= 1
            self.now = self.now.parent

    def end(self, tag: str) -> None:
        """An end tag closes the nearest such element, unless a block lies between an inline one and it."""
        if not self.open.get(tag):
            return
        node = self.now
        while node.tag != tag:
            if tag not in BLOCK and node.tag in BLOCK:
                return
            node = node.parent
        self.leave(node.parent)

    def start(self, tag: str) -> None:
        """Close what a start tag implies to be over."""
        if tag in CLOSES_P and self.open.get("p"):
            node = self.now
            while node.tag != "#root" and (node.tag not in BLOCK or node.tag == "p"):
                if node.tag == "p":
                    self.leave(node.parent)
                    break
                node = node.parent
        if tag in IMPLIED and any(self.open.get(t) for t in IMPLIED[tag][0]):
            ends, fences = IMPLIED[tag]
            node, out = self.now, None
            while node.tag not in fences and node.tag != "#root":
                if node.tag in ends:
                    out = node.parent
                node = node.parent
            if out is not None:
                self.leave(out)


def parse(source: str) -> Node:
    """The tree of a page."""
    tree, at = _Tree(), 0
    last = source.rfind("]]>")  # no CDATA section ends after it
    ends: dict[str, re.Pattern] = {}
    while True:
        m = _MARK.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            tree.now.children.append(entities.unescape(text) if "&" in text else text)
        if m is None:
            return tree.root
        at = m.end()
        if m[1] is not None:  # a CDATA section, or without an end any other declaration
            end = source.find("]]>", at) if at <= last else -1
            if end >= 0:
                tree.now.children.append(source[at:end])
                at = end + 3
            else:
                at = source.find(">", at) + 1 or len(source)
        tag = m[3] and m[3].lower()
        if not tag:
            continue
        if m[2]:
            tree.end(tag)
            continue
        tree.start(tag)
        node = Node(tag, tree.now, {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[4])} if m[4] and not m[4].isspace() else {})
        tree.now.children.append(node)
        if tag in RAW:
            # What is no markup goes on to its end tag; without one, to the end.
            end = (ends.get(tag) or ends.setdefault(tag, re.compile(rf"</{tag}(?![A-Za-z0-9-])[^>]*(?:>|\Z)", re.I))).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            node.children.append(entities.unescape(inner) if tag in ("title", "textarea") else inner)
            at = end.end() if end else len(source)
        elif tag not in VOID:
            tree.enter(node)


@lru_cache(4096)
def marked(marks: str) -> tuple[bool, bool]:
    """Whether a word of class, id or role marks what is not the article, and whether a doubtful one does."""
    sure = doubtful = False
    for word in marks.split():
        if word in COMPOUND:
            sure = True
            continue
        parts = _WORD.findall(word)
        told = [p in MARKED or p.startswith(MARKED_BEGINNING) for p in parts]
        maybe = [p in DOUBTFUL for p in parts]
        if all(t or d or p in BESIDE or p.isdigit() for t, d, p in zip(told, maybe, parts, strict=True)):
            sure, doubtful = sure or any(told), doubtful or any(maybe)
    return sure, doubtful


def _marks(node: Node) -> str:
    """Words of class, id and role, in lower case and with hyphens, also where capitals part them."""
    a = node.attributes
    return _CAPITAL.sub("-", f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}").lower()


def _left_out(node: Node, inside: bool) -> bool:
    """Whether an element, whose content is measured, holds no running text of the article. ``inside``: it lies in an article."""
    if node.tag in DROPPED or (node.tag == "header" and not inside):
        return True
    a = node.attributes
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDING.search(a.get("style", "")):
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    sure, doubtful = marked(_marks(node))
    if inside and node.titled:  # it holds the article's title
        return False
    if sure:
        return not (node.tag == "p" and WANTED.search(_marks(node)))
    return doubtful and (not inside and node.tag not in PROSE or node.chars < LITTLE or node.density >= LINKED)


def measure(root: Node) -> list[Node]:
    """Sets measures, points and what is left out, in one pass; the elements that have points, in page order of their ends."""
    scored: list[Node] = []
    passed: dict[int, list[float]] = {}  # points that paragraphs gave to an element, and those that came from further below
    stack: list[tuple[Node, bool, bool, int]] = [(root, False, False, -1)]
    while stack:
        node, link, inside, begun = stack.pop()
        if begun < 0:
            link, within = link or node.tag == "a", inside or node.tag in ("article", "main")
            stack.append((node, link, inside, len(scored)))
            if node.tag not in DROPPED:
                stack.extend((c, link, within, -1) for c in reversed(node.children) if isinstance(c, Node))
            continue
        block_inside = False
        own = passed.pop(id(node), [0.0, 0.0])
        for c in node.children:
            if isinstance(c, str):
                if not c.isspace():
                    n = len(_SPACE.sub(" ", c))
                    node.chars, node.links, node.commas = node.chars + n, node.links + n * link, node.commas + c.count(",") + c.count("，") + c.count("、")
            elif not c.left_out:
                node.chars, node.links, node.commas, node.articles = node.chars + c.chars, node.links + c.links, node.commas + c.commas, node.articles + c.articles
                node.titled = node.titled or c.titled or (c.tag == "h1" and c.chars > 0)
            block_inside = block_inside or isinstance(c, Node) and c.tag in BLOCK
        node.left_out = _left_out(node, inside)
        if node.left_out:
            del scored[begun:]
            continue
        node.articles += node.tag == "article"
        if node.tag in _SCORED and node.chars >= SHORTEST and (node.tag in ("p", "pre") or not block_inside):
            points = (1 + node.commas + min(MOST, node.chars / PER)) * (1 - node.density)
            if node.tag in _LEAVES:
                if node.parent is not None:
                    passed.setdefault(id(node.parent), [0.0, 0.0])[0] += points
            else:
                own[0] += points
        if (own[0] or own[1]) and node.tag not in ("#root", "html"):
            node.score = (ROLE.get(node.tag, 0.0) + (25.0 if WANTED.search(_marks(node)) else 0.0) + own[0] + own[1]) * (1 - node.density)
            scored.append(node)
            if node.parent is not None:
                passed.setdefault(id(node.parent), [0.0, 0.0])[1] += own[0] * 0.5 + own[1] / 1.5
    return scored


def best_containers(root: Node) -> list[Node | str]:
    """The best container and what is kept with it, in page order; none if nothing reads like a paragraph."""
    scored = measure(root)
    if not scored:
        return []
    top = max(scored, key=lambda n: n.score)
    if (article := enclosing(top)) is not None:
        return [article]
    if top.tag in ("article", "main"):  # others like it count as far as they score
        least = max(LEAST, SIBLING * top.score)
        return [c for c in top.parent.children if c is top or isinstance(c, Node) and c.tag == top.tag and not c.left_out and (c.score or 0.0) >= least]
    kept, at = _beside(top), top
    while at.parent.tag not in ("#root", "html", "body"):
        at = at.parent
        kept = _headings_before(at) + kept
    return kept


#: Left out themselves, they part what is above them from what is below.
_FENCES = frozenset("nav header footer".split())


def _around(node: Node) -> list[Node | str]:
    """An element and its siblings that have text, or are fences."""
    return [c for c in node.parent.children if c is node or (not c.isspace() if isinstance(c, str) else c.tag in _FENCES or not c.left_out and c.chars)]


def _plain(c: Node | str) -> bool:
    return isinstance(c, str) or not c.left_out and c.density < 0.5


def _headings_before(node: Node) -> list[Node | str]:
    """The headings right before an element."""
    around = _around(node)
    high = low = next(k for k, c in enumerate(around) if c is node)
    while low and isinstance(around[low - 1], Node) and around[low - 1].tag in HEADINGS and _plain(around[low - 1]):
        low -= 1
    return around[low:high]


def _beside(top: Node) -> list[Node | str]:
    """The best container with what is kept of its siblings.

    Those that score near it, and paragraphs of prose, span a run; all text in that run is kept,
    and so are headings right before it, and prose, lists and tables right after it.
    """
    around, least = _around(top), max(LEAST, SIBLING * top.score)

    def good(c: Node | str) -> bool:
        if c is top or isinstance(c, str) or c.left_out:
            return c is top
        prose = c.tag == "p" and (c.links == 0 if c.chars <= 80 else c.density < 0.25)
        return prose or (c.score or 0.0) >= least

    spots = [k for k, c in enumerate(around) if good(c)]
    low, high = spots[0], spots[-1]
    before = _headings_before(around[low])
    end = high
    while end + 1 < len(around) and isinstance(around[end + 1], Node) and _plain(around[end + 1]) and around[end + 1].tag in HEADINGS | PROSE:
        end += 1
        if around[end].tag in PROSE:  # a heading counts if something follows it
            high = end
    return before + [c for k, c in enumerate(around[low : high + 1], low) if k in spots or _plain(c)]


def enclosing(node: Node) -> Node | None:
    """The article that an element lies within: the nearest ``article``, or ``main`` if that has no other one; none if there is neither."""
    found: Node | None = node if node.tag in ("article", "main") else None
    up = node.parent
    while up is not None:
        if up.tag == "article" and found is None or up.tag == "main" and up.articles <= 1:
            found = up
        up = up.parent
    # An article by itself may have others like it beside it.
    return None if found is node else found


def _ordered(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def blocks(nodes: list[Node | str]) -> list[str]:
    """The texts of blocks in page order, white space made single, empty ones left out."""
    out: list[str] = []
    open_text: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(open_text)).strip()
        open_text.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            open_text.append(x)
        elif x.tag == "br":
            open_text.append(" ")
        elif not x.left_out:
            if x.tag in BLOCK or x.tag == "#root":
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks joined by two line ends; empty if there is none. Of equal scores, the container that ends first is best."""
    if not source:
        return ""
    root = parse(source)
    kept = best_containers(root)
    if not kept:  # nothing long enough to score: what the page marks as its article, or all that is not left out
        kept = next(([n] for tag in ("article", "main", "body") for n in _ordered(root) if n.tag == tag), [root])
    return "\n\n".join(blocks(kept))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, one row per row of ``pages``.

    A null page is empty; a page without an article has empty text. Of several ``article`` or
    ``main`` elements side by side, those stay that score a fifth of the best one or more: a
    list of teasers beside an article is not it. Repeated rows are read each,
    further columns are ignored, an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
