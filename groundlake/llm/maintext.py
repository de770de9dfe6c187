"""Main text of web pages by tree scoring: paragraphs give points to their ancestors, the best container and its siblings stay."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_COMMENT_END = re.compile(r"--!?>")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: What never is main text, whatever it holds.
DROPPED = frozenset("head nav footer aside form button select option textarea script style title template iframe noscript noembed noframes xmp object svg canvas dialog menu search audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose class, id or role may name them as something else than main text.
NAMED = frozenset("div section ul ol dl table p span header address figure blockquote details li center td h1 h2 h3 h4 h5 h6 a fieldset".split())
#: Words of a class, id or role that name it so: menus, headers, footers, sidebars, notices, adverts, forms, comments of readers.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies "
    "consent disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion "
    "related replies respond share sharing sidebar social sponsor sponsored subscribe subscription taboola toolbar tooltip widget".split()
)
#: Parts of words that say the same wherever they stand in a name.
_FOREIGN_PART = re.compile("comment(?!ar)|sidebar|advert|cookie|newsletter|breadcrumb|footer|disqus|sponsor|subscri|navbar|navigation|adbox|adslot|adunit")
#: With one of these words the element holds main text even so, but for the parts above.
OWN = frozenset("article main content body story post entry".split())
CLOSES_P = BLOCK - frozenset("body head html option optgroup caption tbody td tfoot th thead tr legend".split())
#: A start tag ends an open element of these names, up to the nearest element of the second list.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"tbody", "thead", "tfoot", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup"})),
    "a": (frozenset({"a"}), BLOCK),
}
TREE = BLOCK | DROPPED | {"a", "span"}  # other tags, such as b, change nothing here
NEAREST = 1000  # open elements among which an end tag looks for its own
WALLS = frozenset("td th caption table".split())  # an end tag inside doesn't reach out of these, unless it is a table's
TABLE_TAGS = frozenset("table tbody thead tfoot tr td th caption".split())
SHARE = (1.0, 0.5)  # of a paragraph's points, for the element around it and the next; from there 1 / (3 * level)
LEVELS = 6


@dataclass(slots=True, eq=False)
class Node:
    """An element: its points, the characters in it and those in its links; blocks ``first`` to ``last`` of the page are its text."""

    tag: str
    up: Node | None
    names: str = ""
    foreign: bool = False  # not main text, or inside such an element
    article: bool = False  # inside an article or main element, or one itself
    linked: bool = False
    points: float = 0.0
    chars: int = 0
    link_chars: int = 0
    first: int = 0
    last: int = 0
    below: list[Node] = field(default_factory=list)

    def density(self) -> float:
        return self.link_chars / self.chars if self.chars else 0.0


def name_words(attributes: str) -> tuple[str, set[str]]:
    """The values of class, id and role, and the words in them: ``top-adBox`` holds top, ad and box."""
    if "class" not in attributes and "id" not in attributes and "role" not in attributes and "=" in attributes and attributes.isascii() and attributes.islower():
        return "", set()
    values = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return values, {w.lower() for w in _WORD.findall(values)}


def is_foreign(tag: str, attributes: str, article: bool) -> tuple[bool, str]:
    """Whether an element isn't main text by its tag or names; and the names."""
    if tag in DROPPED:
        return True, ""
    names, words = name_words(attributes) if attributes else ("", set())
    if tag == "header" and not article:
        return True, names
    if not words or tag not in NAMED:
        return False, names
    if "header" in words and not article and tag not in HEADINGS and not words & OWN:
        return True, names
    return bool(words & FOREIGN and not words & OWN or any(map(_FOREIGN_PART.search, words))), names


class Page:
    """The tree of a page, built in one pass over its tags with the repairs browsers make: blocks of text and the elements around them."""

    def __init__(self, source: str):
        self.root = Node("html", None)
        self.open = [self.root]
        self.count: Counter = Counter()
        self.blocks: list[tuple[str, Node]] = []
        self.runs: list[str] = []
        self.run_chars = self.run_links = 0
        self._read(source)
        self._break()
        while self.open:
            self._close()

    def _read(self, source: str) -> None:
        at, size, tags = 0, len(source), _TAG
        while at < size:
            mark = source.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self._text(source[at:mark])
            if mark >= size - 1:
                if mark == size - 1:
                    self._text("<")
                return
            c = source[mark + 1]
            if c.isascii() and (c.isalpha() or c == "/"):
                found = tags.match(source, mark)
                if found is None and tags is _TAG and (c != "/" or source[mark + 2 : mark + 3].isalpha()):
                    tags = _ANY_TAG  # a quote that never ends; one such search through the page is enough
                    found = tags.match(source, mark)
                if found:
                    at = found.end()
                    tag = found[2].lower()
                    if found[1]:
                        self._end(tag)
                    elif tag in RAW:
                        at = self._raw(source, tag, at)
                    else:
                        self._start(tag, found[3])
                    continue
                if c != "/" or source[mark + 2 : mark + 3].isalpha():
                    return  # the page ends inside a tag
            if source.startswith("<!--", mark):
                end = mark + 5 if source.startswith("<!-->", mark) else mark + 6 if source.startswith("<!--->", mark) else None
                if end is None:
                    found = _COMMENT_END.search(source, mark + 4)
                    end = found.end() if found else size
                at = end
            elif c in "!?/":
                end = source.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                self._text("<")
                at = mark + 1

    def _raw(self, source: str, tag: str, at: int) -> int:
        end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
        if not end:
            return len(source)
        close = source.find(">", end.end())
        return len(source) if close < 0 else close + 1

    def _text(self, raw: str) -> None:
        node = self.open[-1]
        if node.foreign:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.runs.append(text)
        n = len(text) - text.count(" ")
        self.run_chars += n
        if node.linked:
            self.run_links += n

    def _break(self) -> None:
        """End the block of text that is open: its paragraph's points go to the elements around it."""
        if not self.runs:
            return
        text = " ".join("".join(self.runs).split())
        self.runs = []
        chars, links = self.run_chars, self.run_links
        self.run_chars = self.run_links = 0
        if not text:
            return
        node = self.open[-1]
        while node.up and node.tag not in BLOCK:
            node = node.up
        self.blocks.append((text, node))
        node.chars += chars
        node.link_chars += links
        if node.tag in HEADINGS or node.tag == "legend":
            return
        around = node.up if node.up and node.tag in ("p", "pre", "li", "td", "th", "dd", "dt") else node
        points = (1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)) * (1 - links / max(1, chars))
        for level in range(LEVELS):
            if around is None:
                break
            around.points += points * (SHARE[level] if level < 2 else 1 / (3 * level))
            around = around.up

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self.runs:
                self.runs.append(" ")
            return
        if tag in BLOCK:
            self._break()
        if tag in VOID or tag in ("html", "body") or tag not in TREE:
            return
        if tag in CLOSES_P and self.count["p"]:
            self._shut(frozenset({"p"}), WALLS)
        if tag in IMPLIED:
            self._shut(*IMPLIED[tag])
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close()
        up = self.open[-1]
        article = up.article or tag in ("article", "main")
        foreign, names = (True, "") if up.foreign else is_foreign(tag, attributes, article)
        node = Node(tag, up, names, foreign, article, up.linked or tag == "a", first=len(self.blocks))
        if tag in ("article", "main") and not foreign:
            node.points = 5.0
        if tag in BLOCK and not foreign:
            up.below.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def _shut(self, names: frozenset[str], walls: frozenset[str]) -> None:
        """Close the nearest open element of ``names``, and all in it, unless one of ``walls`` comes first."""
        for k in range(len(self.open) - 1, max(0, len(self.open) - 1 - NEAREST), -1):
            if self.open[k].tag in names:
                while len(self.open) > k:
                    self._close()
                return
            if self.open[k].tag in walls:
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._break()
        if not any(self.count[t] for t in (HEADINGS if tag in HEADINGS else (tag,))):
            return
        self._shut(HEADINGS if tag in HEADINGS else frozenset({tag}), frozenset() if tag in TABLE_TAGS else WALLS if tag in BLOCK else BLOCK)

    def _close(self) -> None:
        node = self.open[-1]
        if node.tag in BLOCK:
            self._break()
        self.open.pop()
        self.count[node.tag] -= 1
        node.last = len(self.blocks)
        if node.up and not node.foreign:
            node.up.chars += node.chars
            node.up.link_chars += node.link_chars
            if node.tag not in BLOCK and node.below:
                node.up.below += node.below  # blocks inside an inline element belong to the block around it


def menu_like(node: Node) -> bool:
    """A list, table or division most of which is links."""
    return node.tag in ("ul", "ol", "dl", "table", "div", "section") and node.density() > 0.6


def main_text(source: str) -> str:
    """The main text of a page: blocks in page order, joined by one space; empty if there is none."""
    page = Page(source)
    nodes, order = [page.root], []
    while nodes:
        node = nodes.pop()
        order.append(node)
        nodes += reversed(node.below)
    score = lambda n: n.points * (1 - n.density())
    live = [n for n in order if n.last > n.first or n is page.root]
    best = max(live, key=score, default=page.root)  # ties: the outermost, the first
    if score(best) <= 0:
        return ""
    while best.article and best.tag not in ("article", "main"):
        best = best.up  # inside an article the whole article is meant
    chosen = [best]
    if best.up and best is not page.root:
        least = max(10.0, 0.2 * score(best))
        for sibling in best.up.below:
            if sibling is best:
                continue
            alike = sibling.tag == best.tag and (sibling.tag == "article" or bool(sibling.names) and sibling.names == best.names)
            plain = sibling.tag in ("p", "pre", "blockquote") and sibling.density() < 0.25 and (sibling.chars > 80 or sibling.density() == 0 and _ends(page, sibling))
            if score(sibling) >= least or alike and score(sibling) > 0 or plain or sibling.tag in ("h1", "h2"):
                chosen.append(sibling)
    skipped: list[tuple[int, int]] = []
    walk = list(chosen)
    while walk:
        node = walk.pop()
        if node is not best and menu_like(node):
            skipped.append((node.first, node.last))
        else:
            walk += node.below
    keep = bytearray(len(page.blocks))
    for node in chosen:
        keep[node.first : node.last] = b"\1" * (node.last - node.first)
    for first, last in skipped:
        keep[first:last] = bytes(last - first)
    return " ".join(text for (text, _), k in zip(page.blocks, keep) if k)


def _ends(page: Page, node: Node) -> bool:
    return any(page.blocks[k][0].endswith((".", "!", "?", "…", "。", "؟", "।")) for k in range(node.first, node.last))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    The page becomes a tree, with the repairs that browsers make to open and stray tags. A block is text between two block tags.
    Each gives points to the elements around it, up to six: one, one for each comma and one for each 100 characters (three at most), less its
    share of link text. The element of most points, less its own share of link text, is the main container; inside an ``article`` or
    ``main`` element that is the whole element. Siblings of a fifth of its points, paragraphs and headlines beside it stay too. Left out are
    elements whose tag, class, id or role says menu, page header, footer, sidebar, notice, advert, form or comments, and
    lists, tables and divisions inside the container that are mostly links. Headings in an article are part of it.

    Character references are decoded, white space inside a block becomes one space (``br`` is white space), blocks are joined by
    one space. A null or empty page, and one without a paragraph, has an empty text. Repeated rows and ids stay; null ids and urls are
    carried along; other columns are ignored; no rows give none. Very long pages are read whole, in time that grows with their length.

    Scale: one pass without a shuffle; a page at a time is in a task's memory as a tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(page.as_py() or "") for page in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
