"""Main text of HTML pages by tree scoring.

A tolerant tree of the page is built in one pass.  Paragraphs pass points (for length and commas) to their
ancestors, less with distance; a container's points are discounted by its share of link text.  The article around
the best container (or else the lowest ancestor with all points) is kept whole, with its siblings that score
well enough or read like running text and, if it has no h1 of its own, those further up; what is marked as menu, header,
footer, sidebar, notice, advert, form, script, style or reader comment is cut before anything is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import workers_find_package

# HTML's element classes, and the words that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul caption legend search""".split())
#: Elements that never hold article text.
CUT = frozenset("""head script style noscript template iframe noembed noframes object embed applet svg math canvas
audio video map nav header footer aside form button select option textarea input label fieldset dialog menu
search""".split())
#: An open paragraph ends before these.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
#: Elements whose start ends an open one of the same group.
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
           "tfoot": {"tbody", "thead", "tr", "td", "th"}}
#: Elements that an end tag or an implied end does not cross.
WALLS = frozenset("html body table ul ol dl td th div article section main blockquote".split())
ROLES = frozenset("""navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form
toolbar""".split())
UNWANTED = re.compile(r"""(?:^|[\s_-])(?:
    ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|adbox|banner|banners|promo|promos|promotion|
    promoted|sponsor|sponsored|sponsors|sidebar|sidebars|sidenav|side|rail|nav|navbar|navigation|navi|topnav|menu|menus|
    breadcrumb|breadcrumbs|pagination|pager|footer|foot|header|masthead|comment|comments|commentlist|
    respond|replies|disqus|cookie|cookies|consent|gdpr|notice|notices|notification|disclaimer|popup|popover|modal|
    overlay|lightbox|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|
    toolbar|skip|tags|hidden|print-only)(?:$|[\s_-])""", re.X | re.I)
#: Of these, words that are also common in an article's own names (share-price, notice-period, side-effects): they
#: count alone, or beside nothing but words of page parts (share-buttons, side-bar).
AMBIGUOUS = frozenset("""foot notice notices notification promotion promotions rail related share sharing side skip social
subscription tags recommended disclaimer overlay login""".split())
PART = frozenset("""actions area articles bar bars block box button buttons center col column container content count
counts icon icons inner item items left link links list menu message messages module nav outer panel pane posts right
row section sections stories text to top bottom toggle widget widgets wrap wrapper""".split())
#: Layout names that only mention a part: no-sidebar, content-sidebar-wrap.
LAYOUT = re.compile(r"^(?:no|has|with|without)[_-]|content.*sidebar|sidebar.*content", re.I)
#: Elements of a page's head.
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"""<(?:!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|
    (?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>"']+|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*))(?:>|\Z))""",
                  re.S | re.X)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
#: A sibling is kept from this share of the best container's points.
SIBLING_SHARE = 0.2
#: Running text that is kept beside the best container: characters, and most link text.
PROSE_CHARS, PROSE_LINKS = 80, 0.25
#: Characters of running text from which a form is more than fields and labels.
FORM_PROSE = 140
#: Open elements that an end tag or an implied end looks through.
LOOK = 256


class Node:
    __slots__ = ("name", "cut", "parent", "children", "points", "weight", "chars", "linked", "total")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, weight: float = 0.0):
        self.name, self.parent, self.cut, self.weight = name, parent, cut, weight
        self.children: list[Node | str] = []
        self.points = self.chars = self.linked = self.total = 0.0


def _unwanted(name: str) -> bool:
    """Whether a class or id names what is not the article."""
    if not UNWANTED.search(name) or LAYOUT.search(name):
        return False
    parts = [x for x in re.split(r"[_-]", name.lower()) if x and not x.isdigit()]
    strong = [x for x in parts if x not in AMBIGUOUS]
    return any(UNWANTED.search(x) for x in strong) or name.lower().endswith("print-only") or all(x in PART for x in strong)


def _in_article(node: Node | None) -> bool:
    while node is not None and node.name != "article":
        node = node.parent
    return node is not None


def _node(name: str, attrs: str, parent: Node) -> Node:
    cut, weight = name in CUT and name != "form", 0.0  # a form is judged when the page is read
    if name == "header":
        cut = not _in_article(parent)
    if attrs.strip():
        a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
        mark = f"{a.get('class', '')} {a.get('id', '')}"
        if name not in ("html", "body", "article", "main"):
            cut = cut or any(_unwanted(m) and not (m.lower().endswith("header") and _in_article(parent)) for m in mark.split())
        elif name == "article":  # a reader's comment may be an article of its own
            cut = cut or bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", mark, re.I))
        cut = cut or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(
            re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))
        weight = 25.0 if WANTED.search(mark) else 0.0
    if name in ("article", "main"):
        weight += 25.0
    return Node(name, parent, cut, weight)


def _cut_forms(forms: list[Node]) -> None:
    """Cut the forms that hold fields and labels only; one with a heading, an article or running text stays."""
    for form in reversed(forms):  # inner ones first
        prose, stack = 0.0, list(form.children)
        while stack:
            x = stack.pop()
            if isinstance(x, str) or x.cut:
                continue
            if x.name == "form":
                prose += FORM_PROSE  # it stays
            elif x.name in ("article", "main", "h1"):
                prose += FORM_PROSE
            elif x.name in ("p", "pre", "blockquote", "td", "li", "dd"):
                prose += sum(len(c.strip()) for c in x.children if isinstance(c, str))
            if x.name not in ("form", "a"):
                stack += x.children
        form.cut = prose < FORM_PROSE


def parse(html: str) -> Node:
    """The tree of a page; unclosed, crossed and stray tags are put right as browsers mostly do.

    The names of open elements are counted, so a tag that has nothing to end costs no walk; a walk that does not end
    looks at the ``LOOK`` innermost elements.
    """
    root = at = Node("html", None)
    open_: Counter[str] = Counter()
    forms: list[Node] = []
    pos, n = 0, len(html)

    def leave(to: Node) -> Node:
        """Close the open elements below ``to``."""
        x = at
        while x is not to:
            open_[x.name] -= 1
            x = x.parent
        return to

    while pos < n:
        tag = html.find("<", pos)
        if tag < 0:
            at.children.append(html[pos:])
            break
        if tag > pos:
            at.children.append(html[pos:tag])
        m = _TAG.match(html, tag)
        if not m:
            at.children.append("<")
            pos = tag + 1
            continue
        pos = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            up, looked = at if open_[name] else None, 0
            while up is not None and up.name != name:
                looked += 1
                if up.name in WALLS and name not in WALLS or looked > LOOK and name not in WALLS:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                at = leave(up.parent)
            continue
        if at.name == "head" and name not in HEAD_ONLY:
            at = leave(at.parent)  # the head's end tag is missing
        if name in ("html", "body"):
            continue
        if name in ENDS_P and open_["p"]:
            up, looked = at, 0
            while up is not None and up.name not in WALLS and looked <= LOOK:
                if up.name == "p":
                    at = leave(up.parent)
                    break
                up, looked = up.parent, looked + 1
        group, up, looked = SIBLING.get(name), at, 0
        if group and any(open_[g] for g in group):
            walls = WALLS - group
            while up is not None and up.name not in walls and looked <= LOOK:
                above = up.parent
                if up.name in group:
                    at = leave(above)
                up, looked = above, looked + 1
        node = _node(name, m["attrs"], at)
        at.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
            if not node.cut and name != "title":
                node.children.append(html[pos:close.start() if close else n])
            node.cut = node.cut or name == "title"
            pos = close.end() if close else n
        elif name not in VOID:
            at = node
            open_[name] += 1
            if name == "form" and not node.cut:
                forms.append(node)
    _cut_forms(forms)
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Kept nodes, parents first (False) and after their children again (True), without recursion."""
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        yield node, done
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in reversed(node.children) if not isinstance(c, str) and not c.cut]


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space turned into single spaces."""
    out: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(unescape(x) if "&" in x else x)
        elif x.name in ("br", "wbr"):
            now.append(" " if x.name == "br" else "")
        elif not x.cut or x is root:
            if x.name in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(x.children)
    close()
    return out


def _score(root: Node) -> list[Node]:
    """Give every node its text lengths and points; the nodes that hold paragraphs."""
    holders: list[Node] = []
    for node, done in _walk(root):
        if not done:
            continue
        own = "".join(c for c in node.children if isinstance(c, str)).strip()
        kept = [c for c in node.children if not isinstance(c, str) and not c.cut]
        node.chars += len(own) + sum(c.chars for c in kept)
        node.total = sum(c.total for c in kept)
        node.linked += len(own) + sum(c.chars for c in kept) if node.name == "a" else sum(c.linked for c in kept)
        text = node.name in ("p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3") or bool(
            own) and node.name in BLOCKS
        if text and node.chars and not any(c.name in BLOCKS for c in kept) and node.parent is not None:
            points = (min(node.chars / 25, 1) + own.count(",") + min(node.chars / 100, 3)) * (
                1 - node.linked / node.chars)
            node.total += points
            up, share = (node if node.name not in ("p", "pre", "h1", "h2", "h3") and own else node.parent), 1.0
            level = 0
            while up is not None and level < 5:
                if not up.points:
                    up.points = up.weight + 1e-9
                    holders.append(up)
                up.points += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
                up = up.parent
    return holders


def _article(best: Node, root: Node) -> Node:
    """The outermost article around a container, or else the outermost main, or else what has all points."""
    found: dict[str, Node] = {}
    up: Node | None = best
    while up is not None:
        if up.name in ("article", "main"):
            found[up.name] = up
        up = up.parent
    if found:
        return found.get("article") or found["main"]
    while best.parent is not None and best.total < root.total * (1 - 1e-9):
        best = best.parent
    return best


def _headings(node: Node) -> list[Node]:
    """The kept h1 elements of a part that is not another article."""
    if node.name == "article":
        return []
    return [n for n, done in _walk(node) if done and n.name == "h1"]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line ends; empty if there are none."""
    if not html:
        return ""
    root = parse(html)
    holders = _score(root)
    if not holders:
        return "\n".join(blocks(root))
    score = {id(h): h.points * (1 - h.linked / h.chars if h.chars else 1) for h in holders}
    best = max(holders, key=lambda h: score[id(h)])
    while best.parent is not None and best.name not in BLOCKS:
        best = best.parent
    node = _article(best, root)
    top = max(score.get(id(node), 0.0), score.get(id(best), 0.0))
    titled = any(n.name == "h1" for n, _ in _walk(node))
    out, near = blocks(node), True
    while node.parent is not None:
        before: list[str] = []
        after: list[str] = []
        side = before
        for c in node.parent.children:
            if c is node:
                side = after
            elif not isinstance(c, str) and not c.cut and c.chars:
                links = c.linked / c.chars
                prose = c.name in ("p", "pre", "blockquote") and (
                    c.chars >= PROSE_CHARS and links < PROSE_LINKS or c.chars < PROSE_CHARS and not c.linked)
                if near and (prose or score.get(id(c), 0.0) >= max(10.0, SIBLING_SHARE * top)
                             or c.name in ("h1", "h2") and not links):
                    side += blocks(c)
                elif not titled:
                    side += [text for h in _headings(c) if not h.linked for text in blocks(h)]
        if before or after:
            out = before + out + after
        node, near = node.parent, False
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars.

    One row per row, repeated rows included; a null or empty page, or one without text, has text '' and 0
    characters; null ids and urls stay null; an empty table gives no rows; other columns are ignored.  Pages are
    read whole, one at a time, without a shuffle.
    """
    workers_find_package(pages.sparkSession)

    def extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()),
                                   pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(extract_task, "page_id long, url string, text string, n_chars long"))
