"""Main text of web pages by tree scoring.

Each text block passes points for its length and commas to its parent, half of them to
the grandparent and shares of a third, a fourth, ... to those above. A container's score
is discounted by its link density; the best container is kept, with those of its
siblings that score well or read like prose. Elements called noise by their class or id
are left out first, but only where they are a small part of the page's prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.common import each_batch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template svg math iframe object canvas head nav header footer aside form button select textarea dialog menu figure audio video".split())
KEEPS_HEADER = frozenset("article main section".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption summary div section article main address tr table ul ol dl body html tbody thead tfoot details center fieldset".split())
ENDS_P = BLOCKS | {"hr", "form", "nav", "header", "footer", "aside", "figure"}
#: An open element of the left kind ends when one of the right kinds begins inside it.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
#: Words of a class or id that only describe a layout or a state: has-sidebar, tag-python.
STATE_NAME = re.compile(r"(has|no|with|without|is|tag|category|js)[-_].*|.*[-_](open|closed|enabled|disabled|on|off)$", re.IGNORECASE)
COMMENT_NAME = re.compile(r"(^|[\s_-])(comments?|comment-\w+|disqus|replies|respond)(?=$|[\s_-])", re.IGNORECASE)
RELATED_NAME = re.compile(r"(^|[\s_-])(related\w*|recommend\w*)(?=$|[\s_-])", re.IGNORECASE)
NOISE = re.compile(
    r"(^|[\s_-])(ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|nav\w*|navbar|menu\w*|breadcrumbs?|header|masthead|footer\w*|side-?bar\w*|aside|widget\w*|cookie\w*|consent|notice\w*|"
    r"popup|modal|overlay|newsletter|subscribe\w*|signup|share\w*|sharing|social\w*|login|toolbar|pagination|pager|tags?|tag-?cloud|alert|gdpr|outbrain|taboola)(?=$|[\s_-])",
    re.IGNORECASE,
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPACES = re.compile(r"\s+")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Shares of points below a hundredth are not passed on.
FARTHEST = 100


def rank_name(attrs: dict[str, str]) -> str:
    """What the class and id of an element promise: comment, related, noise, or nothing."""
    names = " ".join(n for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".split() if not STATE_NAME.fullmatch(n))
    for kind, pattern in (("comment", COMMENT_NAME), ("noise", NOISE), ("related", RELATED_NAME)):
        if pattern.search(names):
            return kind
    return ""


def without_loose_ends(html: str) -> str:
    """The page up to a comment or tag that never ends, which a browser drops with the rest."""
    at = html.find("<!--")
    while at >= 0:
        end = html.find("-->", at + 4)
        if end < 0:
            html = html[:at]
            break
        at = html.find("<!--", end)
    loose = re.compile(r"<[a-zA-Z/!?]").search(html, html.rfind(">") + 1)
    return html[: loose.start()] if loose else html


class Node:
    __slots__ = ("bits", "children", "link", "links", "named", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, named: str = "", link: int = 0):
        self.tag, self.parent, self.named, self.link = tag, parent, named, link
        self.children: list[Node] = []
        self.bits: list[tuple[int, str, int]] = []  # place, text, the link it is inside of
        self.score = 0.0
        self.size = self.links = 0


class Tree(HTMLParser):
    """Block tree of a page; inline elements leave only their text and whether it is linked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.place = self.link = 0
        self.opened: list[Node] = [self.root]  # by link, the block in which it begins
        self.ended: set[int] = set()
        self.skipped: list[str] = []

    def noise(self, tag: str, a: dict[str, str]) -> bool:
        """Elements that are left out unread, by kind, role or style; names only count later."""
        if tag == "figure" or tag == "header" and self.inside(KEEPS_HEADER):
            return False
        unseen = "hidden" in a or a.get("aria-hidden") == "true" or UNSEEN.search(a.get("style", ""))
        return bool(tag in DROPPED or a.get("role", "").lower() in NOISE_ROLES or unseen)

    def leave(self, node: Node) -> None:
        """Close a block; a link that began inside it ends with it."""
        self.at, self.link = node.parent, node.link

    def inside(self, tags: frozenset[str]) -> bool:
        node: Node | None = self.at
        while node:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def end_open(self, tags: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of these tags, unless a fence stands before it."""
        node = self.at
        while node.parent and node.tag not in fence:
            if node.tag in tags:
                self.leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr") and not self.skipped:
                self.text(" ")
            return
        if self.skipped:
            if tag in ENDS_P and self.skipped[-1] == "p":
                self.skipped.pop()
            if tag in SIBLINGS.get(self.skipped[-1] if self.skipped else "", ()):
                self.skipped.pop()
            if self.skipped:
                self.skipped.append(tag)
                return
        if tag in ENDS_P:
            self.end_open({"p"}, BLOCKS - {"p"})
        for old, new in SIBLINGS.items():
            if tag in new:
                self.end_open({old}, FENCE.get(old, set()) | {"article", "main"})
        if tag == "body":
            self.at = self.root
            return
        a = {k: v or "" for k, v in attrs}
        named = rank_name(a) if tag not in ("html", "article", "main") and ("class" in a or "id" in a) else ""
        if self.noise(tag, a) or (named and tag in INLINE):
            self.skipped = [tag]
        elif (tag in BLOCKS or named) and tag != "html":
            node = Node(tag, self.at, named, self.link)
            self.at.children.append(node)
            self.at = node
        elif tag == "a":
            self.link = len(self.opened)
            self.opened.append(self.at)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            elif tag in ("article", "main", "body", "html") and self.inside(frozenset({tag})) and self.skipped[0] not in ("script", "style"):
                self.skipped = []  # the end of what holds an element that was never closed
                self.handle_endtag(tag)
            return
        if tag == "a":
            self.ended.add(self.link)
            self.link = 0
        elif tag not in INLINE and tag not in ("html", "body"):
            node = self.at
            while node.parent and node.tag != tag and (tag in BLOCKS or node.tag not in BLOCKS):
                node = node.parent
            if node.parent and node.tag == tag:
                self.leave(node)

    def handle_data(self, data):
        if not self.skipped:
            self.text(data)

    def text(self, data: str) -> None:
        self.place += 1
        self.at.bits.append((self.place, data, self.link))
        if self.at.children and data.strip() == "" and not any(t.strip() for _, t, _ in self.at.bits):
            self.at.bits.pop()

    def blocks(self) -> list[Node]:
        """All blocks, parents first, with the links settled: a link that never ends reaches to
        the end of the block it begins in."""
        order, stack = [], [self.root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += n.children
            n.bits = [(p, t, bool(k) and (k in self.ended or self.opened[k] is n)) for p, t, k in n.bits]
        return order

    def drop_named(self) -> list[Node]:
        """Leave out what names call comments or noise, unless it is no small part of the page:
        it holds an article, or half the prose that is not comments. Parts called related stay
        inside an article if they read like prose. Gives the blocks that stay, parents first."""
        order = self.blocks()
        prose = {id(n): [sum(len(t.strip()) for _, t, k in n.bits if not k), sum(len(t.strip()) for _, t, k in n.bits if k)] for n in order}
        holds = {id(n): n.tag in ("article", "main") for n in order}
        for n in reversed(order):
            if n.parent and n.named != "comment":
                holds[id(n.parent)] |= holds[id(n)]
                for i in (0, 1):
                    prose[id(n.parent)][i] += prose[id(n)][i]
        whole, kept, within, stack = prose[id(self.root)][0], [], {id(self.root): False}, [self.root]
        while stack:
            n = stack.pop()
            kept.append(n)
            inner = within[id(n)] or n.tag in ("article", "main")

            def stays(c: Node) -> bool:
                own, linked = prose[id(c)]
                if not c.named or c.named == "comment":
                    return not c.named
                return holds[id(c)] or 2 * own > whole or (c.named == "related" and inner and own > 2 * linked)

            n.children = [c for c in n.children if stays(c)]
            within |= {id(c): inner for c in n.children}
            stack += n.children
        return kept


def main_text(html: str, *, link_limit: float = 0.5, sibling_share: float = 0.2) -> str:
    """The article of a page; blocks joined by an empty line, and empty if there is none."""
    tree = Tree()
    tree.feed(without_loose_ends(html))
    tree.close()
    order = tree.drop_named()
    blocks: dict[int, list[tuple[int, str, int]]] = {}
    first: dict[int, list[int]] = {}
    for n in reversed(order):
        cuts = sorted(min(first[id(c)]) for c in n.children if first[id(c)])
        blocks[id(n)] = cut_blocks(n, cuts)
        mine = [p for p, t, _ in n.bits if t.strip()][:1]
        first[id(n)] = [min([*mine, *cuts])] if mine or cuts else []
        n.size = sum(len(t) for _, t, _ in blocks[id(n)]) + sum(c.size for c in n.children)
        n.links = sum(k for _, _, k in blocks[id(n)]) + sum(c.links for c in n.children)
    for n in order:
        for _, text, linked in blocks[id(n)]:
            if linked > link_limit * len(text):
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            up, level = (n if n.tag in ("div", "section", "article", "main", "body", "html") else n.parent or n), 1
            while up and level <= FARTHEST:
                up.score += points / level
                up, level = up.parent, level + 1
    rated = {id(n): n.score * (1 - n.links / n.size if n.size else 0) + 25 * (n.tag in ("article", "main") and n.size > 0) for n in order}
    holders = [n for n in order if n.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") and n.size]
    if not holders:
        return ""
    best = max(holders, key=lambda n: rated[id(n)])
    if not rated[id(best)]:
        return ""
    picked = [best]
    if best.parent and best.tag not in ("article", "main"):
        for s in best.parent.children:
            dense = s.links / s.size if s.size else 1
            prose = s.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and dense <= link_limit and s.size > 0
            if s is not best and (rated[id(s)] >= max(10, sibling_share * rated[id(best)]) or prose):
                picked.append(s)
    elif best.parent:
        picked += [s for s in best.parent.children if s is not best and s.tag == best.tag and rated[id(s)] - 25 >= max(10, sibling_share * (rated[id(best)] - 25))]
    out: list[tuple[int, str]] = []
    stack, chosen, inside = list(picked), {id(n) for n in picked}, best
    while inside and inside.tag not in ("article", "main"):
        inside = inside.parent
    while stack:
        n = stack.pop()
        # Inside an article, lists and tables of links are references; elsewhere they are menus.
        menu = not inside and n.tag in ("ul", "ol", "table", "div", "section") and id(n) not in chosen and n.size and n.links > link_limit * n.size
        if not menu:
            out += [(p, t) for p, t, _ in blocks[id(n)]]
            stack += n.children
    return "\n\n".join(t for _, t in sorted(out))


def cut_blocks(node: Node, cuts: list[int]) -> list[tuple[int, str, int]]:
    """The node's own text as (place, text, linked length), cut where its children's text begins."""
    out, run, k = [], [], 0

    def end():
        text = SPACES.sub(" ", "".join(t for _, t, _ in run)).strip()
        if text:
            out.append((next(p for p, t, _ in run if t.strip()), text, len(SPACES.sub(" ", "".join(t for _, t, linked in run if linked)).strip())))

    for bit in node.bits:
        if k < len(cuts) and cuts[k] < bit[0]:
            end()
            run = []
            while k < len(cuts) and cuts[k] < bit[0]:
                k += 1
        run.append(bit)
    end()
    return out


def extract_main_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every page: the kept columns, text and n_chars (code points).

    Other columns take no part, whatever they are called. A null page counts as empty and gives an empty text, as does a page without an
    article; repeated rows each give a row; pages are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each_batch(batches, 256):
            texts = [main_text(h or "") for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"]
            )

    picked = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)])
    return picked.mapInArrow(run, f"{kinds}, text string, n_chars long")
