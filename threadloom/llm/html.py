"""Main text of web pages by tag-path ratios.

Every text block has a root-to-leaf path of block tags. Per path of a page, the
text length, the punctuation and the link text of its blocks are summed and set
against the number of blocks: long, punctuated, unlinked paths are content. The
two ratios are fused to a product, smoothed over neighbouring blocks in page
order, and averaged over the path; paths below a threshold go. Then the element
that holds the content is found, the deepest with nine tenths of the kept text,
and short text within it (list items, cells, quotations, captions, code) stays
unless it is mere links.

What markup says comes in as follows. Elements that HTML gives another purpose
(navigation, forms, scripts, headers, footers, asides) hold no article text and
are left out. A class, id or role that names such a part ("ad", "site-footer",
"comment-list") is a hint only: it weighs the ratios of all it contains by
``HINTED``, and it keeps short text from staying for its surroundings' sake. It
can't shut a wrapper out: where a whole page stands below a hint, all ratios
shrink and so does the threshold. ``article``, ``main`` and ``role=main`` are a
hint the other way: they add the threshold to the score of the paths within,
however short their blocks, unless these are mere links.

Reader comments are told by names too ("responses", an item type of Comment), and by
structure: siblings of one kind that each name a writer and a date or deed ("reply", "vote")
are left out, with the element that holds mostly such siblings. A single comment without any
such name stays.

Defined results
- null or empty html, or no content: empty text, 0 characters
- unclosed and stray tags: repaired as browsers do for paragraphs, items and cells
- drawings, templates and noscript: left out up to their end, that of what is around them, or for a
  drawing the next element of text; without any end tag on the rest of the page they hold nothing
- formulas are text; comments may be empty, and one without an end takes the rest, as in browsers
- very long pages, deep nesting, broken tags: time and memory in proportion to the page
- ties of elements for the content: the one that begins last
- repeated rows: each is read; empty table: no rows; extra columns are dropped
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
EMPTY_COMMENT, COMMENT_END = re.compile("-?>"), re.compile("--!?>")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements with markup that is no text of the page. Without an end tag they hold nothing.
UNSHOWN = frozenset("svg template noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace mpadded semantics annotation svg template noscript".split())
#: Start tags that end a drawing left open: it holds none of them.
FLOW = frozenset("article section main header footer nav aside form p div ul ol li dl dt dd table blockquote pre figure h1 h2 h3 h4 h5 h6 body hr".split())
#: Elements that never hold an article's own text.
BARRED = frozenset("svg template noscript annotation head nav header footer aside form button select option menu dialog object embed canvas audio video map fieldset".split())
#: Words that name such parts in a class, id or role.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar search searchbox "
    "header masthead topbar footer contentinfo copyright legal sidebar aside complementary widget widgets "
    "comment comments commentlist disqus reply replies respond response responses discussion feedback talkback guestbook "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations teaser teasers hidden".split()
)
#: Words that may follow such a word in one name: "comment-list" is a part, "social-studies" is not.
HOLDERS = frozenset("area bar block body box buttons card column container content form group icons inner item items links list message panel row section slot text thread title unit wrap wrapper zone".split())
#: Words that turn such a name into a remark about the page: "no-sidebar".
REMARKS = frozenset("has no with without is not hide show single".split())
#: Words in classes and the like that name who wrote a contribution, and when or what to do with it.
WRITERS = frozenset("author user username usercard avatar nick nickname commenter byline poster profile".split())
DEEDS = frozenset("date datetime time timestamp ago posted reply permalink report like likes vote votes upvote".split())
HINTED = 1 / 50
#: Share of linked text from which a text is mere links.
LINKED = 0.9
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
HEADING = re.compile(r"h[1-6]")
#: Elements that hold an article's text where it has no element of its own around it.
TEXT_ELEMENTS = frozenset("p ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption caption h1 h2 h3 h4 h5 h6".split())


@dataclass(slots=True)
class Node:
    """An open or closed element; ``path`` numbers its root-to-leaf path, hints and marks included."""

    name: str
    path: int
    barred: bool = False
    hinted: bool = False
    marked: bool = False
    up: Node | None = None
    mass: float = 0.0
    content: bool = False
    sign: str = ""
    marks: int = 0
    beside: bool = False


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def names_a_part(name: str) -> bool:
    """Whether one class, id or role names a part beside the article."""
    words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]
    while words and (words[-1] in HOLDERS or words[-1].isdigit()) and len(words) > 1:
        words.pop()
    return bool(words) and words[-1] in PARTS and not REMARKS.intersection(words)


def reading(name: str, attrs: str) -> tuple[bool, bool, bool, int, str]:
    """Whether an element is barred, hinted at as another part, or marked as the main one;
    1 for a writer's mark and 2 for one of a deed, added up; and its classes."""
    barred, hinted, marked = name in BARRED, False, name in ("article", "main")
    marks, classes = 2 * (name == "time"), ""
    if attrs.strip():
        for key, *values in ATTRIBUTE.findall(attrs):
            value, key = "".join(values).lower(), key.lower()
            if key == "style":
                barred |= "display:none" in value.replace(" ", "")
            elif key in ("hidden", "aria-hidden"):
                barred |= value != "false"
            elif key in ("class", "id", "role"):
                marked |= key == "role" and value == "main"
                hinted |= name not in ("html", "body") and any(map(names_a_part, value.split()))
            if key in ("class", "rel", "itemprop", "itemtype"):
                words = set(re.split(r"[^a-z0-9]+", value))
                marks |= (not words.isdisjoint(WRITERS)) | 2 * (not words.isdisjoint(DEEDS))
                hinted |= key[:4] == "item" and "comment" in words
                classes = value if key == "class" else classes
    return barred, hinted, marked and not hinted, marks, classes


def tags(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """The page as (text before, closing, tag name, attributes, place), the name empty for what is no tag; one pass."""
    at, trusted, last = 0, True, page.rfind(">")
    seen = 0
    while True:
        begin = page.find("<", seen)
        if begin < 0:
            yield page[at:], False, "", "", begin
            return
        if page.startswith("<!--", begin):
            end = EMPTY_COMMENT.match(page, begin + 4) or COMMENT_END.search(page, begin + 4)
            yield page[at:begin], False, "", "", begin
            at = seen = end.end() if end else len(page)
            continue
        m = OPENING.match(page, begin)
        if begin > last or m is None and page[begin + 1 : begin + 2] not in ("!", "?", "/"):
            seen = begin + 1  # no tag: text
            continue
        if m is None:
            end = page.find(">", begin)
            yield page[at:begin], False, "", "", begin
            at = seen = end + 1
            continue
        # a quotation that never ends leaves no tag to its right trusted with quotations
        end = ATTRIBUTES.match(page, m.end()).end() if trusted else page.find(">", m.end())
        if trusted and page[end : end + 1] != ">":
            trusted, end = False, page.find(">", m.end())
        name = m[2].lower()
        yield page[at:begin], bool(m[1]), name, page[m.end() : end], begin
        at = seen = end + 1
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = seen = close.end() if close else len(page)


def blocks(page: str) -> list[Block]:
    """The unbarred text blocks of a page, in page order."""
    stack, out, linked = [Node("", 0)], [], 0
    opened: Counter[str] = Counter()
    numbers: dict[tuple, int] = {}
    ends: dict[str, int] = {}
    current: Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        if not raw or stack[-1].barred:
            return
        decoded = entities.unescape(raw) if "&" in raw else raw
        if current is None:
            if not decoded.strip():
                return
            current = Block(stack[-1])
            out.append(current)
        current.parts.append(decoded)
        if linked:
            current.linked += len(decoded.strip())

    def mark(node: Node | None, marks: int) -> None:
        while node is not None and marks & ~node.marks:
            node.marks |= marks
            node = node.up

    def push(name: str, attrs: str, inline: bool = False) -> None:
        top = stack[-1]
        barred, hinted, marked, marks, classes = reading(name, attrs)
        if inline and not (barred or hinted):
            mark(top, marks)
            return
        barred, hinted, marked = top.barred or barred, top.hinted or hinted, (top.marked or marked) and not hinted
        number = numbers.setdefault((top.path, "" if inline else name, hinted, marked), len(numbers) + 1)
        stack.append(Node(name, number, barred, hinted, marked, top, sign=f"{name} {classes}"))
        mark(stack[-1], marks)
        opened[name] += 1

    def pop_to(names: tuple[str, ...], until: tuple[str, ...] = ()) -> None:
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in until:
                    return
                if stack[i].name in names:
                    for node in stack[i:]:
                        opened[node.name] -= 1
                    del stack[i:]
                    return

    for before, closing, name, attrs, place in tags(page):
        text(before)
        if not name or name in RAW:
            continue
        if name == "br":
            text(" ")
            continue
        if name in UNSHOWN and not closing:
            if attrs.endswith("/") and name == "svg":
                continue
            if name not in ends:  # looked up once a page
                last = None
                for last in re.finditer(rf"</{name}(?=[\s/>])", page, re.I):
                    pass
                ends[name] = last.start() if last else -1
            if ends[name] < place:
                continue
        if opened["svg"] and not opened["foreignobject"] and name in FLOW and not closing:
            pop_to(("svg",))
        if name == "a":
            linked = 0 if closing else 1
        if name in INLINE:
            if closing:
                if opened[name]:
                    pop_to((name,), ("article", "main", "body"))
                    if current is not None and stack[-1].barred != current.node.barred:
                        current = None
            elif name in VOID:
                mark(stack[-1], reading(name, attrs)[3])
            elif not attrs.endswith("/") or name[0] != "m":
                depth = len(stack)
                push(name, attrs, inline=True)
                if len(stack) > depth and not stack[-1].barred:
                    current = None
            continue
        if not stack[-1].barred:  # what is left out parts no text
            current = None
        if name in VOID:
            continue
        if closing:
            if name not in ("html", "body"):
                pop_to((name,), ("article", "main", "body") if name in ("p", "li", "div") else ())
                if current is not None and current.node is not stack[-1] and not stack[-1].barred:
                    current = None
            continue
        if name == "body":
            pop_to(("head",))
        elif name == "head" and opened["body"]:
            continue
        if name in CLOSES:
            shut, within = CLOSES[name]
            for one in shut.split():
                pop_to((one,), (*within, *UNSHOWN))
        pop_to(("p",), ("td", "th", "li", "button", "article", "section", "div", "blockquote", *UNSHOWN))
        push(name, attrs)
    kept = []
    for b in out:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            kept.append(b)
    return without_contributions(kept)


def without_contributions(found: list[Block]) -> list[Block]:
    """The blocks without readers' contributions: two or more siblings of one kind that each name a
    writer and a date or deed. What holds mostly such siblings goes too, with its heading."""
    order = around(found)
    mass: Counter[int] = Counter()
    kinds: dict[tuple[int, str], list[Node]] = defaultdict(list)
    for b in found:
        mass[id(b.node)] += len(b.text)
    for node in reversed(order):
        if node.up is not None:
            mass[id(node.up)] += mass[id(node)]
            if node.name not in ("html", "body", "main"):
                kinds[id(node.up), node.sign].append(node)
    for alike in kinds.values():
        if len(alike) > 1 and all(n.marks == 3 for n in alike):
            up, own = alike[0].up, sum(mass[id(n)] for n in alike)
            up.beside |= up.name not in ("", "html", "body", "main", "article") and 2 * own > mass[id(up)]
            for n in alike:
                n.beside = True
    for node in order:
        node.beside |= node.up is not None and node.up.beside
    return [b for b in found if not b.node.beside]


def around(found: list[Block]) -> list[Node]:
    """Every element around a block, the outer before the inner."""
    order: dict[int, Node] = {}
    for b in found:
        line, node = [], b.node
        while node is not None and id(node) not in order:
            line.append(node)
            node = node.up
        order.update((id(n), n) for n in reversed(line))
    return list(order.values())


def content_paths(found: list[Block]) -> set[int]:
    """The paths whose fused, smoothed ratios reach the threshold. Where a path without a hint
    does, those with one must also reach the mean, as few blocks make a low threshold."""
    paths: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0])
    weight = {}
    for b in found:
        sums = paths[b.node.path]
        sums[0] += len(b.text)
        sums[1] += len(PUNCTUATION.findall(b.text))
        sums[2] += min(b.linked, len(b.text))
        sums[3] += 1
        weight[b.node.path] = HINTED if b.node.hinted else 1.0
    # text-to-path and punctuation-to-path ratios, fused; linked text does not count
    fused = {p: weight[p] * (chars - links) / n * (1 + marks / n) * (1 - links / chars) for p, (chars, marks, links, n) in paths.items()}
    raw = [fused[b.node.path] for b in found]
    beside = [raw[0], *raw, raw[-1]]
    smooth: dict[int, list[float]] = defaultdict(list)
    for b, left, own, right in zip(found, beside, raw, beside[2:], strict=False):
        smooth[b.node.path].append(min(0.25 * left + 0.5 * own + 0.25 * right, 2 * own))
    mean = sum(raw) / len(raw)
    spread = math.sqrt(sum((r - mean) ** 2 for r in raw) / len(raw))
    bar = min(mean, spread)
    scores = {p: sum(s) / len(s) if fused[p] > 0 else -1.0 for p, s in smooth.items()}
    for p in {b.node.path for b in found if b.node.marked}:
        if paths[p][2] < LINKED * paths[p][0]:
            scores[p] += bar
    keep = {p for p, score in scores.items() if score >= bar}
    hinted = {b.node.path for b in found if b.node.hinted}
    return keep if keep <= hinted else {p for p in keep if p not in hinted or scores[p] >= max(bar, mean)}


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = content_paths(found)
    # a heading belongs to the content that follows it
    for b, after in zip(found, found[1:], strict=False):
        if HEADING.fullmatch(b.node.name) and after.node.path in keep and b.node.hinted == after.node.hinted:
            keep.add(b.node.path)
    _hold_content(found, keep)
    return "\n".join(b.text for b in found if b.node.path in keep or b.node.content and b.linked < LINKED * len(b.text))


def _hold_content(found: list[Block], keep: set[int]) -> None:
    """Marks the elements that hold the content, all within them too: the deepest
    that nine tenths of the kept text has around it, and the parent of every kept paragraph.
    A hint that begins within them ends the mark."""
    nodes = around(found)
    for b in found:
        if b.node.path in keep:
            holder = b.node.up or b.node
            holder.mass += len(b.text)
            holder.content |= b.node.name == "p"
    total = sum(n.mass for n in nodes)
    for n in reversed(nodes):
        if n.up is not None:
            n.up.mass += n.mass
    if total:
        holds = next(n for n in reversed(nodes) if n.mass >= 0.9 * total)
        holds.content = True
    for n in nodes:
        if n.up is not None and n.up.content and not n.content:
            bare = n.up.name in ("", "html", "body") and not n.up.marked  # a page is no element of the article's own
            n.content = (n.hinted == n.up.hinted) and (not bare or n.name in TEXT_ELEMENTS or n.mass > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
