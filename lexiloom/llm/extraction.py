"""Main text of web pages by minimum cut.

A page becomes its text blocks in order. A linear classifier over what a block is
and where it stands (length, links, sentence marks, tag, names of the elements
around it) gives each block a cost for either label; positive costs are capacities
from the source (content), negative ones to the sink (boilerplate). Neighbouring
blocks, and blocks of one parent element, are joined by edges whose capacity grows
with their proximity in the DOM. Blocks on the source side of the minimum cut are
the main text.

Tags that hold no article text (menus, forms, footers), hidden elements, adverts and
reader comments bar a block. What class, id and role say is evidence only: long prose
outweighs a name, and where names alone leave nothing of a page, they do not count. A
page without any hint is its text that nothing speaks against.

Pages are independent rows: no shuffle, memory bounded by one batch of pages and one
page's blocks.

Defined results: null, empty and textless pages give an empty text; unclosed tags end
where the enclosing element or the page ends; a self-closed svg, and in XHTML any
self-closed element without text of the page, ends where it stands; unknown end tags are skipped; broken
character references stay as they are; repeated rows get the same text; a very long page
is one row like any other; columns named like results give way to them.
"""

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.blocks import bounded_batches

#: tags whose content is never text of the page
SILENT = "script|style|noscript|template|svg|iframe|object|canvas|audio|video|title|select|textarea|button|datalist"
#: attributes up to a slash that ends the element; the slash of an unquoted value does not
SELF_CLOSED = r"""(?=[\s/])(?:[\s/]*+[^\s"'=<>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+\s*+/>"""


def tokens(self_closed: str) -> re.Pattern[str]:
    return re.compile(
        rf"<!--.*?(?:-->|\Z)|<(?:{self_closed}){SELF_CLOSED}"
        rf"|<({SILENT})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
        r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>",
        re.S | re.I,
    )


#: HTML lets only foreign elements end themselves, XHTML all
TOKEN, XHTML_TOKEN = tokens("svg"), tokens(SILENT)
XHTML = re.compile(r"\A\W*<\?xml\b|<!doctype[^>]*\bxhtml\b|<html\b[^>]*\bxmlns\s*=", re.I)
HEAD = 4096
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: a start tag ends an open element of its own kind, up to the enclosing one
REPEATS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
HOLDS = frozenset("article aside body blockquote div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())

BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
CONTENT_TAGS = frozenset(("article", "main"))
BOILERPLATE_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentary consent cookie cookies copyright "
    "disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe tags teaser toolbar "
    "topbar warning widget alert complementary contentinfo discussion".split()
)
#: parts that decide wherever they stand, and parts that take the meaning away
ALWAYS = frozenset("ad ads advert adverts advertisement comment comments disqus".split())
ABSENT = frozenset("with without has no not".split())
CONTENT_NAMES = frozenset("article articlebody content entry main post story text".split())

#: the classifier: fixed weights
BIAS, PER_LOG_WORD, LINKS, SENTENCE, HEADING, INSIDE, BARRED = -1.2, 0.5, -4.0, 0.8, 1.0, 5.0, -12.0
#: a name of boilerplate: by itself, and as a part of a longer one
NAMED, PART_NAMED = -7.0, -6.0
#: smoothness: consecutive blocks of one parent, of one grandparent, other; and the last block of the same parent
SAME_PARENT, SAME_GRANDPARENT, ADJACENT, SIBLING, ACROSS = 1.5, 0.75, 0.3, 0.75, 0.1


class Element(NamedTuple):
    tag: str
    number: int
    parent: int
    inside: bool  # of an element that is named as content
    outside: int  # number of the outermost boilerplate element around, or 0
    barred: bool  # by a tag, hiding, or a name that decides
    name: float  # what names around say against it


class TextBlock(NamedTuple):
    text: str
    linked: int
    heading: bool
    element: int
    parent: int
    grandparent: int
    inside: bool
    outside: int
    barred: bool
    name: float


def attributes_of(tag: str) -> dict[str, str]:
    """Names in lower case with their values; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(HIDING_STYLE.search(attributes.get("style", "")))


def named(attributes: dict[str, str], inside: bool) -> tuple[bool, float, bool]:
    """What class, id and role say: is it barred, what speaks against it, is it content?

    The last part of a compound says what an element is, the first where it belongs;
    "with-sidebar" says neither. A header inside an article heads the article.
    """
    barred, against, content = False, 0.0, False
    for value in " ".join(attributes.get(a, "") for a in ("class", "id", "role")).split():
        parts = [x.lower() for x in PART.findall(value)]
        if not parts or ABSENT.intersection(parts):
            continue
        if inside and parts[-1] == "header":
            continue
        barred |= parts[0] in ALWAYS or parts[-1] in ALWAYS
        if parts[-1] in BOILERPLATE_NAMES or parts[0] in BOILERPLATE_NAMES:
            against = min(against, NAMED if len(parts) == 1 or not inside else PART_NAMED)
        content |= not CONTENT_NAMES.isdisjoint(parts) or value.lower() in CONTENT_NAMES
    return barred, against, content


def text_blocks(page: str) -> list[TextBlock]:
    """Text between block-level tags, in page order; white space is one space."""
    stack = [Element("", 0, 0, False, 0, False, 0.0)]
    opened: dict[str, int] = {}
    blocks: list[TextBlock] = []
    parts: list[str] = []
    parents: dict[int, int] = {}
    linked, links, numbers, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, parts
        text = " ".join("".join(parts).split())
        if text:
            own = next((e for e in reversed(stack) if e.tag in BLOCK), stack[0])
            up = own.parent
            blocks.append(TextBlock(text, min(linked, len(text)), own.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), own.number, up, parents.get(up, 0), own.inside, own.outside, own.barred, own.name))
        parts, linked = [], 0

    def close(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            gone = stack.pop()
            opened[gone.tag] -= 1
            links -= gone.tag == "a"

    for token in (XHTML_TOKEN if XHTML.search(page, 0, HEAD) else TOKEN).finditer(page):
        if token.start() > at:
            raw = html.unescape(page[at : token.start()])
            parts.append(raw)
            if links:
                linked += len(raw)
        at = token.end()
        tag = (token[3] or token[6] or "").lower()
        if not tag:
            continue
        ends, attributes = token[2] or token[5], token[4] or token[7] or ""
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ends:
            if opened.get(tag):
                close(max(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if stack[-1].tag != tag else len(stack) - 1)
            continue
        if tag in VOID:
            continue
        ended = REPEATS.get(tag, {"p"} if tag in BLOCK else ())
        if any(opened.get(t) for t in ended):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    close(i)
                    break
                if stack[i].tag in HOLDS:
                    break
        around = stack[-1]
        numbers += 1
        outside, inside, barred, name = around.outside, around.inside, around.barred, around.name
        if tag in BLOCK or attributes:
            held = attributes_of(attributes) if attributes else {}
            never, against, content = named(held, inside) if held and tag not in ("html", "body") else (False, 0.0, False)
            barred |= never or hidden(held) or tag in BOILERPLATE_TAGS or (tag == "header" and not inside)
            name = min(name, against)
            if (barred and not around.barred) or against < 0:
                outside = outside or numbers
            elif tag in CONTENT_TAGS or content:
                inside = True
        if tag in BLOCK:
            parent = next((e.number for e in reversed(stack) if e.tag in BLOCK), 0)
            parents[numbers] = parent
        else:
            parent = around.parent
        stack.append(Element(tag, numbers, parent, inside, outside, barred, name))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":
            close(len(stack) - 1)
    raw = html.unescape(page[at:])
    parts.append(raw)
    if links:
        linked += len(raw)
    flush()
    return blocks


def cost(block: TextBlock) -> float:
    """How much rather content (above 0) or boilerplate (below 0), by the block alone."""
    words = block.text.count(" ") + 1
    score = BIAS + PER_LOG_WORD * words.bit_length() + LINKS * block.linked / len(block.text)
    score += SENTENCE * (words > 2 and block.text[-1] in ".!?…。\"'»”") + HEADING * block.heading
    return score + INSIDE * block.inside + (BARRED if block.barred else block.name)


def edges(blocks: list[TextBlock]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[tuple[int, int], int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            if a.outside != b.outside:
                near = ACROSS
            elif a.parent == b.parent:
                near = SAME_PARENT
            else:
                near = SAME_GRANDPARENT if a.grandparent == b.grandparent else ADJACENT
            out.append((i - 1, i, near))
        before = last.get((b.parent, b.outside))
        if before is not None and before < i - 1:
            out.append((before, i, SIBLING))
        last[b.parent, b.outside] = i
    return out


def source_side(costs: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut: maximum flow by level graphs.

    The two terminal arcs of a node are already cancelled against each other: a
    positive cost is supply, a negative one demand.
    """
    n = len(costs)
    supply = [max(c, 0.0) for c in costs]
    demand = [max(-c, 0.0) for c in costs]
    if not any(supply) or not any(demand):
        return [s > 0 for s in supply]
    arcs: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, c in links:
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head += [b, a]
        room += [c, c]
    least = 1e-9
    while True:
        level = [0 if s > least else -1 for s in supply]
        queue = [i for i in range(n) if level[i] == 0]
        reached = False
        for u in queue:
            reached |= demand[u] > least
            for e in arcs[u]:
                v = head[e]
                if level[v] < 0 and room[e] > least:
                    level[v] = level[u] + 1
                    queue.append(v)
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in [i for i in range(n) if supply[i] > least]:
            path: list[int] = []
            u = source
            while supply[source] > least:
                if demand[u] > least:
                    flow = min([supply[source], demand[u], *(room[e] for e in path)])
                    supply[source] -= flow
                    demand[u] -= flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    full = next((i for i, e in enumerate(path) if room[e] <= least), None)
                    if full is not None:
                        u = head[path[full] ^ 1]
                        del path[full:]
                    continue
                while tried[u] < len(arcs[u]):
                    e = arcs[u][tried[u]]
                    if room[e] > least and level[head[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                if tried[u] < len(arcs[u]):
                    path.append(e)
                    u = head[e]
                elif path:
                    u = head[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break


def labels(blocks: list[TextBlock]) -> list[bool]:
    """Which blocks are main text."""
    content = source_side([cost(b) for b in blocks], edges(blocks))
    if not any(content) and any(b.name < 0 and not b.barred for b in blocks):
        unnamed = [b._replace(name=0.0) for b in blocks]
        content = source_side([cost(b) for b in unnamed], edges(unnamed))
    return content if any(content) else [not b.barred and not b.name for b in blocks]


def main_text(page: str | None) -> str:
    blocks = text_blocks(page or "")
    return " ".join(b.text for b, c in zip(blocks, labels(blocks), strict=True) if c)


def _extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``, its code points."""
    bounded_batches(pages.sparkSession)
    out = pages.withColumn("__main", F.arrow_udf(_extract, "string")(F.col(page).cast("string")))
    kept: list[Column] = [F.col(c) for c in pages.columns if c not in ("text", "n_chars")]
    return out.select(*kept, F.col("__main").alias("text"), F.length("__main").cast("bigint").alias("n_chars"))
