"""Main text of HTML pages by minimum cut (operator 8).

A page is read into a tree, and its visible text into blocks: runs of text between
block-level borders. Each block gets a cost of being called content and a cost of
being called boilerplate from a linear classifier, its weights set by hand, over what
the tree says about it (the elements it lies in, words in class, id and role names,
link density, length, sentence marks). The costs are the capacities from source and to
sink; neighbouring blocks, and blocks under one parent, are joined by smoothness edges
that cost something to cut, so that a lone link among paragraphs, or a lone sentence
among links, goes with its neighbours. The minimum cut (push along shortest augmenting
paths) labels all blocks of the page at once. Elements whose meaning is fixed by HTML
itself (nav, footer, aside, form, script, style and the like) bind their blocks to
the sink. A name that may as well be a subject (reviews, legal, discussion) says
nothing on an element that holds an article or most of the page's text.

Defined results: null, empty or text-free pages have the empty text and 0
characters; malformed markup (unclosed and stray tags, bare < and &) is read as
browsers do it where it matters here; very long pages are read whole, in time
linear in their length but for the cut, whose graph has a bounded number of edges
a block; repeated rows give repeated results; an empty table gives no rows. Further
columns don't matter.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import binaries

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""
    address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
    thead title tr ul
""".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button map title".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
CHROME = frozenset("nav footer aside form menu dialog".split())
CLOSES_P = frozenset("""
    address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    main menu nav ol p pre section summary table ul
""".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

# Words in class, id and role names that speak for boilerplate or content.
BAD_WORDS = frozenset("""
    ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted affiliate
    nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs topbar toolbar tabs pager pagination
    header masthead branding logo footer foot colophon contentinfo complementary
    sidebar side aside rail widget widgets related recommended recommendations recirculation trending popular mostread
    share sharing social follow subscribe subscription newsletter signup login signin register paywall
    cookie cookies consent gdpr notice notices notification alert disclaimer legal popup modal overlay lightbox toast
    comment comments commenting disqus reply replies respond responses discussion reader feedback reviews
    search searchbox form skip skiplink hidden print copyright tags taglist meta byline author toc jump outbrain taboola
""".split())
# Of these, names that may be a page's subject too.
SUBJECTS = frozenset("""
    side rail popular trending related share sharing social follow subscribe subscription newsletter login signin signup register notice notices
    alert disclaimer legal promo promotion discussion reader feedback reviews responses search print copyright tags meta byline author toc jump logo branding banner
""".split())
GOOD_WORDS = frozenset("article articlebody body content contents entry hentry main maincontent page post posts postbody story storybody text prose".split())

TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|--!>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"([a-z])([A-Z])")

NAMED = 8.0
OUTSIDE = 4.0  # of an article that the page marks and that holds most of its text
SMOOTH_NEXT = 1.5
SMOOTH_PARENT = 1.5
BIND = 1e6


class Node:
    __slots__ = ("name", "parent", "bound", "bad", "subject", "good", "inside", "link", "hidden", "holds", "size")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.bound = bool(parent and parent.bound) or name in CHROME
        self.hidden = bool(parent and parent.hidden) or name in HIDDEN
        self.link = bool(parent and parent.link) or name == "a"
        self.inside = bool(parent and parent.inside) or name in ("article", "main")
        bad = subject = good = 0
        self.holds, self.size = False, 0  # an article; characters outside links
        if attrs and not self.hidden:
            for m in ATTR.finditer(attrs):
                key = m[1].lower()
                value = unescape(m[2] or m[3] or m[4] or "")
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    words = set(WORD.findall(CAMEL.sub(r"\1 \2", value).lower()))
                    bad += bool(words & BAD_WORDS - SUBJECTS)
                    subject += bool(words & SUBJECTS) and not words & BAD_WORDS - SUBJECTS
                    good += bool(words & GOOD_WORDS)
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    self.hidden = True
        if name == "header" and not self.inside:
            bad += 1
        if name in ("body", "html"):
            bad = subject = 0
        self.bad, self.subject = bad, subject
        self.good = (parent.good if parent else 0) + good
        if name in ("article", "main") and not self.hidden:
            while parent is not None and not parent.holds:
                parent.holds, parent = True, parent.parent


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks_of(html: str) -> list[Block]:
    """Visible blocks of a page in page order, white space normalised, references decoded."""
    node = Node("#root", "", None)
    out: list[Block] = []
    held: list[tuple[str, bool]] = []
    owner = node

    def flush() -> None:
        if held:
            text = " ".join("".join([t for t, _ in held]).split())
            if text:
                out.append(Block(text, owner, sum(len(t) for t, link in held if link)))
            held.clear()

    def add(raw: str) -> None:
        nonlocal owner
        if raw and not node.hidden:
            if not held:
                owner = node
                while owner.name not in BLOCK and owner.parent is not None:
                    owner = owner.parent
            held.append((unescape(raw), node.link))

    def close(name: str, stop=frozenset()) -> bool:
        nonlocal node
        at = node
        while at.parent is not None and at.name != name:
            if at.name in stop:
                return False
            at = at.parent
        if at.parent is None:
            return False
        node = at.parent
        return True

    place, end = 0, len(html)
    while place < end:
        m = TAG.search(html, place)
        if m is None:
            add(html[place:])
            break
        add(html[place : m.start()])
        place = m.end()
        if m[2] is None:  # a comment, doctype or processing instruction
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br" or name == "p":
                flush()
            elif name in BLOCK:
                flush()
            if name == "p" or name not in ("br",):
                close(name, frozenset(("article", "main", "body")) if name not in ("article", "main", "body", "html") else frozenset())
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P:
            at = node
            while at.parent is not None and at.name not in CLOSES_P and at.name not in ("td", "th", "li", "body"):
                at = at.parent
            if at.name == "p":
                node = at.parent
        if name in SAME:
            scope, same = SCOPE[name], SAME[name]
            at, last = node, None
            while at.parent is not None and at.name not in scope:
                if at.name in same:
                    last = at
                at = at.parent
            if last is not None:
                node = last.parent
        if name in VOID:
            continue
        if name in RAW:
            ends = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, place)
            place = ends.start() if ends else end
            if ends:
                place = html.find(">", ends.start())
                place = end if place < 0 else place + 1
            continue
        if name in ("html", "body") and node.name != "#root" and name in (node.name, *([] if node.parent is None else [node.parent.name])):
            continue
        node = Node(name, m[3], node)
    flush()
    return out


def named(node: Node, half: float) -> int:
    """Names that speak for boilerplate on a node and above, two at most; subjects say nothing on what holds most of the page."""
    count = 0
    while node is not None and count < 2:
        count += node.bad
        if not node.holds and node.size <= half:
            count += node.subject
        node = node.parent
    return min(count, 2)


def cost_of(block: Block, page_has_article: bool, half: float) -> float:
    """Log-odds that a block is content; positive speaks for content."""
    node, n = block.node, len(block.text)
    if node.bound:
        return -BIND
    density = block.linked / max(1, n)
    words = block.text.count(" ") + 1
    score = -0.3 + 1.1 * math.log1p(words) / 2 - 5.0 * density
    if any(c in block.text for c in ".!?。؟"):
        score += 0.5
    if node.inside:
        score += 6.0
    elif page_has_article:
        score -= OUTSIDE
    score += 1.5 * min(node.good, 2) - NAMED * named(node, half)
    if node.name in HEADING:
        score += 0.8
    if node.name in ("p", "blockquote", "pre"):
        score += 0.8
    return score


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source's (content's) side.

    Node i has capacity scores[i] from the source if positive, else to the sink.
    Dinic's algorithm with explicit stacks; with equal costs a block is content.
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s >= 0:
            edge(source, i, s, 0.0)
        else:
            edge(i, sink, -s, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                    if room[e] <= tiny:
                        cut = k
                        for f in path[k + 1 :]:
                            room[f] -= flow
                            room[f ^ 1] += flow
                        break
                del path[cut:]
                a = to[path[-1]] if path else source
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
            else:
                break
    # What can still reach the sink is boilerplate; everything else is content.
    lost = [False] * (n + 2)
    lost[sink] = True
    queue = [sink]
    for a in queue:
        for e in head[a]:
            if room[e ^ 1] > tiny and not lost[to[e]]:
                lost[to[e]] = True
                queue.append(to[e])
    return [not lost[i] for i in range(n)]


def label(blocks: list[Block]) -> list[bool]:
    if not blocks:
        return []
    total = inside = 0
    for b in blocks:
        if not b.node.bound:
            own, node = len(b.text) - min(b.linked, len(b.text)), b.node
            total += own
            inside += own if node.inside else 0
            while node is not None:
                node.size, node = node.size + own, node.parent
    scores = [cost_of(b, 2 * inside > total, total / 2) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if b.node.bound:
            continue
        if i and not blocks[i - 1].node.bound:
            edges.append((i - 1, i, SMOOTH_NEXT))
        parent = id(b.node.parent)
        if parent in last:
            edges.append((last[parent], i, SMOOTH_PARENT))
        last[parent] = i
    return min_cut(scores, edges)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n\n".join([b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of all pages."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(None if h is None else h.decode("utf-8", "replace")) for h in binaries(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
