"""Main text of web pages by a minimum cut.

A page is cut into blocks of text. A classifier gives each block a cost of being called boilerplate
and a cost of being called content; these are the capacities of its edges from the source and to the
sink. Neighbouring blocks, and successive blocks of one container, are tied by smoothness edges. The
maximum flow separates the two labels at the least total cost.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: A comment, a declaration, or the begin of a tag up to its attributes.
OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: Attributes of a tag in which no quoted value holds a bracket.
PLAIN = re.compile(r"""((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
QUOTE_OR_END = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Elements and names by their part in a page.
RAW = frozenset("script style noscript template textarea svg math iframe object select title".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form fieldset table tbody thead tr td th ul ol dl blockquote figure details menu dialog center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption hr legend summary option".split())
BOILER_TAGS = frozenset("nav footer aside form fieldset menu dialog button".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side widget widgets footer header masthead topbar breadcrumb breadcrumbs "
    "pagination pager cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations "
    "comment comments reply replies respond disqus discussion feedback toolbar toc tags copyright legal search form skip".split()
)
CONTENT_NAMES = frozenset("article content main post entry story body text prose".split())
NAME = re.compile(r"[a-z]+")
NEXT_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
HREF = re.compile(r"(?:^|\s)href\s*=", re.I)

#: Elements whose content is no markup: one that is not closed goes on to the page's end.
TEXT_ONLY = frozenset("script style textarea title".split())
#: A sign of boilerplate by name, or a form, does not hold for a container with this share of the page's text or more.
MOST = 0.5

#: Weights of the classifier, in nats.
IN_CONTENT, IN_BOILER, NAMED_CONTENT = 4.0, 8.0, 1.5
#: Capacities between neighbouring blocks, and between successive blocks of a container.
ADJACENT, SIBLING = 0.6, 0.9


class Tags:
    """The tags of a page in order. Time in proportion to the page, whatever its quotes are."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.dead: set[int] = set()  # places outside of quotes from which no tag's end is met

    def _end(self, at: int) -> int:
        """The place of the bracket that ends the attributes that begin at `at`, -1 if quotes hide all."""
        met = []
        while at not in self.dead and (m := QUOTE_OR_END.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            met.append(at)
            close = self.page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(met, (at,))
        return -1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" for an end tag, name, attributes) of the next tag; a name is empty for what is no element."""
        while at <= self.last or self.page.find("<!--", at) >= 0:
            m = OPEN.search(self.page, at)
            if not m:
                return None
            if not m[2]:
                return m.start(), m.end(), "", "", ""
            if m.end() > self.last:
                at = m.end()
                continue
            if plain := PLAIN.match(self.page, m.end()):
                return m.start(), plain.end(), m[1], m[2], plain[1]
            end = self._end(m.end())
            if end < 0:  # a quote without an end: the tag goes on to the first bracket and counts for nothing
                return m.start(), self.page.find(">", m.end()) + 1, "", "", ""
            return m.start(), end + 1, m[1], m[2], self.page[m.end() : end]
        return None


@dataclass
class Block:
    text: str
    tag: str
    container: int
    boiler: bool
    content: bool
    named: bool
    link: float


def _signs(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether a container is boilerplate, looks like it by name or as a form, is content by its tag, or by its name."""
    boiler, looks, content, named = tag in BOILER_TAGS and tag != "form" or tag == "header", tag == "form", tag in CONTENT_TAGS, False
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                boiler |= value in BOILER_ROLES
                content |= value in ("main", "article")
            elif key in ("class", "id"):
                names = set(NAME.findall(value))
                looks |= bool(names & BOILER_NAMES)
                named |= bool(names & CONTENT_NAMES)
            elif key == "style":
                boiler |= "display:none" in value.replace(" ", "")
            elif key == "aria-hidden":
                boiler |= value == "true"
    if attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
        boiler = True
    return boiler, looks and tag not in ("html", "body"), content, named and not boiler and not looks


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, white space made one space. Unclosed and stray tags are allowed."""
    out: list[Block] = []
    # (tag, number, boilerplate, content, named content)
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    # by the number of a container: what it is in, whether it looks like boilerplate, whether it is an article, its own text
    parent, looks, articles, size = [0], [False], [False], [0]
    home: list[int] = []
    parts: list[str] = []
    tag, links, in_link, number, at = "", 0, False, 0, 0
    closed = True  # whether the open link has an end; else it ends at the next block
    is_open: Counter[str] = Counter()
    unclosed: set[str] = set()  # elements that have no end from here on

    def close() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, n, boiler, content, named = stack[-1]
                home.append(n)
                size[n] += len(text)
                out.append(Block(text, tag, n, boiler, content, named, min(1.0, links / len(text))))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                links += len(raw.strip())

    tags = Tags(page)
    while found := tags.find(at):
        start, end_, ends, name, attributes = found
        add(page[at:start])
        at, name = end_, name.lower()
        if not name:
            continue
        if name in RAW:
            if not ends and not attributes.endswith("/"):
                end = None
                if name not in unclosed:
                    end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in TEXT_ONLY:
                    at = len(page)
                else:
                    unclosed.add(name)
        elif name in BLOCKS:
            close()
            in_link &= closed
            tag = "" if ends else name
            if name in CONTAINERS:
                if not ends:
                    number += 1
                    boiler, look, content, named = _signs(name, attributes)
                    _, inside, was_boiler, was_content, was_named = stack[-1]
                    if name == "header" and was_content:
                        boiler = False  # the head of an article belongs to it
                    parent.append(inside)
                    looks.append(look)
                    articles.append(content)
                    size.append(0)
                    stack.append((name, number, was_boiler or boiler, was_content or content, was_named or named))
                    is_open[name] += 1
                elif is_open[name]:
                    while True:
                        gone = stack.pop()[0]
                        is_open[gone] -= 1
                        if gone == name:
                            break
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not ends and HREF.search(attributes) is not None
            if in_link:
                then = NEXT_LINK.search(page, at)
                closed = then is not None and then[1] == "/"
    add(page[at:])
    close()
    # a container is numbered after what it is in: from the last to the first, texts add up to all that is inside
    most = MOST * sum(size)
    for n in range(number, 0, -1):
        size[parent[n]] += size[n]
    # the longest article of the page is none for what looks like boilerplate around it
    longest = max((n for n in range(1, number + 1) if articles[n] and size[n]), key=lambda n: (size[n], -n), default=0)
    boiler_in = [False] * (number + 1)
    for n in range(1, number + 1):
        boiler_in[n] = (n != longest and boiler_in[parent[n]]) or (looks[n] and size[n] < most)
    for b, n in zip(out, home, strict=True):
        b.boiler |= boiler_in[n]
    return out


def costs(b: Block) -> tuple[float, float]:
    """(cost of calling the block boilerplate, cost of calling it content)."""
    words = b.text.count(" ") + 1
    for_content = min(words, 40) / 16 + (0.5 if b.text[-1] in ".!?:;\"'»”)" else 0.0) + (0.5 if b.tag in ("p", "blockquote", "pre") else 0.0) + (1.0 if b.tag[:1] == "h" and b.tag[1:].isdigit() else 0.0)
    against = 1.2 + 3.0 * b.link
    for_content += IN_CONTENT * b.content + NAMED_CONTENT * b.named
    against += IN_BOILER * b.boiler
    return for_content, against


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays on the source's side of a minimum cut. Dinic's algorithm."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(there)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # the flow straight through the node
        if source[i] > both:
            link(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            link(i, t, sink[i] - both, 0.0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                path.clear()
                x = s
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] < len(out[x]):
                path.append(out[x][turn[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                turn[x] += 1
            else:
                break


def main_text(page: str) -> str:
    """The content blocks of a page, joined by a line break; empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    capacity = [costs(b) for b in found]
    edges = [(i, i + 1, ADJACENT) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if b.container in last:
            edges.append((last[b.container], i, SIBLING))
        last[b.container] = i
    keep = min_cut([c[0] for c in capacity], [c[1] for c in capacity], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars).

    Null html counts as empty. Pages are independent of each other: repeated rows give equal rows, pages may be of any
    length, an empty table gives an empty result. Other columns of pages, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py() or "") for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(page_id, url, page).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
