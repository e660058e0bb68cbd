"""HTML extraction by minimum-cut labelling.

A page is cut into text blocks. A classifier turns what is known of each block alone, its elements, class names, links,
length and form, into log odds of being content; they are the capacities of its edge from the source or to the sink. Blocks that
follow each other, and successive blocks of one parent, are tied by smoothness edges, the stronger the nearer they
are in the tree of elements. The minimum cut, by maximum flow, labels the blocks: content is what stays with the source. So a
short line among paragraphs stays, and a wordy notice among links goes. The weights were fitted on pages of known articles
(html_training.py).

Before the flow, blocks whose terminal outweighs all their edges take its side (such a block is on that side of
every minimum cut) and pass their edges on as capacities; the flow runs on each connected run of the rest.

A null or empty html gives an empty text. Every row gives one row; extra columns are ignored, repeated rows stay. Broken markup never
fails: unclosed elements end with their parents, stray end tags and the rest of an unclosed tag are dropped. An empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element names.
SKIPPED = frozenset("script style title noscript template textarea svg math iframe object canvas audio video select head".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark boilerplate or content.
BOILER_WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|alert|banner|breadcrumb|breadcrumbs|byline|comment|comments|complementary|consent|contentinfo|cookie|cookies|copyright|"
    "disclaimer|disqus|footer|form|gdpr|header|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|promo|"
    "promoted|promotion|related|replies|reply|search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|teaser|toolbar|topbar|widget|widgets"
)
CONTENT_WORDS = "article|content|entry|main|post|story"
BOILER_ELEMENTS = frozenset("nav aside footer form menu dialog button search fieldset header".split())
#: What the classifier knows of a block, and the log odds of content that each tells; fitted by html_training.fit.
WEIGHTS = {
    "always": 0.76,
    "bare": 2.82,
    "in_article": 5.06,
    "boiler_element": -7.49,
    "boiler_name": -9.47,
    "content_name": 5.04,
    "paragraph": 2.01,
    "title": 4.28,
    "heading": -0.35,
    "item": -0.25,
    "length": 0.94,
    "short": -1.18,
    "links": -3.32,
    "copyright": -6.45,
}
FEATURES = list(WEIGHTS)
#: Log odds of a block that is not shown.
HIDDEN = -50.0
#: Capacity between blocks that follow each other, and between successive blocks of one parent; shared by steps in the tree.
NEIGHBOUR, SIBLING = 3.0, 0.5
#: Share of the capacity that is left with each step up the tree.
DECAY = 0.5
#: Elements around a block that its place in the tree is told by.
DEPTH = 24

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_BOILER = re.compile(rf"(?<![a-z])(?:{BOILER_WORDS})(?![a-z])")
_CONTENT = re.compile(rf"(?<![a-z])(?:{CONTENT_WORDS})(?![a-z])")


@dataclass(slots=True)
class Place:
    """An open element: what it and those around it say."""

    name: str = ""
    path: tuple[int, ...] = ()
    linked: bool = False
    article: bool = False
    boiler: bool = False
    boiler_name: bool = False
    content_name: bool = False
    hidden: bool = False


@dataclass(slots=True)
class Block:
    place: Place
    element: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def told(text: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes speak of boilerplate, of content, of being hidden."""
    boiler = content = hidden = False
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), "".join(values).lower()
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value == "true"
        else:
            boiler |= bool(_BOILER.search(value))
            content |= bool(_CONTENT.search(value))
    return boiler, content and not boiler, hidden


def inside(around: Place, name: str, attributes: str, serial: int) -> Place:
    """The place in an element that opens there."""
    main = name in ("article", "main")
    # a header in an article holds its title
    heads = name == "header" and around.article
    boiler, content, hidden = told(attributes) if attributes and name not in ("html", "body") else (False, False, False)
    return Place(
        name,
        (*around.path[-DEPTH:], serial),
        around.linked or name == "a",
        around.article or main,
        around.boiler or name in BOILER_ELEMENTS and not heads,
        around.boiler_name or boiler and not heads and not main,
        around.content_name or content,
        around.hidden or hidden,
    )


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    stack = [Place()]
    held: Counter[str] = Counter()  # names in the stack, so that a stray end tag costs no search
    out: list[Block] = []
    block: Block | None = None
    serial = skip = at = 0

    def close(depth: int) -> None:
        held.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    def flush() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                block.parts = []
                out.append(block)
            block = None

    def say(raw: str) -> None:
        nonlocal block
        if skip or not raw:
            return
        if block is None:
            if raw.isspace():
                return
            depth = len(stack) - 1
            while depth and stack[depth].name not in BLOCK:
                depth -= 1
            block = Block(stack[-1], stack[depth].name)
        block.parts.append(raw)
        if stack[-1].linked:
            block.linked += len(raw)

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            if held[name]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
                skip = sum(held[x] for x in SKIPPED) if skip else 0
            continue
        if name == "br" or name == "wbr":
            say(" " if name == "br" else "")
            continue
        attributes = m[3] if m[3] is not None else m[6] or ""
        if name in BLOCK:
            flush()
            closes = CLOSED_BY.get(name, set()) | {"p"}
            if any(held[x] for x in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in closes:
                        close(k)
                        break
                    if stack[k].name in BLOCK and stack[k].name != "p":
                        break
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "body":
            close(1)
            skip = 0
        serial += 1
        if name in RAW:
            end = re.compile(rf"</{name}(?![\w-])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(inside(stack[-1], name, attributes, serial))
        held[name] += 1
        skip += name in SKIPPED
    say(page[at:])
    flush()
    return out


def features(block: Block) -> list[float]:
    """Values of FEATURES."""
    p, text = block.place, block.text
    n = text.count(" ") + 1
    return [
        1.0,
        block.element in ("", "html", "body"),
        p.article,
        p.boiler,
        p.boiler_name,
        p.content_name,
        block.element in ("p", "blockquote", "pre"),
        block.element == "h1",
        block.element in ("h2", "h3", "h4", "h5", "h6"),
        block.element in ("li", "dd", "dt", "label", "legend", "option"),
        min(n, 60) / 20,
        n < 4,
        min(1.0, block.linked / len(text)),
        text[0] == "©",
    ]


def cost(block: Block) -> float:
    """Log odds of content."""
    if block.place.hidden:
        return HIDDEN
    return sum(w * x for w, x in zip(WEIGHTS.values(), features(block), strict=True))


def minimum_cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels x that minimise the costs of the terminals cut and of the edges between unlike labels; True: source.

    A positive cost is the capacity from the source, a negative one to the sink. Of several minimum cuts, the one
    with the largest source side.
    """
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    rest = list(costs)
    tied = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and (rest[i] >= tied[i] or rest[i] < -tied[i]):
            label[i] = rest[i] >= tied[i]
            for j, w in near[i].items():
                if label[j] is None:
                    rest[j] += w if label[i] else -w
                    tied[j] -= w
                    queue.append(j)
    seen: set[int] = set()
    for i in range(n):
        if label[i] is None and i not in seen:
            run, queue = [i], deque([i])
            seen.add(i)
            while queue:
                for j in near[queue.popleft()]:
                    if label[j] is None and j not in seen:
                        seen.add(j)
                        run.append(j)
                        queue.append(j)
            sides = flow(run, rest, near)
            for j in run:
                label[j] = sides[j]
    return [bool(x) for x in label]


def flow(run: list[int], rest: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """Labels of the blocks of a run by maximum flow in phases of shortest paths; False for what still reaches the sink."""
    member = set(run)
    residual = {i: {j: w for j, w in near[i].items() if j in member} for i in run}
    source = {i: max(rest[i], 0.0) for i in run}
    sink = {i: max(-rest[i], 0.0) for i in run}
    tiny = 1e-9
    while True:
        # steps to the nearest block that can still pass flow on to the sink
        steps = {i: 0 for i in run if sink[i] > tiny}
        queue = deque(steps)
        while queue:
            i = queue.popleft()
            for j in residual[i]:
                if j not in steps and residual[j].get(i, 0.0) > tiny:
                    steps[j] = steps[i] + 1
                    queue.append(j)
        starts = [i for i in run if source[i] > tiny and i in steps]
        if not starts:
            return {i: i not in steps for i in run}
        ways = {i: iter(tuple(residual[i])) for i in run}
        for start in starts:
            path = [start]
            while path:
                i = path[-1]
                if sink[i] > tiny:
                    push = min([sink[i], source[start], *(residual[a][b] for a, b in zip(path, path[1:], strict=False))])
                    sink[i] -= push
                    source[start] -= push
                    for a, b in zip(path, path[1:], strict=False):
                        residual[a][b] -= push
                        residual[b][a] = residual[b].get(a, 0.0) + push
                    if source[start] <= tiny:
                        break
                    # back to before the first edge that is used up
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if residual[a][b] <= tiny), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                step = next((j for j in ways[i] if residual[i][j] > tiny and j in steps and steps[j] == steps[i] - 1), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow each other, the weaker the farther apart in the tree, and between those of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(blocks):
        path = block.place.path
        if i:
            before = blocks[i - 1].place.path
            common = next((k for k, (a, b) in enumerate(zip(before, path, strict=False)) if a != b), min(len(before), len(path)))
            edges[i - 1, i] = NEIGHBOUR * DECAY ** (max(len(before), len(path)) - common - 1)
        around = path[:-1]
        if around in last:
            edges[last[around], i] = edges.get((last[around], i), 0.0) + SIBLING
        last[around] = i
    return edges


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    labels = minimum_cut([cost(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
