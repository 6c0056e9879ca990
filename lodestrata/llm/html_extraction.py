"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags.  A linear classifier gives each block the log-odds
of being content, from its length, punctuation, share of link text, and the names and classes of the
elements around it.  Names say nothing on html and body, nor on an element without which the page would have no
prose; replies that follow an article in like elements are told by their form.  These costs are the capacities to the two terminals; smoothness edges join blocks that
follow each other and blocks that are neighbours under one parent, stronger the nearer they are in the
tree.  The minimum cut of that graph labels the blocks: a short paragraph inside an article stays although
it looks like a caption, and a long advert between menus goes.

Blocks whose own cost outweighs all their edges have their label in every minimum cut, so they are fixed
first; what remains is cut by blocking flows, level by level.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, tidy

#: What begins a piece of markup: a comment, a CDATA section, a tag's name, or another declaration.
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|(/?)([A-Za-z][^\s/><]*)|[/!?])", re.I)
#: What may end a tag: a quoted value behind "=" is passed over; a further "<" ends a tag that isn't closed.
_INSIDE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|[<>]")
#: Elements whose content is no markup and is dropped up to the closing tag or the page's end.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "iframe", "textarea", "title")}
_DROPPED = frozenset(("svg", "math", "object", "select"))
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_STOPS = re.compile(r"[.!?;:,。，]")

#: Elements that begin a new block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is content, or isn't, and by how much.
ELEMENTS = {
    "article": 3.0, "main": 2.5, "p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.0, "h2": 0.6, "h3": 0.6, "h4": 0.4, "figcaption": 0.3,
    "nav": -6.0, "footer": -5.0, "aside": -5.0, "header": -2.5, "form": -5.0, "button": -4.0, "label": -3.0, "fieldset": -4.0, "menu": -5.0, "dialog": -5.0, "address": -1.0, "head": -20.0,
}
#: Words in a class, id or role.
NAMES = {
    **dict.fromkeys("article content entry post story body main text prose".split(), 1.0),
    **dict.fromkeys(
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar comment comments disqus respond reply replies related recommended trending tags toc copyright disclaimer legal skip sitemap topbar".split(),
        -5.0,
    ),
    "header": -2.0,
}
#: Words that name what is done somewhere, not what it is; prose outweighs them.
DEEDS = dict.fromkeys("signup login register search results".split(), -2.5)
PAIR = 1.2
SIBLING = 0.8


def tags(page: str, at: int = 0) -> Iterator[tuple[int, int, str, bool, str]]:
    """The page's markup from ``at`` on: start, end, name in lower case (empty for what has none), whether it
    closes, attributes.  Every part of the page is looked at a bounded number of times, whatever is broken in
    it: an unclosed tag ends at the next "<", an unfinished one at the page's end."""
    while m := _OPEN.search(page, at):
        start, name, closing, attributes = m.start(), (m[4] or "").lower(), bool(m[3]), ""
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else "]]>", m.end())
            at = end + 3 if end >= 0 else len(page)
        else:
            end = at = m.end()
            while inner := _INSIDE.search(page, at):
                end = at = inner.end()
                if inner[0] in "<>":
                    end, at = (inner.start(), inner.start() + (inner[0] == ">"))
                    break
            else:
                end = at = len(page)
            attributes = page[m.end() : end]
            if name in _RAW and not closing:
                last = _RAW[name].search(page, at)
                name, at = "", last.end() if last else len(page)
        yield start, at, name, closing, attributes


def _end_of_dropped(page: str, at: int, name: str) -> int:
    """Where an element that begins before ``at`` ends: after its closing tag, or at its parent's."""
    open_: list[str] = [name]
    many = Counter(open_)
    for start, end, inner, closing, attributes in tags(page, at):
        if not inner or inner in VOID or not closing and attributes.endswith("/"):
            continue
        if not closing:
            open_.append(inner)
            many[inner] += 1
        elif many[inner]:
            while True:
                last = open_.pop()
                many[last] -= 1
                if last == inner:
                    break
            if not open_:
                return end
        elif inner in BLOCKS:
            return start
    return len(page)


#: What stands above replies, and in the line that names who replies.
_REPLIES = re.compile(r"^\W*(?:\d+\W+)?(?:comments?|responses?|replies|discussion|thoughts on|join the (?:discussion|conversation)|leave a (?:comment|reply))\b", re.I)
_SAID = re.compile(r"\b(?:says|said|wrote|writes|replied|commented|posted|ago|reply)\b|\b\d{1,2}:\d{2}\b", re.I)
LEAST_PROSE = 300.0  # characters of prose that make an article
OF_REPLIES = -5.0


class Block:
    __slots__ = ("text", "apart", "under", "element", "linked", "prose", "cost")

    def __init__(self, text: str, linked: int, apart: int, under: int, element: int):
        """apart: steps in the tree from the block before; under: the number of the parent's parent; element: of the parent."""
        self.text, self.apart, self.under, self.element, self.cost = text, apart, under, element, 0.0
        n = len(text)
        self.linked = linked / max(n, 1)
        self.prose = min(1.0, n / 150) * min(1.0, len(_STOPS.findall(text)) / 3) * max(0.0, 1 - 3 * self.linked)

    def weigh(self, prior: float, deeds: float, inner: str) -> None:
        n, stops = len(self.text), len(_STOPS.findall(self.text))
        self.cost = prior + deeds * (1 - self.prose) + 0.3 + min(n, 400) / 250 + min(stops, 6) * 0.15 - 4.0 * self.linked
        if n < 25 and not stops and inner not in ("h1", "h2", "h3", "p"):
            self.cost -= 0.8


class _Element(NamedTuple):
    name: str
    parent: int
    own: float
    deeds: float
    hidden: bool
    kind: str  # the name with the classes, without digits


def _unsuspected(blocks: list[Block], elements: list[_Element]) -> set[int]:
    """Elements whose bad names are not believed.

    Of the elements with bad names that hold most of the page's prose, from the outermost on, as many as it
    takes until there is an article's worth of prose under none.
    """
    mass = [0.0] * len(elements)
    for b in blocks:
        mass[b.element] += b.prose * len(b.text)
    for i in range(len(elements) - 1, 0, -1):
        mass[elements[i].parent] += mass[i]
    total = mass[0]
    if total < LEAST_PROSE:
        return set()
    chain = [i for i, e in enumerate(elements) if e.own < 0 and mass[i] > total / 2]  # each lies in the one before
    if not chain:
        return set()
    inside, other = [0] * len(elements), [0] * len(elements)
    member = set(chain)
    for i, e in enumerate(elements[1:], 1):
        inside[i] = inside[e.parent] + (i in member)
        other[i] = other[e.parent] + (e.own < 0 and i not in member)
    clean = [0.0] * (len(chain) + 1)
    for b in blocks:
        if not other[b.element]:
            clean[inside[b.element]] += b.prose * len(b.text)
    found = clean[0]
    for n in range(len(chain) + 1):
        if found >= min(LEAST_PROSE, total / 4):
            return set(chain[:n])
        found += clean[n + 1] if n < len(chain) else 0.0
    return set(chain)


def _replies(blocks: list[Block], elements: list[_Element]) -> set[int]:
    """Elements that hold replies: like ones under one parent, below a line that announces replies, or three or
    more that each have a line saying who wrote when."""
    heads: dict[int, int] = {}  # the first announcement under an element, by block
    named: set[int] = set()
    texts = [0] * len(elements)
    last = [-1] * len(elements)
    for k, b in enumerate(blocks):
        short = len(b.text) <= 80
        if short and _REPLIES.search(b.text):
            heads.setdefault(elements[b.element].parent, k)
            heads.setdefault(b.element, k)
        said = short and elements[b.element].name not in ("h1", "h2", "h3", "h4") and _SAID.search(b.text)
        at = b.element
        for _ in range(6):  # a reply's lines lie a few elements below it
            texts[at] += 1
            last[at] = k
            if said:
                named.add(at)
            if not at:
                break
            at = elements[at].parent
    like: dict[tuple[int, str], list[int]] = {}
    for i, e in enumerate(elements[1:], 1):
        if texts[i]:
            like.setdefault((e.parent, e.kind), []).append(i)
    found: set[int] = set()
    for (parent, _), group in like.items():
        head = heads.get(parent, heads.get(elements[parent].parent, len(blocks)))
        below = [i for i in group if last[i] > head and texts[i] >= 2]
        if len(below) >= 2 and any(i in named for i in below):
            found.update(below)
        signed = [i for i in group if i in named and texts[i] >= 2]
        if len(signed) >= 3 and len(signed) == len(group):
            found.update(signed)
    return found


def _weigh(blocks: list[Block], elements: list[_Element]) -> None:
    """Each block's cost, from its text and from the elements around it."""
    trusted, replies = _unsuspected(blocks, elements), _replies(blocks, elements)
    priors, deeds = [0.0] * len(elements), [0.0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        above, own = priors[e.parent], max(e.own, 0.0) if i in trusted else e.own
        if i in replies:
            own = min(own, OF_REPLIES)
        priors[i] = max(-8.0, min(5.0, above + own)) if own >= 0 or above >= 0 else max(-8.0, min(above, own))
        deeds[i] = max(-8.0, deeds[e.parent] + (0.0 if i in trusted else e.deeds))
    for b in blocks:
        b.weigh(priors[b.element], deeds[b.element], elements[b.element].name)
    if len(blocks) == 1 and priors[blocks[0].element] >= 0 and blocks[0].linked < 0.5:
        blocks[0].cost = max(blocks[0].cost, 0.0)  # all that the page says


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    found: list[Block] = []
    elements = [_Element("", 0, 0.0, 0.0, False, "")]
    stack = [0]
    many: Counter[str] = Counter()
    links = 0
    parts: list[str] = []
    linked: list[str] = []
    depth, low = 0, 0  # of the last block, and the least one since

    def flush() -> None:
        nonlocal depth, low
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and not elements[stack[-1]].hidden:
                length = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()) if linked else 0
                low = min(low, len(stack))
                found.append(Block(text, length, depth + len(stack) - 2 * low, stack[-2] if len(stack) > 1 else 0, stack[-1]))
                depth = low = len(stack)
            parts.clear()
            linked.clear()

    def leave() -> str:
        nonlocal low
        name = elements[stack.pop()].name
        many[name] -= 1
        low = min(low, len(stack))
        return name

    def add(text: str) -> None:
        parts.append(text)
        if links:
            linked.append(text)

    at = 0
    for start, end, name, closing, attributes in tags(page):
        if start < at:
            continue
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        if name in _DROPPED:
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")):
                at = _end_of_dropped(page, at, name)
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if name == "br":
            add(" ")
            continue
        if name not in BLOCKS:
            if not closing and name not in VOID and name in ELEMENTS:
                flush()
            elif closing or name not in ELEMENTS:
                continue
        flush()
        if closing:
            if many[name]:  # so the walk up ends
                items = ("p", "li", "dd", "dt")
                up = len(stack) - 1
                while (at_up := elements[stack[up]].name) != name and (name not in items or at_up in (*items, "button", "label")):
                    up -= 1
                if at_up == name:
                    while len(stack) > up:
                        leave()
            continue
        links = 0
        if name in VOID:
            continue
        inner = elements[stack[-1]].name
        if inner == "p" or name in ("li", "dd", "dt") and inner == name:
            leave()
        prior, deeds = ELEMENTS.get(name, 0.0), 0.0
        if name == "header" and (many["article"] or many["main"]):
            prior = 0.0
        kind = name
        if attributes and name not in ("html", "body"):
            for value in _ATTRIBUTE.findall(attributes):
                for word in _WORD.findall(value.lower()):
                    prior += NAMES.get(word, 0.0)
                    deeds += DEEDS.get(word, 0.0)
            kind += " ".join(_WORD.findall(" ".join(_CLASS.findall(attributes)).lower()))
        hidden = elements[stack[-1]].hidden or bool(attributes and _HIDDEN.search(attributes))
        elements.append(_Element(name, stack[-1], prior, deeds, hidden, kind))
        stack.append(len(elements) - 1)
        many[name] += 1
    if at < len(page):
        add(page[at:])
    flush()
    _weigh(found, elements)
    return found


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow each other and between neighbours under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = PAIR / (1 + b.apart)
        if b.under in last:
            key = (last[b.under], i)
            edges[key] = edges.get(key, 0.0) + SIBLING
        last[b.under] = i
    return edges


def _levels(rest: list[int], room: dict[int, dict[int, float]], supply: dict[int, float]) -> dict[int, int]:
    """Steps from the nearest supply, as far as the nearest demand; empty where none can be reached."""
    now = [i for i in rest if supply[i] > 1e-9]
    level = dict.fromkeys(now, 0)
    while now:
        after = []
        for i in now:
            for j, w in room[i].items():
                if w > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    after.append(j)
        if any(supply[j] < -1e-9 for j in after):
            return level
        now = after
    return {}


def _blocking_flow(room: dict[int, dict[int, float]], supply: dict[int, float], level: dict[int, int]) -> None:
    """Send along paths of increasing level until each of them is full."""
    ways = {i: iter(list(room[i])) for i in level}
    step: dict[int, int | None] = {}  # the way that is being tried from a block
    for first in [i for i, k in level.items() if k == 0]:
        path = [first]
        while path and supply[first] > 1e-9:
            i = path[-1]
            if supply[i] < -1e-9:
                flow = min([supply[first], -supply[i], *(room[a][b] for a, b in zip(path[:-1], path[1:], strict=True))])
                supply[first] -= flow
                supply[i] += flow
                full = 0
                for k in range(len(path) - 1, 0, -1):
                    a, b = path[k - 1], path[k]
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if room[a][b] <= 1e-9:
                        full = k
                del path[full or len(path) :]
                continue
            j = step.get(i)
            if j is None or room[i].get(j, 0.0) <= 1e-9 or level.get(j) != level[i] + 1:
                j = next((x for x in ways[i] if room[i][x] > 1e-9 and level.get(x) == level[i] + 1), None)
                step[i] = j
            if j is None:
                level[i] = -1
                path.pop()
            else:
                path.append(j)


def minimum_cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the costs of wrong labels and of cut edges; True where content.

    A label True costs max(0, -cost) and False max(0, cost); ties are content.
    """
    n = len(costs)
    costs = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(costs[i]) < sum(near[i].values()):
            continue
        label[i] = costs[i] >= 0
        for j, w in near[i].items():
            del near[j][i]
            if label[j] is None:
                costs[j] += w if label[i] else -w
                todo.append(j)
        near[i] = {}
    if None not in label:
        return label  # type: ignore[return-value]
    # What is left is cut by blocking flows from content terminals (cost > 0) to the others.
    rest = [i for i in range(n) if label[i] is None]
    room = {i: dict(near[i]) for i in rest}
    supply = {i: costs[i] for i in rest}
    while level := _levels(rest, room, supply):
        _blocking_flow(room, supply, level)
    # Content: all from which no terminal of the other side can be reached.
    other = {i for i in rest if supply[i] < -1e-9}
    queue = deque(other)
    while queue:
        j = queue.popleft()
        for i in room[j]:
            if i not in other and room[i].get(j, 0.0) > 1e-9:
                other.add(i)
                queue.append(i)
    for i in rest:
        label[i] = i not in other
    return label  # type: ignore[return-value]


def main_text(page: str | None) -> str:
    """Blocks labelled content, joined with line feeds; empty for null, empty and wordless pages."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    labels = minimum_cut([b.cost for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of the markup.

    Null and empty pages have an empty text; repeated rows are each done; an empty table gives an empty
    one; other columns stay, and those called like a result are replaced.
    """
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                piece = batch.slice(a, 500)
                texts = [main_text(x) for x in piece.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    bound_batches(pages.sparkSession)
    return pages.select(*kept, F.col(column)).mapInArrow(tidy(run), schema)
