"""HTML extraction by minimum-cut labelling (operator 10).

A page becomes a sequence of blocks (text between block-level boundaries, in
page order). A linear classifier turns each block's place and shape (``code``)
into a cost for either label; the costs are the capacities to the two terminals
of a graph. Blocks that follow each other are joined by smoothness edges, the
weaker the further apart they stand in the document tree, and so are blocks with
the same parent element; edges between regions of different kind are weak. The
minimum cut parts content from boilerplate: the cheapest labelling of all blocks
together. Before max-flow runs, blocks whose own cost outweighs all their edges
are fixed and folded into their neighbours, which changes nothing in the result
and leaves few nodes.

The classifier is fitted on the pages at hand (``fit``): in a sample of about
``SAMPLE`` pages that mark an article, blocks in the article and in no region of
other kind are content, the rest is boilerplate. Each page is shown twice, with
its marks and without them, so shape is learned where no mark tells. Weights have
a normal prior around ``PRIOR`` and the sample counts as ``ROWS`` rows, so marks
and regions that the sample lacks keep their prior weight and none grows past
what smoothness can overrule. A fifth of the pages (crc32 of the url) is held out
of the fit.

Scripts, styles, comments and other text that is not shown never become blocks.
Character references are decoded, white space inside a block becomes one blank
(``br`` counts as white space), and kept blocks are joined by one line feed.

Null and empty pages give the empty string. Unclosed, stray and nested tags are
handled as browsers do where it matters here (a block closes an open ``p``, an
item closes the item before it, raw text ends at its end tag only). Repeated
rows are extracted alike; nothing is cut off, whatever a page's length. Without a
page that marks an article the weights are the prior ones. Columns named ``text``
and ``n_chars`` can't be kept, as the result has its own.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm._store import ship

#: Element names of HTML by kind.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe svg annotation annotation-xml template".split())
#: Elements that close an open one of the same kind, up to the listed scope.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Elements, roles and words of class or id that mark what is not the article.
OTHER_TAGS = frozenset("nav footer aside form button select menu dialog fieldset search noscript".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar side aside ad ads adv advert advertisement advertising adbox sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search "
    "comment comments respond reply replies disqus discussion share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar "
    "skip widget copyright legal disclaimer".split()
)
MAIN_WORDS = frozenset("article content post entry story main".split())
#: Marks that an article inside them doesn't weaken.
FIRM_WORDS = frozenset("comment comments respond reply replies disqus discussion".split())
HEAD_WORDS = frozenset("header masthead banner".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
NAME_PARTS = re.compile(r"[^a-z0-9]+")

#: Most words that tell blocks apart, and their steps.
STEPS, WORDS_MAX = (1, 2, 4, 8, 16, 32), 40
PARAGRAPHS, HEADINGS = frozenset(("p", "blockquote", "pre", "h1")), frozenset(("h2", "h3", "h4", "h5", "h6"))
STOPS = (".", "!", "?", "\u2026", "\u3002", ":", ";")
#: Features of a block and their prior weights (log-odds of content). ``marked`` to ``outer`` speak of regions, the rest of shape.
PRIOR = {
    "marked": 4.0, "outside": -1.0, "unmarked": 0.5, "other": -9.0, "outer": -4.9,
    "words": 2.0, "paragraph": 0.8, "heading": 0.0, "item": 0.0, "links": -3.0, "links inside": 0.0, "stop": 0.0,
}
#: Pages that the classifier is fitted on, what they weigh together in rows, and the prior's deviation.
SAMPLE, ROWS, DEVIATION = 1_000, 60.0, 1.0
FOLDS = 5
#: Smoothness between neighbours in the page (halved for every two steps apart in the tree beyond two) and between blocks of one parent.
FOLLOWS, SAME_PARENT, ACROSS_REGIONS = 1.0, 0.75, 0.2
SCALE = 1000

Code = tuple[int, ...]


class _Open:
    """An open element with what its blocks inherit."""

    __slots__ = ("article", "firm", "link", "other", "outer", "tag")

    def __init__(self, tag: str, article: bool, other: int, link: bool, firm: int = 0, outer: bool = False):
        self.tag, self.article, self.other, self.link, self.firm, self.outer = tag, article, other, link, firm, outer


class Block:
    __slots__ = ("apart", "article", "linked", "other", "outer", "parent", "size", "tag", "text")

    def __init__(self, text: str, tag: str, parent: int, article: bool, other: int, linked: int, outer: bool = False, apart: int = 2):
        self.text, self.tag, self.parent, self.article, self.other, self.linked, self.outer, self.apart = text, tag, parent, article, other, linked, outer, apart
        self.size = text.count(" ") + 1


def _child(above: _Open, tag: str, attributes: str) -> _Open:
    article, other, firm, outer = above.article, above.other, above.firm, above.outer
    if tag in ("article", "main"):
        article = True
    elif tag in OTHER_TAGS or (tag == "header" and not article):
        other += 1
    if attributes and tag not in ("html", "body") and not attributes.isspace():
        names, role = "", ""
        for m in ATTRIBUTE.finditer(attributes):
            name = m[1].lower()
            value = (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                names += " " + value
            elif name == "role":
                role = value.strip()
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                other += 1
                firm += 1
        if role in OTHER_ROLES and not (article and role == "banner"):
            other += 1
        if role in ("main", "article"):
            article = True
        if names:
            parts = set(NAME_PARTS.split(names))
            marked = parts & OTHER_WORDS
            if article or parts & MAIN_WORDS:
                marked -= HEAD_WORDS
            if marked and tag not in ("article", "main") or marked & {"comment", "reply"}:
                other += 1
                firm += bool(marked & FIRM_WORDS)
            elif not marked and parts & MAIN_WORDS and tag in ("div", "section", "td"):
                article = True
    if article and not above.article:  # regions around the article are only a hint
        outer = above.other > above.firm
        other -= above.other - above.firm
    return _Open(tag, article, other, above.link or tag == "a", firm, outer)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    parents = [0]
    made = 0
    pieces: list[str] = []
    linked = 0
    depth, shared = 1, 1  # of the last block, and of what it shares with where we are

    def flush() -> None:
        nonlocal linked, depth, shared
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in BLOCKS or k == 0), 0)
                near = stack[top]
                shared = min(shared, top + 1)
                out.append(Block(text, near.tag, parents[max(0, top - 1)], near.article, near.other, min(linked, len(text)), near.outer, depth + top + 1 - 2 * shared))
                depth = shared = top + 1
            pieces.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal shared
        shared = min(shared, k)
        del stack[k:], parents[k:]

    at, lower = 0, ""
    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text = unescape(piece) if "&" in piece else piece
            pieces.append(text)
            if stack[-1].link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        flush()
                        pop_to(k)
                        break
                else:
                    flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            continue
        attributes = m[3] if m[3] is not None else m[4]
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            if not attributes.endswith("/"):
                lower = lower or page.lower()
                # A few characters change length in lower case; only then search the slow way.
                end = lower.find(f"</{tag}", at) if len(lower) == len(page) else (lambda e: e.start() if e else -1)(re.compile(f"</{tag}", re.I).search(page, at))
                at = len(page) if end < 0 else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCKS and stack[k].tag != "p":
                    break
            if tag in SIBLINGS:
                same, scope = SIBLINGS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in same:
                        pop_to(k)
                        if tag != "tr":
                            break
                    elif stack[k].tag in scope:
                        break
        if not attributes.endswith("/"):
            made += 1
            stack.append(_child(stack[-1], tag, attributes))
            parents.append(made)
    flush()
    return out


def code(block: Block, marks: bool, shown: bool = True) -> Code:
    """What the classifier sees of a block on a page that does or doesn't mark an article; few values each. ``shown``: marks are."""
    words = sum(block.size >= s for s in STEPS)
    links = min(3, -(-2 * block.linked // len(block.text))) if block.linked else 0
    place = 0 if not (marks and shown) else 1 if block.article else 2
    kind = 1 if block.tag in PARAGRAPHS else 2 if block.tag in HEADINGS else 3 if block.tag in ("li", "td", "th", "dd", "dt") else 0
    return place, min(block.other, 2), int(block.outer and shown), words, kind, links, int(block.text.endswith(STOPS))


def features(c: Code) -> list[float]:
    """The feature row of a code, in the order of ``PRIOR``."""
    place, other, outer, words, kind, links, stop = c
    size = min((*STEPS, 2 * STEPS[-1])[words - 1] * 1.25, WORDS_MAX) / WORDS_MAX if words else 0.0
    return [place == 1, place == 2, place == 0, other, outer, size, kind == 1, kind == 2, kind == 3, (place != 1) * links / 2, (place == 1) * links / 2, stop]


class Model:
    """Scores of codes: log-odds that a block is content."""

    def __init__(self, weights: list[float] | None = None):
        self.weights = list(PRIOR.values()) if weights is None else weights
        self._known: dict[Code, float] = {}

    def score(self, c: Code) -> float:
        found = self._known.get(c)
        if found is None:
            found = self._known[c] = float(sum(w * x for w, x in zip(self.weights, features(c), strict=True)))
        return found

    def __reduce__(self):
        return Model, (self.weights,)


def examples(page: str | None) -> list[tuple[Code, bool]]:
    """(code, is content) of every block of a page that marks an article, with its marks shown and hidden; none without marks."""
    found = blocks(page or "")
    if not any(b.article for b in found):
        return []
    return [(code(b, True, shown), b.article and not b.other and not b.outer) for shown in (True, False) for b in found]


def fit_weights(counts: dict[tuple[Code, bool], int], rows: float = ROWS, deviation: float = DEVIATION) -> list[float]:
    """Weights of greatest posterior: logistic likelihood of the counted examples, scaled to ``rows`` rows, by Newton steps."""
    prior = np.array(list(PRIOR.values()))
    if not counts:
        return prior.tolist()
    keys = sorted(counts)
    x = np.array([features(c) for c, _ in keys], np.float64)
    y = np.array([label for _, label in keys], np.float64)
    n = np.array([counts[k] for k in keys], np.float64)
    n *= rows / n.sum()
    w = prior.copy()
    loss = lambda v: n @ (np.logaddexp(0, x @ v) - y * (x @ v)) + ((v - prior) ** 2).sum() / (2 * deviation**2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (w - prior) / deviation**2
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / deviation**2, gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return w.round(9).tolist()


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness by pair of blocks: neighbours in the page, and the next block with the same parent."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        for j, weight in ((k - 1, FOLLOWS * 0.5 ** (max(0, block.apart - 2) / 2)), (last.get(block.parent, -1), SAME_PARENT)):
            if j >= 0:
                alike = (found[j].other > 0) == (block.other > 0) and found[j].article == block.article and found[j].outer == block.outer
                out[j, k] = out.get((j, k), 0.0) + (weight if alike else weight * ACROSS_REGIONS)
        last[block.parent] = k
    return out


def minimum_cut(scores: list[float], joined: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (True: content) of least cost: scores against the label plus edges cut."""
    own = [round(s * SCALE) for s in scores]
    near: list[dict[int, int]] = [{} for _ in own]
    for (a, b), w in joined.items():
        c = round(w * SCALE)
        if c > 0 and a != b:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    label: list[bool | None] = [None] * len(own)
    todo = deque(range(len(own)))
    while todo:
        k = todo.popleft()
        if label[k] is None and abs(own[k]) >= sum(near[k].values()):
            label[k] = own[k] > 0
            for j, c in near[k].items():
                own[j] += c if label[k] else -c
                del near[j][k]
                todo.append(j)
            near[k].clear()
    open_ = [k for k, v in enumerate(label) if v is None]
    if open_:
        content = _source_side(own, near, open_)
        for k in open_:
            label[k] = k in content
    return [bool(v) for v in label]


def _source_side(own: list[int], near: list[dict[int, int]], nodes: list[int]) -> set[int]:
    """Nodes on the content terminal's side of a minimum cut, by shortest augmenting paths."""
    left = {k: dict(near[k]) for k in nodes}
    supply = {k: max(0, own[k]) for k in nodes}
    drain = {k: max(0, -own[k]) for k in nodes}
    while True:
        before: dict[int, int | None] = {k: None for k in nodes if supply[k]}
        todo = deque(before)
        end = None
        while todo:
            k = todo.popleft()
            if drain[k]:
                end = k
                break
            for j, c in left[k].items():
                if c and j not in before:
                    before[j] = k
                    todo.append(j)
        if end is None:
            return set(before)
        path = [end]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        flow = min([supply[path[-1]], drain[end], *(left[a][b] for b, a in zip(path, path[1:], strict=False))])
        supply[path[-1]] -= flow
        drain[end] -= flow
        for b, a in zip(path, path[1:], strict=False):
            left[a][b] -= flow
            left[b][a] = left[b].get(a, 0) + flow


def extract(page: str | None, model: Model | None = None) -> str:
    """The main text of one page."""
    found = blocks(page or "")
    model = model or Model()
    marks = any(b.article for b in found)
    kept = minimum_cut([model.score(code(b, marks)) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def fit(pages: DataFrame, html: str = "html", url: str = "url", sample: int = SAMPLE) -> Model:
    """The block classifier of a table of pages, from about ``sample`` pages that aren't held out.

    What comes back is counts by code and label: a few thousand rows whatever the pages hold.
    """
    ship(pages.sparkSession)
    kept = pages.where((F.crc32(F.coalesce(F.col(url).cast("string"), F.lit("")).cast("binary")) % FOLDS != 0) & F.col(html).isNotNull())
    total = pages.count()
    cut = 1 << 30 if total <= sample else int(sample / total * (1 << 30))
    width = len(code(Block("x", "p", 0, False, 0, 0), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[Code, bool], int] = {}
        for batch in batches:
            for page in batch.column(0).to_pylist():
                for key in examples(page):
                    counts[key] = counts.get(key, 0) + 1
        codes = [list(map(int, c)) for c, _ in counts]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.list_(pa.int32())), pa.array([y for _, y in counts], pa.bool_()), pa.array(counts.values(), pa.int64())], names=["code", "label", "n"])

    drawn = kept.where(F.pmod(F.xxhash64(F.col(html)), F.lit(1 << 30)) < cut).select(html)
    found = drawn.mapInArrow(run, "code array<int>, label boolean, n bigint").groupBy("code", "label").agg(F.sum("n").alias("n")).collect()
    return Model(fit_weights({(tuple(r.code), r.label): r.n for r in found if len(r.code) == width}))


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every page. The classifier is fitted on the pages unless given."""
    if clash := {"text", "n_chars"} & set(keep):
        raise ValueError(f"the result has its own {sorted(clash)}")
    ship(pages.sparkSession)
    url = "url" if "url" in pages.columns else keep[0]
    model = model or fit(pages, html, url)
    schema = T.StructType(pages.select(*keep).schema.fields).add("text", T.StringType()).add("n_chars", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [extract(h, model) for h in some.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*keep, html).mapInArrow(run, schema)
