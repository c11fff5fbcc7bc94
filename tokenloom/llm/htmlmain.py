"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic model of each block (words, share of link words, marks of a sentence, kind
of element) says how likely it is content; with what the elements around it say (article, navigation, names of classes)
this makes what it costs to call it content or boilerplate: the capacities from the source and to the sink. Neighbouring
blocks are joined by edges that get weaker with their distance in the document tree, and neighbouring siblings by further
edges, so that a cut between them costs too. The minimum cut separates content from boilerplate; the maximum flow is
found by blocking flows on level graphs.

The model is fitted (`fit`) on at most FIT_PAGES pages that have an article element, FIT_BLOCKS blocks of each: those
inside that nothing marks as boilerplate are content. Where there are none, fixed weights take its place.

An element that is boilerplate by its tag or name hands that down, unless it holds the page's main article (its largest
article or main element that is not a comment) or, without one, WHOLE of the page's words: then it is a wrapper. A form
that holds most of the article is one too. Comments are never wrappers.

White space within a block becomes one space; blocks are joined by an empty line. Null and empty pages give an empty
text. Unclosed elements, truncated tags and references are read as far as they go. Repeated rows give equal texts. Pages
of any length are read whole, in time linear in length and depth; extra columns do not matter, and an empty table gives an
empty result. Labels and buttons within a sentence are its words, elsewhere they are controls. An article much shorter than the
main one is a teaser.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math object iframe canvas audio video select textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label".split()
)
CLOSES_P = BLOCK - {"button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
#: Controls that are words of a sentence where they stand in one.
CONTROLS = frozenset(("button", "label"))
#: Elements that the next one of their kind ends, unless a list or table has begun between.
ENDS_ITSELF = frozenset("li dt dd tr td th option a".split())
LISTS = ("ul", "ol", "dl", "table")
OUTSIDE = frozenset("nav footer aside form button dialog menu label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
NEGATIVE = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "cookie cookies consent gdpr footer foot header masthead menu nav navbar navigation pager pagination newsletter "
    "popup modal overlay related recommended recommendations share sharing social sidebar rail skip subscribe subscription paywall widget "
    "notice notification disclaimer login signin signup search toolbar tagcloud tags trending outbrain taboola".split()
)
#: Of these, the ones that an article's own parts may have in their names too.
AMBIGUOUS = frozenset("header masthead banner tags trending rail search toolbar".split())
POSITIVE = frozenset("article story post entry content main body text prose".split())
#: Before a word of NEGATIVE they say that the page has or lacks such a thing elsewhere.
MODIFIERS = frozenset("has no with without not hide".split())
#: Behind a word of NEGATIVE they leave its meaning; any other word makes it doubtful.
PARTS = POSITIVE | frozenset(
    "area author avatar bar block body bottom box btn button buttons card col column component container count date desktop feed first fixed form frame "
    "group head heading holder icon icons image img inner item items label large last left link links list main meta mini mobile module node outer panel "
    "primary region reply right row secondary section side slot small sticky stream thread title top unit wrap wrapper zone".split()
)
TEXT_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 dd figcaption li td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SMOOTH, SIBLING = 1.2, 0.6
#: What a block's place says, in log-odds: in or outside an article, in something that may be or surely is boilerplate.
ARTICLE, DOUBTFUL, MARKED = 2.5, 2.5, 12.0
#: The most that the model of a block's text says.
MOST = 3.0
#: Share of the words (outside links) that makes a marked element a wrapper: of a page without an article, of an article in a form.
WHOLE, MOSTLY = 0.8, 0.6
#: Share of the main article's words that another article of the page must have to count as text too.
BESIDE = 0.5
FIT_PAGES, FIT_BLOCKS = 400, 100
#: Without pages to learn from: for FEATURES.
FIXED = np.array([-1.0, 1.1, -3.5, 0.8, 0.0, 0.0])
FEATURES = ("one", "log_words_unlinked", "linked", "text_tag", "heading", "stops")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOPS = re.compile(r"[.,;:!?](?=\s|$)")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    node: int


class _Page(HTMLParser):
    """The elements, as numbers in order of their start, and the text blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # by element; 0 stands for the page
        self.tag, self.parent, self.mark, self.block = [""], [0], [0], [False]
        self.is_comment, self.is_article = [False], [False]
        self.owner, self.level = [0], [0]  # nearest block element, block elements above and including it
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # places on the stack, by tag
        self.silent = self.links = self.articles = 0
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[Block] = []

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            self.found.append(Block(" ".join(words), len(words), min(self.linked, len(words)), self.stack[-1]))
        self.parts, self.linked = [], 0

    def _at(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or 0."""
        places = self.open.get(tag)
        return places[-1] if places else 0

    def _pop_to(self, k: int) -> None:
        flushed = False
        while len(self.stack) > k:
            node = self.stack[-1]
            tag = self.tag[node]
            if self.block[node] and not flushed:
                # all that is popped ends here: its text belongs where it was read
                self.flush()
                flushed = True
            self.stack.pop()
            self.open[tag].pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.articles -= self.is_article[node]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and (k := self._at("p")):
            self._pop_to(k)
        elif tag in ENDS_ITSELF and (k := self._at(tag)) and k > max(map(self._at, LISTS)):
            self._pop_to(k)
        block = tag in BLOCK and not (tag in CONTROLS and self.tag[self.owner[self.stack[-1]]] in TEXT_TAGS)
        if block:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        node, above = len(self.tag), self.stack[-1]
        self.tag.append(tag)
        self.parent.append(above)
        article = tag in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody"
        self.block.append(block)
        mark, comment = self._mark(tag if block or tag not in CONTROLS else "span", given, article)
        self.mark.append(mark)
        self.is_comment.append(comment)
        self.is_article.append(article)
        self.owner.append(node if block else self.owner[above])
        self.level.append(self.level[above] + block)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.articles += article

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _mark(self, tag: str, given: dict[str, str], article: bool) -> tuple[int, bool]:
        """2 if the element is boilerplate, 1 if it may be, else 0; and whether it holds readers' comments."""
        names = [[t.lower() for t in _TOKEN.findall(name)] for name in (*given.get("class", "").split(), given.get("id", ""))]
        comment = any(COMMENTS.intersection(parts) and not MODIFIERS.intersection(parts) for parts in names)
        if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
            return 2, comment
        if tag in OUTSIDE or given.get("role", "") in ROLES:
            return 2, comment
        if tag == "header":
            return (0 if self.articles else 2), comment
        if tag in ("html", "body", "main") or article and not comment:
            return 0, False
        positive = any(POSITIVE.intersection(parts) for parts in names)
        return max((self._by_name(parts, positive) for parts in names), default=0), comment

    def _by_name(self, parts: list[str], positive: bool) -> int:
        found = NEGATIVE.intersection(parts)
        if not found:
            return 0
        first = next(k for k, p in enumerate(parts) if p in NEGATIVE)
        if MODIFIERS.intersection(parts[:first]):
            return 0
        if parts[-1] not in NEGATIVE and parts[-1] not in PARTS:
            return 1
        return 1 if found <= AMBIGUOUS and (self.articles or positive) else 2

    def handle_endtag(self, tag):
        if k := self._at(tag):
            self._pop_to(k)
        elif tag == "p":
            self.flush()

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.split())

    def close(self):
        super().close()
        self.flush()


def read(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    page.close()
    return page


def places(page: _Page) -> tuple[list[int], list[bool], bool]:
    """For each element its mark after wrappers are let go, and whether it is in an article; and whether the page has one."""
    n = len(page.tag)
    plain = [0] * n  # words outside links below each element
    for b in page.found:
        plain[b.node] += b.words - b.linked
    for k in range(n - 1, 0, -1):
        plain[page.parent[k]] += plain[k]
    comment, inside = page.is_comment[:], [False] * n
    for k in range(1, n):
        comment[k] = comment[k] or comment[page.parent[k]]
    every = [k for k in range(n) if page.is_article[k] and plain[k]]
    main = max((k for k in every if not comment[k]), key=lambda k: (plain[k], -k), default=max(every, key=lambda k: (plain[k], -k), default=0))
    # other articles count as the page's if they are of some length beside the main one; shorter ones are teasers
    large = [page.is_article[k] and (k == main or plain[k] >= BESIDE * plain[main]) for k in range(n)]
    for k in range(1, n):
        inside[k] = large[k] or inside[page.parent[k]]
    wrapper = [False] * n
    k = main
    while k:
        wrapper[k] = True
        k = page.parent[k]
    mark = [0] * n
    for k in range(1, n):
        own = page.mark[k]
        if own and not (comment[k] and k != main):
            if wrapper[k] or not main and plain[k] >= WHOLE * plain[0] > 0 or main and page.tag[k] in ("form", "fieldset") and inside[k] and plain[k] >= MOSTLY * plain[main]:
                own = 0
        mark[k] = max(own, mark[page.parent[k]])
    return mark, inside, bool(main)


def features(page: _Page, block: Block) -> list[float]:
    """One value for each of FEATURES."""
    tag = page.tag[page.owner[block.node]]
    links = block.linked / block.words
    return [1.0, float(np.log1p(block.words)) * (1 - links), links, float(tag in TEXT_TAGS), float(tag in HEADINGS), min(1.0, 10 * len(_STOPS.findall(block.text)) / block.words)]


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def examples(html: str) -> list[tuple[bool, list[float]]]:
    """(is content, features) of FIT_BLOCKS blocks at most of a page with an article, evenly over the page; else none."""
    page = read(html)
    mark, inside, has_article = places(page)
    if not has_article:
        return []
    step = -(-len(page.found) // FIT_BLOCKS)
    return [(inside[b.node] and not mark[b.node], features(page, b)) for b in page.found[:: max(1, step)]]


def fit(pages: DataFrame, html_col: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """Weights of the text model, from at most about `most` pages with an article; FIXED if content or boilerplate is missing."""
    html = pages.select(F.col(html_col).alias("__html")).filter(F.col("__html").isNotNull())
    n = html.count()

    def run(batches):
        for b in batches:
            rows = [r for h in texts(b, "__html") for r in examples(h)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.bool_()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["y", "x"])

    # no more than about `most` pages are read by the tasks, the cut by hash holds their number to within a few hundredths
    some = html.filter(F.pmod(F.xxhash64("__html"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, most / max(1, n))) + 1) if n > most else html
    rows = some.mapInArrow(releasing(run), "y boolean, x array<double>").toPandas()
    y = rows["y"].to_numpy(float) if len(rows) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return FIXED
    x = np.array(rows["x"].tolist(), float)
    order = np.lexsort((*x.T, y))  # the same sum whatever the order of the rows
    return regress(x[order], y[order])


def scores(page: _Page, weights: np.ndarray = FIXED) -> list[float]:
    """Per block: positive for content, negative for boilerplate, in log-odds."""
    mark, inside, has_article = places(page)
    text = np.clip(np.array([features(page, b) for b in page.found]).reshape(-1, len(FEATURES)) @ weights, -MOST, MOST).tolist()
    return [z + ((ARTICLE if inside[b.node] else -ARTICLE) if has_article else 0.0) - (0.0, DOUBTFUL, MARKED)[mark[b.node]] for z, b in zip(text, page.found, strict=True)]


def _distance(page: _Page, a: int, b: int) -> int:
    """Block elements between two elements' nearest common one and them; blocks in page order make this linear over a page."""
    both = page.level[a] + page.level[b]
    while a != b:
        if a > b:  # the later element cannot hold the earlier one
            a = page.parent[a]
        else:
            b = page.parent[b]
    return both - 2 * page.level[a]


class FlowNetwork:
    """Maximum flow by blocking flows; capacities are integers."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def add(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Push all flow there is; which nodes the source still reaches."""
        while (level := self._levels(source))[sink] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    push = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= push
                        self.left[e ^ 1] += push
                    first = next(k for k, e in enumerate(path) if not self.left[e])
                    node = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[node] < len(self.out[node]):
                    e = self.out[node][at[node]]
                    if self.left[e] and level[self.to[e]] == level[node] + 1:
                        break
                    at[node] += 1
                if at[node] < len(self.out[node]):
                    path.append(self.out[node][at[node]])
                    node = self.to[path[-1]]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    at[node] += 1
                else:
                    break
        return [x >= 0 for x in level]


def label(page: _Page, weights: np.ndarray = FIXED) -> list[bool]:
    """Which blocks are content: the source side of the minimum cut."""
    n = len(page.found)
    net = FlowNetwork(n + 2)
    whole = lambda x: int(round(x * 1000))
    last_under: dict[int, int] = {}
    for k, (block, z) in enumerate(zip(page.found, scores(page, weights), strict=True)):
        if z > 0:
            net.add(n, k, whole(z))
        else:
            net.add(k, n + 1, whole(-z))
        if k:
            w = whole(SMOOTH / (1 + _distance(page, page.found[k - 1].node, block.node)))
            net.add(k - 1, k, w, w)
        parent = page.owner[page.parent[page.owner[block.node]]]
        if (other := last_under.get(parent)) is not None:
            net.add(other, k, whole(SIBLING), whole(SIBLING))
        last_under[parent] = k
    return net.source_side(n, n + 1)[:n]


def main_text(html: str, weights: np.ndarray = FIXED) -> str:
    page = read(html)
    return "\n\n".join(b.text for b, keep in zip(page.found, label(page, weights), strict=True) if keep) if page.found else ""


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """The kept columns, `text` and `n_chars`; the model is fitted on the pages unless its weights are given."""
    small_batches(pages.sparkSession)
    known = fit(pages, html_col) if weights is None else weights

    def run(batches):
        for b in batches:
            out = [main_text(h, known) for h in texts(b, "__html")]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(keep))] + [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(releasing(run), schema)
