"""HTML main-text extraction by a tree-structured graphical model.

A page is parsed to its DOM.  Every element is a node with a hidden label, content or
not.  The model is a directed tree: the root's label has a prior, a child's label
depends on its parent's by a potential of its tag group, and what is seen of a node (tag,
words of class, id and role, share of link text, length and punctuation of its text) is
weighed given its label.  Sum-product messages, leaves to root and back, give each node's
marginal probability of being content; the texts of blocks at 0.5 or more are the main text.

Training takes a bounded sample of pages (max_pages, by hash of page_id) that label
themselves: pages with an <article> or <main> element, all within it content but for
elements that HTML itself sets apart (nav, aside, footer, form, script ...) and for blocks
whose text other pages of the same host have as well: what pages agree on is the host's
template, not the article.  Words of class, id and role label nothing and decide nothing: they are seen, each word, and whether one of a
list (comments, adverts ...) is among them, of the element itself alone.  All parameters are smoothed counts.  Without such
pages the model's built-in expectations (BUILTIN) are used.

Readers' comments are told by repetition: two or more siblings of one shape, each of
which begins with a short text that is no sentence and goes on with longer ones, and of
which something says that people answer here: a date or "reply" in each, or a word of
class or id of the siblings, what holds them or its parent.  An element whose class or id
names comments is such a thread, too, unless it holds the article or most of the page.
A thread is seen of all its elements, and training never labels it content.

Defined results.  A null or empty html gives an empty text.  Malformed and cut-off pages
are parsed as far as they go; a reference that can't be decoded stays as it is.  Rows are
neither dropped nor merged, nulls and repeats of page_id and url are passed through.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, session, table, written

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg canvas object iframe textarea select button option".split())
APART = frozenset("nav aside footer form menu dialog".split()) | HIDDEN
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: What a head can hold: the start of anything else ends it.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that can hold the page's text where their end tag is missing: they then set nothing apart.
LOOSE = frozenset("object button canvas svg".split())
#: Elements that a sibling's start ends, and the elements that this search stays within.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: What an observation counts at most (others: 1.2), and what it counts where training hasn't seen it.
BOUND = {"beside": 3.5, "thread": 8.0}
EXPECTED = {"beside": -3.5, "thread": -8.0}
#: The same where nothing was trained.
BUILTIN = EXPECTED | {"tag:p": 1.0, "tag:h1": 0.8, "tag:h2": 0.5, "tag:h3": 0.5, "links:0": 0.6, "links:1": 0.2, "links:2": -0.8, "links:3": -1.2, "links:none": -0.3, "stops:0": -0.4, "stops:1": 0.8, "stops:2": 1.0, "stops:3": 0.8} | {f"size:{i}": -0.6 for i in range(5)} | {f"size:{i}": 0.4 for i in range(7, 13)}
#: Words of class and id that name readers' comments, and words that may.
COMMENT_WORDS = frozenset("comment comments replies disqus respond".split())
PEOPLE_WORDS = COMMENT_WORDS | frozenset("reply response responses thread discussion discussions feedback post posts user users author avatar review reviews".split())
_DATED = re.compile(r"\b(19|20)\d\d\b|\b\d+ (second|minute|hour|day|week|month|year)s? ago\b|\b\d\d?:\d\d\b", re.I)
_REPLY = re.compile(r"(reply|answer|respond|like|quote)s?( to)?\b", re.I)
#: Elements that hold the main text whatever their class says.
WHOLE = frozenset("html body main article".split())
#: Words of class, id and role that elements beside the main text often have.
APART_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion comment comments reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related recommended recommendations search pagination pager tags copyright legal disclaimer skip".split()
)
_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[a-z]+")


class Node:
    """block: the nearest element from here up that isn't inline; chars, link_chars, stops: of the text within, once the page is parsed."""

    __slots__ = ("tag", "tokens", "parent", "block", "chars", "link_chars", "stops", "apart", "hidden", "closed", "thread")

    def __init__(self, tag: str, tokens: frozenset[str], parent: int, block: int) -> None:
        self.tag, self.tokens, self.parent, self.block = tag, tokens, parent, block
        self.chars = self.link_chars = self.stops = 0
        self.apart = self.hidden = self.closed = self.thread = False


class _Parser(HTMLParser):
    """nodes: the elements, parents first; runs: (block node, text) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", frozenset(), -1, 0)]
        self.open = [0]
        self.count: Counter = Counter()  # open elements by tag, so that no search climbs in vain
        self.runs: list[tuple[int, list[str]]] = []
        self.fresh = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or (tag not in HEAD and self.nodes[self.open[-1]].tag == "head"):
            self._end({"head"}, set())
        if tag in CLOSES_P and tag != "hr":
            self._end({"select"}, {"object"})
        if tag in CLOSES_P:
            self._end({"p"}, {"button", "td", "th", "table"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        words = frozenset(w for k, v in attrs if v and k in ("class", "id", "role", "aria-label") for w in _TOKENS.findall(v.lower())) if attrs else frozenset()
        n = len(self.nodes)
        node = Node(tag, words, self.open[-1], self.nodes[self.open[-1]].block if tag in INLINE else n)
        # a header is the page's unless an article holds it
        node.apart = tag == "header" and not (self.count["article"] or self.count["main"])
        self.nodes.append(node)
        if tag == "br":
            self._text(" ")
        if tag not in INLINE:
            self.fresh = True
        if tag not in VOID:
            self.open.append(n)
            self.count[tag] += 1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What begins with <![ is a comment in HTML, whatever follows."""
        return self.parse_bogus_comment(i, report)

    def _close(self, k: int) -> None:
        for n in self.open[k:]:
            self.count[self.nodes[n].tag] -= 1
        del self.open[k:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.nodes[self.open[-1]].tag == tag:
            self.nodes[self.open[-1]].closed = True
            self._close(len(self.open) - 1)

    def _end(self, tags: set[str], within: set[str]) -> None:
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in tags:
                self._close(k)
                self.fresh = True
                return
            if tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.count[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[k]].tag == tag:
                if any(self.nodes[n].tag not in INLINE for n in self.open[k:]):
                    self.fresh = True
                self.nodes[self.open[k]].closed = True
                self._close(k)
                return

    def _text(self, data: str) -> None:
        block = self.nodes[self.open[-1]].block
        if self.fresh or not self.runs or self.runs[-1][0] != block:
            self.runs.append((block, []))
            self.fresh = False
        self.runs[-1][1].append(data)

    def handle_data(self, data: str) -> None:
        if self.nodes[self.open[-1]].tag == "head" and not data.isspace():
            self._end({"head"}, set())
        self._text(data)
        size = len(data) - data.count(" ")
        if not size:
            return
        node = self.nodes[self.open[-1]]
        node.chars += size
        node.stops += data.count(".") + data.count(",") + data.count("!") + data.count("?")
        if self.count["a"]:
            node.link_chars += size


def _loose(node: Node) -> bool:
    return node.tag in LOOSE and not node.closed


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's nodes, parents first, and its runs of text by block, white space made single."""
    p = _Parser()
    p.feed(html)
    p.close()
    # what is within an element that is set apart, or hidden, is so as well
    for node in p.nodes[1:]:
        up = p.nodes[node.parent]
        node.apart = node.apart or up.apart or (node.tag in APART and not _loose(node))
        node.hidden = up.hidden or (node.tag in HIDDEN and not _loose(node))
    for node in reversed(p.nodes[1:]):
        up = p.nodes[node.parent]
        up.chars, up.link_chars, up.stops = up.chars + node.chars, up.link_chars + node.link_chars, up.stops + node.stops
    runs = [(n, _SPACE.sub(" ", "".join(parts)).strip()) for n, parts in p.runs]
    runs = [(n, t) for n, t in runs if t]
    _mark_threads(p.nodes, runs)
    return p.nodes, runs


#: Levels up to which a text counts for the elements around it, and its first texts that are looked at.
LEVELS, FIRST = 6, 4


def _mark_threads(nodes: list[Node], runs: list[tuple[int, str]]) -> None:
    """Sets thread for readers' comments and all within them; see the module's text."""
    holds: set[int] = set()  # elements around an article or main
    for i, n in enumerate(nodes):
        if n.tag in ("article", "main"):
            while i > 0 and i not in holds:
                holds.add(i)
                i = nodes[i].parent
    texts: dict[int, list[str]] = {}
    for i, t in runs:
        for _ in range(LEVELS):
            if i <= 0:
                break
            mine = texts.setdefault(i, [])
            if len(mine) < FIRST:
                mine.append(t)
            i = nodes[i].parent
    siblings: dict[tuple, list[int]] = {}
    for i in texts:
        if nodes[i].tag not in INLINE and nodes[i].tag not in WHOLE and not nodes[i].apart:
            siblings.setdefault((nodes[i].parent, nodes[i].tag, nodes[i].tokens), []).append(i)

    def spoken(i: int) -> bool:
        first, rest = texts[i][0], texts[i][1:]
        return len(first) <= 40 and (first[-1] not in ".!?" or len(first.split()) <= 3) and any(len(t) > 20 or t[-1] in ".!?" for t in rest)

    for (up, _, tokens), items in siblings.items():
        if len(items) < 2 or not all(spoken(i) for i in items):
            continue
        dated = all(any(_DATED.search(t) or _REPLY.fullmatch(t) for t in texts[i]) for i in items)
        around = tokens | (nodes[up].tokens if nodes[up].tag not in WHOLE else frozenset()) | (nodes[nodes[up].parent].tokens if nodes[up].parent > 0 and nodes[nodes[up].parent].tag not in WHOLE else frozenset())
        if dated or around & PEOPLE_WORDS:
            for i in items:
                nodes[i].thread = i not in holds
            if nodes[up].tokens & PEOPLE_WORDS and nodes[up].tag not in WHOLE and up not in holds:
                nodes[up].thread = True
    for i, n in enumerate(nodes[1:], 1):
        named = n.tokens & COMMENT_WORDS and n.tag not in WHOLE and i not in holds and 10 * n.chars < 7 * nodes[0].chars
        n.thread = n.thread or bool(named) or nodes[n.parent].thread


def seen(node: Node) -> list[str]:
    """What is seen of a node."""
    share = node.link_chars / node.chars if node.chars else 0.0
    out = [f"tag:{node.tag}", f"links:{min(int(share * 4), 3)}" if node.chars else "links:none", f"size:{min(int(math.log2(node.chars + 1)), 12)}", f"stops:{min(int(40 * node.stops / node.chars), 4)}" if node.chars else "stops:none"]
    out.append("apart" if node.apart else "plain")
    out += [f"word:{w}" for w in node.tokens]
    if node.tokens & APART_WORDS and node.tag not in WHOLE:
        out.append("beside")
    if node.thread:
        out.append("thread")
    return out


def group(node: Node) -> str:
    """The tag group whose potential ties a node to its parent."""
    if node.apart:
        return "apart"
    if node.tag in ("article", "main"):
        return "body"
    return "inline" if node.tag in INLINE else "heading" if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "header") else "block"


@dataclass
class Model:
    """root: P(content) of the root; tie[group][parent label]: P(content); weight: log P(seen | content) / P(seen | not)."""

    root: float = 0.01
    tie: dict[str, tuple[float, float]] = field(default_factory=lambda: {"apart": (1e-5, 1e-4), "body": (0.95, 0.98), "inline": (0.05, 0.98), "heading": (0.1, 0.9), "block": (0.1, 0.95)})
    weight: dict[str, float] = field(default_factory=dict)


def self_labels(nodes: list[Node], template: frozenset[int] = frozenset()) -> list[int] | None:
    """1 for nodes within the page's article or main that nothing sets apart, and that aren't in template; None for a page without either element."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    out = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if i and not n.apart and not n.thread and i not in template and (out[n.parent] or n.tag in ("article", "main")):
            out[i] = 1
    return out


def marginals(model: Model, nodes: list[Node]) -> list[float]:
    """P(content) of each node: messages from the leaves to the root, and back."""
    n = len(nodes)
    expected = EXPECTED if model.weight else BUILTIN
    own = [1.0] * n  # likelihood ratio content : not, of what is seen
    for i, node in enumerate(nodes):
        if i:
            own[i] = math.exp(max(-30.0, min(30.0, sum(model.weight.get(s, expected.get(s, 0.0)) for s in seen(node)))))
    tie = [model.tie[group(x)] for x in nodes]
    up = [(1.0, 1.0)] * n  # a node's message to its parent, for the parent's labels 0 and 1
    down_in = [(1.0, 1.0)] * n  # the product of the children's messages
    for i in range(n - 1, 0, -1):
        m0, m1 = down_in[i][0], own[i] * down_in[i][1]
        a, b = tie[i]
        u0, u1 = (1 - a) * m0 + a * m1, (1 - b) * m0 + b * m1
        s = u0 + u1
        up[i] = u0 / s, u1 / s
        p = nodes[i].parent
        x0, x1 = down_in[p][0] * up[i][0], down_in[p][1] * up[i][1]
        s = x0 + x1
        down_in[p] = (x0 / s, x1 / s) if s > 1e-280 else (0.5, 0.5)
    from_above = [(1 - model.root, model.root)] * n
    out = [model.root] * n
    for i in range(n):
        if i:
            p = nodes[i].parent
            # the parent's belief without this child's message
            b0, b1 = from_above[p][0] * down_in[p][0] / max(up[i][0], 1e-12), from_above[p][1] * own[p] * down_in[p][1] / max(up[i][1], 1e-12)
            s = b0 + b1
            b0, b1 = b0 / s, b1 / s
            a, b = tie[i]
            from_above[i] = b0 * (1 - a) + b1 * (1 - b), b0 * a + b1 * b
        m0, m1 = from_above[i][0] * down_in[i][0], from_above[i][1] * own[i] * down_in[i][1]
        out[i] = m1 / (m0 + m1) if m0 + m1 > 0 else 0.0
    return out


def extract(model: Model, html: str | None) -> str:
    if not html:
        return ""
    nodes, runs = parse(html)
    if not runs:
        return ""
    p = marginals(model, nodes)
    return "\n\n".join(t for n, t in runs if p[n] >= 0.5 and not nodes[n].hidden)


def train(pages: DataFrame, *, max_pages: int = 2_000, agreeing: int = 3) -> Model:
    """Smoothed counts over at most max_pages pages that label themselves, the first by hash of page_id.

    A block's text is the host's template if `agreeing` pages of the sample or more have it.
    """
    spark = session(pages)
    sample = pages.select("page_id", "html").where("html is not null and (html ilike '%<article%' or html ilike '%<main%')").select("page_id", F.xxhash64("page_id").alias("h"))
    picked = sample.orderBy("h", "page_id").limit(max_pages).select("page_id").distinct()
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")) if "url" in pages.columns else F.lit("")
    rows = written(pages.select("page_id", host.alias("host"), "html").join(F.broadcast(picked), "page_id"), "labelled")

    def texts() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [(host, t) for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True) for t in {t for _, t in parse(html or "")[1]}]
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in range(2)], names=["host", "text"])

        return step

    agreed = arrow_map(rows, texts, "host string, text string").groupBy("host", "text").agg(F.count("*").alias("n")).where(F.col("n") >= agreeing)
    sent = spark.sparkContext.broadcast({(r.host, r.text) for r in agreed.collect()})  # bounded by max_pages

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            c: Counter = Counter()
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                nodes, runs = parse(html or "")
                template = frozenset(n for n, t in runs if (host, t) in sent.value)
                if (labels := self_labels(nodes, template)) is None:
                    continue
                for i, node in enumerate(nodes):
                    if not i:
                        continue
                    y = labels[i]
                    c["n", str(y), ""] += 1
                    c["tie", group(node), f"{labels[node.parent]}{y}"] += 1
                    for s in seen(node):
                        c["seen", s, str(y)] += 1
            return pa.RecordBatch.from_arrays([pa.array([k[j] for k in c], pa.string()) for j in range(3)] + [pa.array(list(c.values()), pa.int64())], names=["kind", "name", "label", "n"])

        return step

    got = arrow_map(rows, make, "kind string, name string, label string, n long").groupBy("kind", "name", "label").agg(F.sum("n").alias("n")).where("kind <> 'seen' or n >= 3").collect()  # bounded by max_pages
    c = {(r.kind, r.name, r.label): r.n for r in got}
    model = Model()
    n1, n0 = c.get(("n", "1", ""), 0), c.get(("n", "0", ""), 0)
    if not n1 or not n0:
        return model
    for g, prior in list(model.tie.items()):
        ties = []
        for parent in (0, 1):
            k = [c.get(("tie", g, f"{parent}{y}"), 0) for y in (0, 1)]
            least = 1e-5 if g == "apart" else 0.005
            ties.append(min(max((k[1] + 4 * prior[parent]) / (k[0] + k[1] + 4), least), 1 - least))
        model.tie[g] = tuple(ties)
    for name in {k[1] for k in c if k[0] == "seen"}:
        p1, p0 = (c.get(("seen", name, "1"), 0) + 1) / (n1 + 2), (c.get(("seen", name, "0"), 0) + 1) / (n0 + 2)
        # what is seen of one node depends on each other, and pages of other kinds differ: each counts in part
        most, part = BOUND.get(name, 1.2), 1.0 if name in BOUND else 0.5
        model.weight[name] = max(-most, min(most, part * math.log(p1 / p0)))
    return model


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    session(pages)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(model, h) for h in batch["html"].to_pylist()]
            return pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return step

    return arrow_map(pages.select("page_id", "url", "html"), make, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))
