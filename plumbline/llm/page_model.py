"""Main text of web pages by a tree-structured graphical model over their DOM.

Every block element and every run of text is a node with the states "boilerplate" and "content". A node's features give
its own potentials, and a table gives those of a parent and its child. Sum-product messages go up to the root and down
again, exactly, as the graph is a tree; text runs whose marginal for content reaches the threshold are kept. The
potentials are trained by maximum likelihood on labelled pages, which ``labelled_pages`` lays out by rule.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, map_arrow

#: Fixed values of HTML: elements that start a block, that hold no text of the page, and that have no end.
BLOCKS = set(
    "html body div p article section main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4"
    " h5 h6 form fieldset blockquote pre figure figcaption address details summary hr center dialog menu".split()
)
UNSEEN = {"noscript", "template", "svg", "iframe", "object", "select", "button", "title", "math", "canvas", "audio", "video"}
#: Unseen as well; what they hold is no markup, so without an end tag they go on to the end.
RAW = ("script", "style", "textarea")
#: Elements that ``/>`` ends.
FOREIGN = {"svg", "math"}
#: Fixed values of HTML: what an opening tag closes in its list, table or flow.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

_START = re.compile(rf"<(?:(!--)|({'|'.join(RAW)})(?=[\s/>])|(/?)([a-z][a-z0-9:-]*)|[!?])", re.IGNORECASE)
_ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_BODY = re.compile(r"<body[\s>]", re.IGNORECASE)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

FEATURES = 1 << 14


def _bucket(name: str) -> int:
    value = 0xCBF29CE484222325
    for c in name.encode("utf-8", "surrogatepass"):
        value = ((value ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (value ^ value >> 29) % FEATURES


class _Buckets(dict):
    def __missing__(self, name):
        value = _bucket(name)
        if len(self) < 100_000:
            self[name] = value
        return value


_buckets = _Buckets()


@dataclass
class Forest:
    """Nodes of many pages: parents stand before their children, and a root's parent is -1."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)  # 0: element, 1: text
    features: list[list[int]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # of text nodes
    page: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)  # of labelled pages, else 0

    def add(self, parent: int, kind: int, features: list[int], text: str, page: int, label: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.features.append(features)
        self.text.append(text)
        self.page.append(page)
        self.label.append(label)
        return len(self.parent) - 1


def _element_features(tag: str, attributes: str, parent_tag: str) -> list[int]:
    names = [f"tag {tag}", f"in {parent_tag} {tag}", "element"]
    if "=" in attributes or "hidden" in attributes:
        for _, a, b, c in _NAMED.findall(attributes):
            names += [f"name {w}" for w in _WORDS.findall((a or b or c).lower())]
        if _HIDDEN.search(attributes):
            names.append("hidden")
    return [_buckets[n] for n in names]


def _text_features(text: str, linked: int, tag: str) -> list[int]:
    words = text.count(" ") + 1
    share = 4 * linked // max(len(text), 1)
    names = ["text", f"text in {tag}", f"words {min(words.bit_length(), 6)}", f"links {share}", f"ends {text[-1] in '.!?…:;”»'}"]
    if "©" in text or "copyright" in text.lower()[:40]:
        names.append("copyright")
    return [_buckets[n] for n in names]


class Token(NamedTuple):
    """A tag, or (without ``tag``) a comment, a declaration or an element whose text is no page text, with that text."""

    start: int
    end: int
    closing: bool = False
    tag: str | None = None
    attributes: str = ""


class Scanner:
    """Cuts a page into tokens from any place on, in time proportional to its length: what a search did not find is kept in mind."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.absent: set[re.Pattern] = set()
        self.marks: list[int] | None = None
        self.ends: list[int] = []

    def _search(self, pattern: re.Pattern, at: int) -> re.Match | None:
        found = None if pattern in self.absent else pattern.search(self.source, at)
        if found is None:
            self.absent.add(pattern)  # nor behind any later place
        return found

    def _tag_end(self, at: int) -> int:
        """Behind the ``>`` that ends attributes from ``at`` on and is not inside quotes; -1 without one."""
        if self.marks is None:
            if found := _ATTRIBUTES.match(self.source, at):
                return found.end()
            # Quotes are open to the end of the page: the end is worked out for every quote at once, from the last one back.
            self.marks = [m.start() for m in re.finditer("[>\"']", self.source)]
            self.ends, later = [-1] * (len(self.marks) + 1), {}
            for i in range(len(self.marks) - 1, -1, -1):
                mark = self.source[self.marks[i]]
                self.ends[i] = self.marks[i] + 1 if mark == ">" else self.ends[later[mark] + 1] if mark in later else -1
                later[mark] = i
        return self.ends[bisect_left(self.marks, at)]

    def next(self, at: int) -> Token | None:
        source = self.source
        while found := _START.search(source, at):
            start, at = found.span()
            if found[1]:
                end = source.find("-->", at)
                return Token(start, len(source) if end < 0 else end + 3)
            if at > self.last:
                continue  # no tag ends any more, but comments may begin
            if found[2] and (end := self._tag_end(at)) >= 0:
                close = self._search(_RAW_END[found[2].lower()], end)
                if close:
                    return Token(start, close.end())
                body = self._search(_BODY, end)
                return Token(start, body.start() if body else len(source))
            tag = found[2] or found[4]
            end = self._tag_end(at) if tag else -1
            end = source.index(">", at) + 1 if end < 0 else end
            return Token(start, end, bool(found[3]), tag and tag.lower(), source[at : end - 1])
        return None


def _ends(scanner: Scanner) -> dict[int, int]:
    """Where the end tag of each unseen element is over, by where its opening tag starts; of those that have an end tag."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    at = 0
    while token := scanner.next(at):
        at = token.end
        if token.tag not in UNSEEN:
            continue
        starts = open_at.setdefault(token.tag, [])
        if not token.closing:
            if not (token.tag in FOREIGN and token.attributes.endswith("/")):
                starts.append(token.start)
        elif starts:
            ends[starts.pop()] = token.end
    return ends


def _tokens(source: str):
    """Tags and comments of what is seen. An unseen element without end tag hides no more than its tag, a title its text."""
    scanner, ends, at = Scanner(source), None, 0
    while token := scanner.next(at):
        at = token.end
        if not token.closing and token.tag in UNSEEN:
            ends = _ends(Scanner(source)) if ends is None else ends
            at = ends.get(token.start, at)
            if token.tag == "title" and token.start not in ends:
                at = len(source) if (found := source.find("<", at)) < 0 else found
        yield token, at


class _Open:
    """The open elements, with the places of each tag's."""

    def __init__(self, root: int):
        self.stack: list[tuple[str, int, int]] = [("", root, 0)]  # tag, node, label
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int, label: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, label))

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 without one."""
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()


def parse(forest: Forest, page: int, source: str, label_of=None) -> None:
    """Add a page's nodes. ``label_of`` gives the label an opening tag sets for what it holds, or None to keep the parent's."""
    root = forest.add(-1, 0, [_buckets["tag root"]], "", page, 0)
    held = _Open(root)
    run: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            tag, node, label = held.stack[-1]
            forest.add(node, 1, _text_features(text, linked, tag or "root"), text, page, label)
        run.clear()
        linked = 0

    at = 0
    for token, after in _tokens(source):
        if token.start > at:
            piece = source[at : token.start]
            run.append(piece)
            linked += len(piece) if in_link else 0
        at, tag = after, token.tag
        if tag is None:
            continue
        if tag == "a":
            in_link = 0 if token.closing else 1
        if tag in ("br", "wbr", "img", "input"):
            run.append(" " if tag != "wbr" else "")
        if tag not in BLOCKS:
            continue
        flush()
        if token.closing:
            if place := held.last((tag,)):
                held.close(place)
                in_link = 0
            continue
        if held.stack[-1][0] == "p":  # a paragraph ends where any block begins
            held.close(len(held.stack) - 1)
        if tag in CLOSES:
            place = held.last(CLOSES[tag])
            if place > held.last(HOLDERS.get(tag, ("table",))):
                held.close(place)
        if tag in ("hr",):
            continue
        parent_tag, parent, label = held.stack[-1]
        label = label if label_of is None or (own := label_of(token.attributes)) is None else own
        held.push(tag, forest.add(parent, 0, _element_features(tag, token.attributes, parent_tag or "root"), "", page, label), label)
    if at < len(source):
        rest = source[at:]
        run.append(rest)
        linked += len(rest) if in_link else 0
    flush()


@dataclass
class Model:
    """``own[f]`` is added to a node's log potential of content for each feature; ``pair[kind, parent, child]`` is shared."""

    own: np.ndarray
    pair: np.ndarray


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Graph:
    """Arrays of a forest, with its nodes by depth."""

    def __init__(self, forest: Forest):
        self.parent, self.kind = np.array(forest.parent, dtype=np.int64), np.array(forest.kind, dtype=np.int64)
        depth = np.array(forest.depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        counts = np.array([len(f) for f in forest.features], dtype=np.int64)
        self.flat = np.array([f for own in forest.features for f in own], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def __len__(self):
        return len(self.parent)

    def marginals(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Each node's probability of content, and the joint probabilities of its parent's state and its own."""
        n = len(self)
        inside = np.zeros((n, 2))
        inside[:, 1] = np.bincount(self.owner, model.own[self.flat], minlength=n)
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:  # upward: leaves first
            up[level] = _log_sum(model.pair[self.kind[level]] + inside[level][:, None, :], 2)
            for state in (0, 1):
                inside[:, state] += np.bincount(self.parent[level], up[level, state], minlength=n)
        outside, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:  # downward
            above = self.parent[level]
            rest = (inside[above] + outside[above] - up[level])[:, :, None] + model.pair[self.kind[level]]
            outside[level] = _log_sum(rest, 1)
            both = rest + inside[level][:, None, :]
            both -= both.max(axis=(1, 2), keepdims=True)
            both = np.exp(both)
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        total = inside + outside
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), joint


def train(forest: Forest, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Gradient ascent on the likelihood of all labels; the expectations come from the same messages."""
    graph, label = Graph(forest), np.array(forest.label)
    model = Model(np.zeros(FEATURES), np.zeros((2, 2, 2)))
    seen = np.bincount(graph.flat, label[graph.owner], minlength=FEATURES)
    inner = graph.parent >= 0
    counted = np.zeros((2, 2, 2))
    np.add.at(counted, (graph.kind[inner], label[graph.parent[inner]], label[inner]), 1)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.own, model.pair)]
    for step in range(1, steps + 1):
        chance, joint = graph.marginals(model)
        own = seen - np.bincount(graph.flat, chance[graph.owner], minlength=FEATURES) - decay * len(graph) * 0.01 * model.own
        pair = counted.copy()
        for kind in (0, 1):
            pair[kind] -= joint[inner & (graph.kind == kind)].sum(axis=0)
        for p, g, (m, v) in zip((model.own, model.pair), (own, pair), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


#: Names that the labelled pages give to parts of a page.
CONTENT_NAMES = "content article post entry story text body main page post-content entry-content article-body story-text post-body rich-text prose".split()
OTHER_NAMES = (
    "nav menu navbar topbar breadcrumb breadcrumbs sidebar widget ad ads advert advertisement banner sponsor sponsored promo promotion cookie cookies"
    " cookie-notice consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended more"
    " trending popular tags pagination pager footer copyright legal disclaimer header masthead branding logo toolbar comments comment comment-list reply"
    " respond discussion disqus feedback author-bio meta byline form contact rating skip"
).split()


def labelled_pages(count: int = 400, seed: int = 6) -> list[str]:
    """Pages laid out by rule; ``data-y`` on an element labels all it holds: 1 content, 0 not."""
    rng = random.Random(seed)
    parts = [a + b for a in "b d f g k l m n p r s t v".split() for b in "a e i o u".split()]

    def word():
        return "".join(rng.choices(parts, k=rng.randint(1, 4)))

    def sentence(low=4, high=18):
        text = " ".join(word() for _ in range(rng.randint(low, high)))
        return text.capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(low=1, high=6):
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def link():
        return f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>'

    def links():
        return f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 8)))}</ul>" if rng.random() < 0.7 else " ".join(link() for _ in range(rng.randint(2, 8)))

    def names(pool):
        chosen = " ".join(rng.sample(pool, rng.choice([1, 1, 2])))
        return rng.choice([f' class="{chosen}"', f' id="{chosen.split()[0]}"', f' class="{chosen} {word()}"'])

    def other():
        kind = rng.random()
        if kind < 0.2:
            return f'<nav{rng.choice(["", names(OTHER_NAMES)])} data-y="0">{links()}</nav>'
        if kind < 0.3:
            return f'<aside{rng.choice(["", names(OTHER_NAMES)])} data-y="0"><h3>{sentence(1, 4)}</h3>{rng.choice([links(), f"<p>{prose(1, 3)}</p>"])}</aside>'
        if kind < 0.4:
            return f'<form{rng.choice(["", names(OTHER_NAMES)])} data-y="0"><p>{sentence()}</p><label>{word()}</label><input name="q"></form>'
        if kind < 0.6:
            tag = rng.choice(["section", "div", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
            name = rng.choice(["comments", "comment-list", "discussion", "responses comments", "replies", "reader-comments"])
            own = rng.choice(["", ' class="comment"'])
            body = "".join(f"<{item}{own}><p>{prose(1, 4)}</p></{item}>" if item != "p" else f"<p{own}>{prose(1, 4)}</p>" for _ in range(rng.randint(1, 5)))
            return f'<{tag} {rng.choice(["id", "class"])}="{name}" data-y="0">{rng.choice(["", f"<h3>{sentence(1, 3)}</h3>"]) if tag not in ("ol", "ul") else ""}{body}</{tag}>'
        tag = rng.choice(["div", "div", "div", "section", "p", "span div"]).split()[-1]
        body = rng.choice([links(), prose(1, 3), sentence(), f"<p>{prose(1, 3)}</p>" if tag != "p" else prose(1, 2), f"<h4>{sentence(1, 4)}</h4>{links()}" if tag != "p" else sentence()])
        hidden = rng.choice(["", "", "", ' style="display:none"', " hidden"])
        return f'<{tag}{names(OTHER_NAMES)}{hidden} data-y="0">{body}</{tag}>'

    def block():
        kind = rng.random()
        if kind < 0.6:
            text = prose()
            if rng.random() < 0.2:
                text = text.replace(" ", f" {link()} ", 1)
            if rng.random() < 0.15:
                text = f"<b>{sentence()}<br><p>{text}"
            return f"<p>{text}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.7:
            return f"<h{rng.randint(2, 4)}>{sentence(1, 6)}</h2>".replace("</h2>", "") + rng.choice(["<p>" + prose() + "</p>"]) if rng.random() < 0.2 else f"<h2>{sentence(1, 6)}</h2>"
        if kind < 0.78:
            return f"<{(t := rng.choice(['ul', 'ol']))}>{''.join(f'<li>{sentence(2, 12)}</li>' for _ in range(rng.randint(1, 5)))}</{t}>"
        if kind < 0.84:
            return f"<blockquote>{rng.choice([prose(1, 2), f'<p>{prose(1, 2)}</p>'])}</blockquote>"
        if kind < 0.88:
            return f"<pre>{sentence()}</pre>"
        if kind < 0.92:
            return f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>"
        if kind < 0.96:
            rows = "".join(f"<tr>{''.join(f'<td>{word()}</td>' for _ in range(3))}</tr>" for _ in range(rng.randint(1, 4)))
            return f"<table>{rows}</table>"
        return f"<div>{prose()}</div>"

    def content():
        blocks = [block() for _ in range(rng.randint(1, 10))]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            blocks.insert(rng.randint(0, len(blocks)), other())
        head = rng.choice([f"<h1>{sentence(2, 8)}</h1>", f"<h1>{sentence(2, 8)}</h1>", f"<header><h1>{sentence(2, 8)}</h1></header>", ""])
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        own = names(CONTENT_NAMES) if tag in ("div", "section") or rng.random() < 0.3 else ""
        inner = f'<{tag}{own} data-y="1">{head}{"".join(blocks)}</{tag}>'
        for _ in range(rng.choice([0, 0, 1, 2])):
            inner = f'<{(t := rng.choice(["div", "main", "section"]))}{rng.choice(["", names(["wrapper", "container", "page", "row", "layout", "site", "inner"])])} data-y="1">{inner}</{t}>'
        return inner

    pages = []
    for _ in range(count):
        before = [other() for _ in range(rng.choice([0, 1, 2, 3]))]
        if rng.random() < 0.5:
            before.insert(0, f'<header{rng.choice(["", names(["header", "masthead", "site-header", "branding"])])} data-y="0">{rng.choice(["", f"<h1>{sentence(1, 3)}</h1>", f"<p>{sentence(1, 5)}</p>"])}{links()}</header>')
        after = [other() for _ in range(rng.choice([0, 1, 2, 3]))]
        if rng.random() < 0.7:
            after.append(f'<footer{rng.choice(["", names(["footer", "site-footer"])])} data-y="0">{rng.choice(["&copy; ", "", "Copyright "])}{rng.choice([prose(1, 2), links(), sentence(1, 6)])}</footer>')
        pages.append(f"<html><head><title>{sentence()}</title></head><body>{''.join(before)}{content()}{''.join(after)}</body></html>")
    return pages


def _label(attributes: str):
    found = re.search(r'data-y="([01])"', attributes)
    return int(found[1]) if found else None


def trained_model(pages: list[str] | None = None) -> Model:
    """A model of labelled pages (those of ``labelled_pages`` unless given); text outside labelled parts is not content."""
    forest = Forest()
    for i, page in enumerate(labelled_pages() if pages is None else pages):
        parse(forest, i, page, _label)
    return train(forest)


def extract(pages: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of the main text of every row.

    White space inside a block becomes one space, and blocks are joined by one space in page order. A page without
    content, an empty or null html gives an empty text. Character references are decoded. Repeated rows are extracted
    each; other columns are not used.
    """

    def read(batches):
        for batch in chunks(batches, "html"):
            forest = Forest()
            for i, source in enumerate(batch.column("html").to_pylist()):
                if source:
                    parse(forest, i, source)
            texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
            if forest.parent:
                chance, _ = Graph(forest).marginals(model)
                for node in np.flatnonzero((np.array(forest.kind) == 1) & (chance >= threshold)):
                    texts[forest.page[node]].append(forest.text[node])
            joined = [" ".join(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(joined, pa.string()), pa.array(map(len, joined), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, read, "page_id long, url string, text string, n_chars long")
