"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable: content or not. A log-linear potential on each node looks at
its tag, class words and text; a potential on each parent-child edge ties their labels. Sum-product
messages pass from the leaves to the root and back, for all pages of a batch at once, and give each
node's content marginal. The same messages give the gradient of the likelihood of labelled pages.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .cluster import numbered, renumbered

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# HTML's element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mpadded mfenced semantics annotation tspan".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSHOWN = frozenset("head script style textarea title template iframe object select button datalist canvas audio video".split())
#: What may stand in a head; anything else ends one that was left open.
IN_HEAD = frozenset("html head base link meta title style script noscript template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
TAGS = "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table caption thead tbody tr th td blockquote pre figure figcaption address details".split()
#: Words in class, id and role attributes that say what an element is for.
HINTS = {
    "content": "article content post entry main story text body prose copy",
    "advert": "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs",
    "remarks": "comment comments reply replies respond disqus discussion feedback",
    "side": "sidebar aside related recommend recommended widget rail popular trending more",
    "notice": "cookie cookies consent notice banner popup modal overlay newsletter subscribe subscription alert gdpr",
    "edge": "header footer copyright legal colophon masthead topbar bottom",
    "share": "social share sharing follow tags author byline meta login search signup form",
}
_HINT = {w: k for k, words in enumerate(HINTS.values()) for w in words.split()}
EDGES = ("section", "text", "list", "other")
_EDGE = {t: 0 for t in "main article section div body th td tr tbody thead table header footer aside nav form fieldset details".split()}
_EDGE |= {t: 1 for t in "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address".split()}
_EDGE |= {t: 2 for t in "ul ol li dl dt dd".split()}
WIDTH = 1 + len(TAGS) + len(HINTS) + 9
MARK = "data-content"


@dataclass
class Page:
    """The block elements of a page in document order, and the text blocks with the element each stands in."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    hints: list[frozenset[int]] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(text: str | None) -> Page:
    """Read a page; unclosed and stray tags are taken as browsers take them, roughly."""
    page, source = Page(), text or ""

    def add(tag: str, attributes: str, parent: int) -> int:
        seen = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        named = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(seen.get(k, "") for k in ("class", "id", "role", "aria-label"))).lower())
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.tag.append(tag)
        page.hints.append(frozenset(_HINT[w] for w in named if w in _HINT))
        page.marked.append(int(seen[MARK]) if seen.get(MARK) in ("0", "1") else -1)
        for column in (page.chars, page.words, page.linked, page.stops):
            column.append(0)
        return len(page.parent) - 1

    stack: list[tuple[str, int]] = [("html", add("html", "", -1))]
    pieces: list[str] = []
    links, link_chars, hidden = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            block = " ".join("".join(pieces).split())
            pieces.clear()
            if block:
                at = stack[-1][1]
                page.blocks.append((at, block))
                page.chars[at] += len(block)
                page.words[at] += block.count(" ") + 1
                page.linked[at] += min(link_chars, len(block))
                page.stops[at] += sum(map(block.count, ".,;:!?"))
            link_chars = 0

    def close(k: int) -> None:
        nonlocal hidden
        hidden -= sum(t in UNSHOWN for t, _ in stack[k:])
        del stack[k:]

    def implied(tag: str) -> None:
        """End a head that was left open, and begin a body that was left out."""
        if stack[-1][0] == "head":
            close(len(stack) - 1)
        if stack[-1][0] == "html" and tag != "body":
            stack.append(("body", add("body", "", stack[-1][1])))

    at = 0
    while True:
        m = _TAG.search(source, at)
        chunk = source[at : m.start()] if m else source[at:]
        if chunk.strip():
            implied("")
        if chunk and not hidden:
            shown = html.unescape(chunk) if "&" in chunk else chunk
            pieces.append(shown)
            if links:
                link_chars += len(shown.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not ends and tag not in IN_HEAD:
            implied(tag)
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if ends else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        if ends:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k:
                close(k)
            continue
        if tag == "html" or (tag == "body" and any(t == "body" for t, _ in stack)):
            continue
        if tag in CLOSES_P and any(t == "p" for t, _ in stack):
            close(next(k for k in range(len(stack)) if stack[k][0] == "p"))
        elif tag in ENDED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in LISTS[tag]:
                    break
                if stack[k][0] in ENDED_BY[tag]:
                    close(k)
                    break
        elif tag == "body" and hidden:
            close(1)
        if tag in RAW:
            e = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = e.end() if e else len(source)
            continue
        if attributes.rstrip().endswith("/") and tag not in TAGS:
            continue
        links = 0
        hidden += tag in UNSHOWN
        stack.append((tag, add(tag, attributes, stack[-1][1])))
    flush()
    return page


class Forest:
    """Pages as one array of nodes, with features, and the nodes of each depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        self.starts = np.cumsum([0, *sizes]).tolist()
        shift = np.repeat(self.starts[:-1], sizes)
        flat = lambda name: np.array([x for p in pages for x in getattr(p, name)])
        parent, self.depth = flat("parent"), flat("depth")
        self.parent = np.where(parent < 0, -1, parent + shift)
        self.levels = [np.flatnonzero(self.depth == d) for d in range(int(self.depth.max(initial=0)) + 1)]
        tags = [t for p in pages for t in p.tag]
        self.edge = np.array([_EDGE.get(t, 3) for t in tags])
        self.marked = flat("marked")
        chars, words, linked, stops = (flat(x).astype(float) for x in ("chars", "words", "linked", "stops"))
        below, below_linked = chars.copy(), linked.copy()
        for nodes in self.levels[:0:-1]:
            np.add.at(below, self.parent[nodes], below[nodes])
            np.add.at(below_linked, self.parent[nodes], below_linked[nodes])
        whole = np.maximum(1.0, np.repeat(below[self.starts[:-1]], sizes))
        x = np.zeros((len(tags), WIDTH))
        x[:, 0] = 1
        place = {t: 1 + k for k, t in enumerate(TAGS)}
        for i, t in enumerate(tags):
            if t in place:
                x[i, place[t]] = 1
        for i, h in enumerate(h for p in pages for h in p.hints):
            for k in h:
                x[i, 1 + len(TAGS) + k] = 1
        k = 1 + len(TAGS) + len(HINTS)
        x[:, k] = np.log1p(words) / 4
        x[:, k + 1] = linked / np.maximum(1, chars)
        x[:, k + 2] = below_linked / np.maximum(1, below)
        x[:, k + 3] = np.minimum(1, 4 * stops / np.maximum(1, words))
        x[:, k + 4] = chars == 0
        x[:, k + 5] = below / whole
        x[:, k + 6] = (words > 0) & (words < 6)
        x[:, k + 7] = words >= 25
        x[:, k + 8] = below == 0
        self.features = x

    def messages(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each node gathers from below, with its own potential; what reaches it from above; and what it sends up.

        unary: (nodes, 2) and edges: (kinds, parent label, child label) are log potentials.
        """
        inside, up = unary.copy(), np.zeros_like(unary)
        for nodes in self.levels[:0:-1]:
            up[nodes] = np.logaddexp.reduce(inside[nodes][:, None, :] + edges[self.edge[nodes]], axis=2)
            up[nodes] -= up[nodes].max(axis=1, keepdims=True)
            np.add.at(inside, self.parent[nodes], up[nodes])
        down = np.zeros_like(unary)
        for nodes in self.levels[1:]:
            rest = (inside + down)[self.parent[nodes]] - up[nodes]
            down[nodes] = np.logaddexp.reduce(rest[:, :, None] + edges[self.edge[nodes]], axis=1)
            down[nodes] -= down[nodes].max(axis=1, keepdims=True)
        return inside, down, up

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
        unary = np.stack([np.zeros(len(self.parent)), self.features @ weights], axis=1)
        inside, down, _ = self.messages(unary, edges)
        both = inside + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


@dataclass(frozen=True)
class ContentModel:
    weights: np.ndarray
    edges: np.ndarray

    def extract(self, pages: list[str | None]) -> list[tuple[str, float]]:
        """Each page's main text, and the least content marginal of its blocks (1 if none)."""
        parsed = [parse(p) for p in pages]
        if not parsed:
            return []
        forest = Forest(parsed)
        content = forest.marginals(self.weights, self.edges)
        out = []
        for start, page in zip(forest.starts, parsed, strict=False):
            taken = [(content[start + at], block) for at, block in page.blocks if content[start + at] >= 0.5]
            out.append(("\n".join(b for _, b in taken), float(min((c for c, _ in taken), default=1.0))))
        return out


def train(labelled: Iterable[str], *, rounds: int = 300, rate: float = 0.1, pull: float = 0.003) -> ContentModel:
    """Fit the potentials to pages whose elements carry data-content="1" or "0"; others take their parent's mark.

    Gradient ascent with momentum-scaled steps on the likelihood of the marks, less `pull` times the squared weights.
    """
    forest = Forest([parse(p) for p in labelled])
    y = forest.marked.copy()
    for nodes in forest.levels:
        bare = nodes[y[nodes] < 0]
        y[bare] = np.where(forest.parent[bare] < 0, 0, y[forest.parent[bare]])
    inner = np.flatnonzero(forest.parent >= 0)
    pair = np.zeros((len(EDGES), 2, 2))
    np.add.at(pair, (forest.edge[inner], y[forest.parent[inner]], y[inner]), 1)
    weights, edges = np.zeros(WIDTH), np.zeros((len(EDGES), 2, 2))
    state = [np.zeros(WIDTH), np.zeros(WIDTH), np.zeros_like(edges), np.zeros_like(edges)]
    for t in range(1, rounds + 1):
        unary = np.stack([np.zeros(len(y)), forest.features @ weights], axis=1)
        inside, down, up = forest.messages(unary, edges)
        both = inside + down
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        joint = both[forest.parent[inner]][:, :, None] - up[inner][:, :, None] + edges[forest.edge[inner]] + inside[inner][:, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(inner), 4), axis=1)[:, None, None])
        expected = np.zeros_like(edges)
        np.add.at(expected, forest.edge[inner], joint)
        scale = max(1, len(forest.starts) - 1)
        grads = (forest.features.T @ (y - p) / scale - pull * weights, (pair - expected) / scale - pull * edges)
        for k, (value, grad) in enumerate(zip((weights, edges), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * grad * grad
            value += rate * (state[2 * k] / (1 - 0.9**t)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
    return ContentModel(weights, edges)


def labelled_pages(count: int = 320, seed: int = 11) -> list[str]:
    """Labelled pages in many layouts, made by rule: the marks are known because the page is built around its content."""
    rng = random.Random(seed)
    syllables = "ba co du fe gi lo mu na pe ri so tu va we xi yo za ker lim not".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 20) -> str:
        return words(low, high).capitalize() + rng.choice(".....?!")

    def prose(low: int = 1, high: int = 8) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def named(names: str) -> str:
        return rng.choice(("class", "id", "class")) + f'="{rng.choice(names.split())}{rng.choice(["", "", "-1", " wide", " box"])}"'

    def content(most: int = 12) -> str:
        out = [f"<h1>{words(2, 10).capitalize()}</h1>"] if rng.random() < (0.85 if most > 3 else 0.3) else []
        for _ in range(rng.randint(1, most)):
            kind = rng.random()
            if kind < 0.72:
                inner = sentence(1, 3) if rng.random() < 0.15 else prose()
                if rng.random() < 0.2:
                    inner = f"<b>{inner}<br>" if rng.random() < 0.5 else f'{inner} <a href="/x">{words(1, 4)}</a> {sentence()}'
                out.append(f"<p>{inner}" + ("</p>" if rng.random() < 0.9 else ""))
            elif kind < 0.8:
                out.append(f"<h{rng.randint(2, 4)}>{words(1, 8).capitalize()}</h2>" if rng.random() < 0.1 else f"<h2>{words(1, 8).capitalize()}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{prose(1, 3)}</p></blockquote>")
            elif kind < 0.92:
                heads = f"<tr><th>{words(1, 3)}</th><th>{words(1, 3)}</th></tr>" if rng.random() < 0.5 else ""
                side = "th" if rng.random() < 0.4 else "td"
                inner = heads + "".join(f"<tr><{side}>{words(1, 3)}</{side}><td>{words(1, 3)}</td></tr>" for _ in range(3))
                inner = f"<caption>{words(1, 5)}</caption>{inner}" if rng.random() < 0.3 else inner
                out.append("<table>" + (f"<tbody>{inner}</tbody>" if rng.random() < 0.3 else inner) + "</table>")
            elif kind < 0.95:
                out.append(f"<pre>{words(5, 20)}</pre>")
            else:
                out.append(f'<div {named("ad ads advert sponsor promo ad-slot")} {MARK}="0">{prose(1, 2)}</div>')
        return "".join(out)

    def loose() -> str:
        """Text that stands in its element without blocks of its own."""
        return "<br><br>".join(prose(2, 8) for _ in range(rng.randint(1, 5)))

    def off(tag: str, attributes: str, inner: str) -> str:
        return f'<{tag} {attributes} {MARK}="0">{inner}</{tag}>'

    def page() -> str:
        menu = off(rng.choice(("nav", "nav", "div")), named("nav menu navbar main-nav topmenu breadcrumb"), f"<ul>{links(rng.randint(2, 9))}</ul>")
        before = [menu] if rng.random() < 0.9 else []
        if rng.random() < 0.4:
            before.insert(0, off("header", named("header masthead top"), f"<h2>{words(1, 4)}</h2><p>{sentence()}</p>" if rng.random() < 0.5 else words(1, 5)))
        if rng.random() < 0.35:
            before.append(off("div", named("cookie-notice consent banner newsletter popup gdpr"), f"<p>{prose(1, 3)}</p>" if rng.random() < 0.5 else prose(1, 2)))
        if rng.random() < 0.15:
            before.append(off("noscript", "", sentence(4, 12)))
        if rng.random() < 0.5:
            before.append(off("div", named("ad ads advert sponsor promo"), prose(1, 2)))
        after = []
        if rng.random() < 0.4:
            after.append(off(rng.choice(("aside", "div")), named("sidebar related widget recommended popular"), f"<h3>{words(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul>" if rng.random() < 0.6 else f"<p>{prose(1, 4)}</p>"))
        if rng.random() < 0.35:
            remarks = "".join(f'<div class="{rng.choice(("comment", "reply", "item"))}"><p>{prose(1, 4)}</p></div>' if rng.random() < 0.6 else f"<li>{prose(1, 3)}</li>" for _ in range(rng.randint(1, 5)))
            after.append(off(rng.choice(("section", "div", "ol")), named("comments comment-list replies discussion"), f"<h3>{words(1, 3)}</h3>{remarks}"))
        if rng.random() < 0.3:
            after.append(off("form", named("search login subscribe signup contact"), f"<p>{sentence(2, 8)}</p><label>{words(1, 2)}</label><input><button>{words(1, 2)}</button>"))
        if rng.random() < 0.85:
            foot = f"&copy; {words(1, 3)} &middot; {sentence()}" if rng.random() < 0.6 else f"<p>{prose(1, 2)}</p><ul>{links(rng.randint(1, 5))}</ul>"
            after.append(off(rng.choice(("footer", "footer", "div")), named("footer copyright legal page-footer"), foot))
        if rng.random() < 0.25:
            rng.shuffle(before)
        if rng.random() < 0.2:  # little but the article
            tag = rng.choice(("article", "article", "main", "div", "body"))
            inner = loose() if tag == "body" or rng.random() < 0.2 else content(3)
            most = f'<{tag} {MARK}="1">{inner}</{tag}>'
            if rng.random() < 0.4:
                most = "".join(before[:1]) + most if tag != "body" else most.replace(">", ">" + "".join(before[:1]), 1)
            return most if rng.random() < 0.4 or tag == "body" else f"<html><head><title>{words(1, 5)}</title></head><body>{most}{''.join(after[-1:])}</body></html>"
        if rng.random() < 0.14:
            inner = loose() if rng.random() < 0.7 else f"{loose()}{content()}"
            return f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body {MARK}="1">{"".join(before)}{inner}{"".join(after)}</body></html>'
        shell = rng.choice(("article", "article", "article", "main", "section", "div", "div", "div", "td"))
        extra = named("content post entry article-body story main-text") if shell in ("section", "div", "td") and rng.random() < 0.8 else (named("post article entry") if rng.random() < 0.3 else "")
        body = f'<{shell} {extra} {MARK}="1">{loose() if rng.random() < 0.08 else content()}'
        if rng.random() < 0.15:
            body += off("div", named("share social tags author-box byline"), f"<p>{sentence(2, 6)}</p>")
        body += f"</{shell}>"
        if shell == "td":
            body = f"<table><tr>{body}</tr></table>"
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(("wrap", "page", "container", "row"))}">{body}{"".join(after[:1])}</div>' + "".join(after[1:])
        else:
            body += "".join(after)
        return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{''.join(before)}{body}</body></html>"

    return [page() for _ in range(count)]


def default_model() -> ContentModel:
    return train(labelled_pages())


def extract(pages: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points), and confidence: the least content marginal among the blocks taken.

    A null or empty html has empty text. White space inside a block is one space, blocks follow in page
    order, one to a line. A very long page is read whole, as one tree. A block whose marginal is exactly
    one half is taken. Repeated rows are read each for itself; null ids and urls stay null; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    fitted = model or default_model()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 200):
                part = batch.iloc[low : low + 200]
                got = fitted.extract(part["html"].tolist())
                yield pd.DataFrame({
                    "page_id": part["page_id"], "no_id": part["no_id"], "url": part["url"], "text": [g[0] for g in got],
                    "n_chars": [len(g[0]) for g in got], "confidence": [g[1] for g in got],
                })

    rows = numbered(pages, "page_id", url="string", html="string")
    return renumbered(rows.mapInPandas(read, "page_id long, no_id boolean, url string, text string, n_chars long, confidence double"), "page_id")
