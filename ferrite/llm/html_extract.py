"""Main-text extraction with a tree-structured graphical model over the DOM.

A page is parsed into block elements and the text blocks between their borders. Every node has a hidden label, content
or not. Node potentials come from the tag, the words of class, id and role, and a text block's length, links and
punctuation; an edge potential ties each parent to its child. Sum-product messages pass from the leaves to the root and
back, which gives exact marginals on a tree; text blocks with a content marginal of one half or more are the main text.
The weights maximise the conditional likelihood of labelled pages, whose gradient is the difference between observed
and expected features, by the same messages. The labelled pages come from ``labelled_pages``, a seeded generator.

Defined results: null, empty or textless pages give an empty text. Unclosed and stray tags, cut-off pages, unknown tags
and bare text are parsed as browsers would roughly do; a tag that never ends is dropped, with the rest of the page, which
is all its own. Quotes count only where a value begins, and one that never closes is part of the value. ``<br>`` is white space.
The head ends at its end tag, or at the first text or tag that no head holds. Formulas in ``<math>`` and ``<xmp>`` are text.
Nothing is dropped for length or depth: parsing and inference take time in proportion to the page. Repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Element kinds of HTML.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea template svg annotation annotation-xml iframe noembed noframes xmp".split())
#: What a head may hold; any other tag, or text, ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "optgroup"})}
#: Words of class, id and role names, by what they name.
WORDS = {
    "ad": "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner doubleclick",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topbar tabs skip",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay toast announcement warning newsletter subscribe subscription paywall",
    "side": "sidebar side aside related recommended recommendations widget widgets rail popular trending more also teaser",
    "share": "share sharing social follow twitter facebook tags meta byline author",
    "head": "header masthead logo brand branding hero",
    "foot": "footer foot copyright legal colophon bottom",
    "form": "form search login signup signin register contact contactform",
    "main": "content article post entry story main maincontent text body page prose articlebody contentinfo",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()} | {"contentinfo": "foot", "complementary": "side", "contentinfo": "foot"}
CONTAINERS = frozenset(f"tag={t}" for t in "article aside body div footer form header main nav section".split())
# A tag ends at the first ">" outside a quoted value, or with the page; no part of it can match in two ways.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")


@lru_cache(maxsize=100_000)
def _names(attributes: str) -> tuple[str, ...]:
    out = set()
    for name, value in _ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("name=hidden")
        elif name in ("class", "id", "role"):
            out.update(f"name={GROUP[w.lower()]}" for w in _CAMEL.split(value) if w.lower() in GROUP)
    return tuple(sorted(out))


@dataclass
class Page:
    """Nodes in page order, parents first. ``texts`` holds the text of text blocks, None for elements."""

    parents: list[int]
    features: list[tuple[str, ...]]
    texts: list[str | None]


def parse(source: str | None) -> Page:
    parents, features, texts = [-1], [("tag=root",)], [None]
    stack: list[tuple[str, int]] = [("root", 0)]
    depths: dict[str, list[int]] = {}  # where in the stack each tag is open
    parts: list[str] = []
    linked: list[str] = []
    state = {"a": 0}

    def flush() -> None:
        if not parts:
            return
        raw = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        links = sum(map(len, linked))
        linked.clear()
        if not text:
            return
        words, share = text.count(" ") + 1, links / max(1, len(raw))
        size = "1" if words < 3 else "2" if words < 10 else "3" if words < 30 else "4"
        link = "0" if links == 0 else "1" if share < 0.3 else "2" if share < 0.7 else "3"
        f = [f"words={size}", f"link={link}", "end=1" if _SENTENCE.search(text) else "end=0"]
        if "©" in text or "all rights reserved" in text.lower():
            f.append("rights")
        parents.append(stack[-1][1])
        features.append(tuple(f))
        texts.append(text)

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def pop_to(depth: int) -> None:
        """Close the elements from this depth on; 0 closes none."""
        if not depth:
            return
        flush()
        state["a"] = 0
        for tag, _ in stack[depth:]:
            depths[tag].pop()
        del stack[depth:]

    at, src = 0, source or ""
    in_head = False
    while at < len(src):
        m = _TOKEN.search(src, at)
        begin = m.start() if m else len(src)
        if begin > at and not (in_head and src[at:begin].isspace()):
            in_head = False
            piece = src[at:begin]
            parts.append(piece)
            if state["a"]:
                linked.append(piece)
        if m is None:
            break
        at = m.end()
        if m.group(2) is None or not m.group(4):
            continue
        tag, closing, attributes = m.group(2).lower(), m.group(1), m.group(3)
        if tag == "head":
            in_head = not closing
            continue
        if in_head and (tag not in HEAD and not closing or closing and tag in ("body", "html", "br")):
            in_head = False
        if (tag in RAW or in_head and tag == "noscript") and not closing:
            if not attributes.endswith("/"):
                inside = at
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(src, at)
                at = end.end() if end else len(src)
                if tag == "xmp":
                    parts.append(f" {html.escape(src[inside : end.start() if end else len(src)])} ")
            if tag in ("textarea", "iframe"):
                parts.append(" ")
            continue
        if in_head:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            state["a"] = 0 if closing else 1
        elif closing:
            pop_to(deepest((tag,)))
        elif tag in BLOCKS and tag not in VOID and tag != "html":
            if tag in P_CLOSERS:
                pop_to(deepest(("p",)))
            if tag in IMPLIED:
                closes, stops = IMPLIED[tag]
                while (depth := deepest(closes)) > deepest(stops - closes):
                    pop_to(depth)
                    if tag != "tr" or not depths.get("tr"):
                        break
            flush()
            if tag == "body" and depths.get("body"):
                continue
            own = f"tag={tag}/article" if tag in ("header", "footer", "section") and depths.get("article") else f"tag={tag}"
            parents.append(stack[-1][1])
            features.append((own, *_names(attributes), f"tag={tag}<{stack[-1][0]}"))
            texts.append(None)
            if not attributes.endswith("/"):
                depths.setdefault(tag, []).append(len(stack))
                stack.append((tag, len(parents) - 1))
        elif tag == "hr":
            pop_to(deepest(("p",)) or len(stack))
    flush()
    return Page(parents, features, texts)


@dataclass
class TreeModel:
    """Log-potentials: one weight per feature for the label content, four per kind of edge."""

    node: dict[str, float]
    edge: dict[str, list[float]]  # kind -> [00, 01, 10, 11], parent's label first

    def marginals(self, page: Page) -> tuple[list[float], list[list[float]]]:
        """Exact P(content) of each node and, for each node but the root, the pairwise marginals with its parent."""
        n, node = len(page.parents), self.node
        psi = {k: [math.exp(x) for x in w] for k, w in self.edge.items()}
        flat = [1.0] * 4
        up0, up1 = [1.0] * n, [1.0] * n
        msg: list[tuple[float, float]] = [(1.0, 1.0)] * n
        kinds = [psi.get(_edge_kind(page, i), flat) for i in range(n)]
        for i in range(n):
            s = 0.0
            for f in page.features[i]:
                s += node.get(f, 0.0)
            up1[i] = math.exp(min(30.0, max(-30.0, s)))
        for i in range(n - 1, 0, -1):  # children come after parents
            a, b = up0[i], up1[i]
            t = a + b
            a, b = a / t, b / t
            up0[i], up1[i] = a, b
            e = kinds[i]
            m0, m1 = e[0] * a + e[1] * b, e[2] * a + e[3] * b
            t = m0 + m1
            msg[i] = m0, m1 = m0 / t, m1 / t
            p = page.parents[i]
            up0[p] *= m0
            up1[p] *= m1
            t = up0[p] + up1[p]
            up0[p] /= t
            up1[p] /= t
        t = up0[0] + up1[0]
        belief = [up1[0] / t] + [0.0] * (n - 1)
        pair: list[list[float]] = [[]] * n
        for i in range(1, n):
            p = page.parents[i]
            # The parent's belief without what this child sent.
            q0, q1 = (1 - belief[p]) / max(msg[i][0], 1e-300), belief[p] / max(msg[i][1], 1e-300)
            e = kinds[i]
            j = [q0 * e[0] * up0[i], q0 * e[1] * up1[i], q1 * e[2] * up0[i], q1 * e[3] * up1[i]]
            t = sum(j)
            pair[i] = j = [x / t for x in j]
            belief[i] = min(1.0, max(0.0, j[1] + j[3]))
        return belief, pair

    def extract(self, source: str | None) -> str:
        page = parse(source)
        belief, _ = self.marginals(page)
        return "\n".join(t for t, p in zip(page.texts, belief, strict=True) if t is not None and p >= 0.5)


def labelled_pages(n: int = 320, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(html, texts of the content blocks) of n invented pages; block texts are unique within a page."""
    r = random.Random(seed)
    count = 0

    def words(low: int, high: int) -> str:
        nonlocal count
        count += 1
        body = ["".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 8))) for _ in range(r.randint(low, high))]
        if r.random() < 0.15:
            body = [w.upper() + "!!" for w in body]
        return " ".join([f"w{count}", *body]) + r.choice([".", ".", "", "!"])

    def name(group: str) -> str:
        w = r.choice(WORDS[group].split())
        return r.choice([f' class="{w}"', f' id="{w}"', f' class="x1 {w}-box"', f' class="{w}" id="b{r.randint(1, 9)}"'])

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(0, 2)}</a></li>' for i in range(k))

    out = []
    for _ in range(n):
        content: list[str] = []

        def good(low: int = 0, high: int = 40) -> str:
            t = words(low, high)
            content.append(t)
            return t

        def clutter() -> str:
            return r.choice(
                [
                    lambda: f"<div{name('ad')}>{words(1, 25)}</div>",
                    lambda: f"<aside>{words(2, 25)}<ul>{links(2)}</ul></aside>",
                    lambda: f"<div{name('side')}><h3>{words(1, 3)}</h3><p>{words(4, 30)}</p><ul>{links(3)}</ul></div>",
                    lambda: f"<div{name('share')}><a href='#'>{words(0, 1)}</a> <a href='#'>{words(0, 1)}</a></div>",
                    lambda: f"<div{name('notice')}><p>{words(4, 30)}</p><button>{words(0, 1)}</button></div>",
                    lambda: f"<form action='/s'><label>{words(0, 3)}</label><p>{words(2, 12)}</p><button>{words(0, 1)}</button></form>",
                    lambda: f"<nav><ul>{links(r.randint(1, 5))}</ul></nav>",
                    lambda: f"<div{name('nav')}><ul>{links(3)}</ul></div>",
                    lambda: f"<div{name('form')}><p>{words(2, 10)}</p></div>",
                    lambda: f"<div hidden><p>{words(3, 20)}</p></div>",
                ]
            )()

        def body() -> str:
            if r.random() < 0.12:
                return f"<p>{good(1, 30)}</p>"
            parts = []
            if r.random() < 0.9:
                title = f"<h1>{good(2, 9)}</h1>"
                parts.append(r.choice([title, title, f"<header>{title}</header>"]))
            for _ in range(r.randint(1, 9)):
                parts.append(
                    r.choices(
                        [
                            lambda: f"<p>{good()}</p>",
                            lambda: f"<p><b>{good()}<br>",
                            lambda: f"<p>{good(0, 2)}",
                            lambda: f"<h2>{good(1, 5)}</h2><p>{good(10, 50)}</p>",
                            lambda: "<ul>" + "".join(f"<li>{good(0, 14)}</li>" for _ in range(r.randint(1, 4))) + "</ul>",
                            lambda: f"<blockquote><p>{good(4, 30)}</p></blockquote>",
                            lambda: f"<section><h3>{good(1, 4)}</h3><p>{good(5, 40)}</p></section>",
                            lambda: f"<div><p>{good(3, 30)}</p></div>",
                            lambda: f"<table><tr><td>{good(0, 5)}</td><td>{good(0, 5)}</td></tr></table>",
                            lambda: f"<figure><img src=x><figcaption>{good(2, 10)}</figcaption></figure>",
                            lambda: f"<pre>{good(2, 20)}</pre>",
                            clutter,
                        ],
                        weights=[10, 4, 3, 3, 2, 1, 2, 2, 1, 1, 1, 3],
                    )[0]()
                )
            return "".join(parts)

        def comments() -> str:
            one = r.choice(["<div class='comment'><p>{}</p></div>", "<li><p>{}</p></li>", "<article><p>{}</p></article>", "<p>{}</p>"])
            inner = "".join(one.format(words(1, 45)) for _ in range(r.randint(1, 4)))
            box = r.choice([f"<section{name('comment')}>{{}}</section>", f"<div{name('comment')}>{{}}</div>", f"<div{name('comment')}><ul>{{}}</ul></div>"])
            return box.format(f"<h3>{words(0, 2)}</h3>" + inner)

        wrap = r.choices(["<article>{}</article>", "<div" + name("main") + "><article>{}</article></div>", "<main><article>{}</article></main>", "<main>{}</main>", "<div" + name("main") + ">{}</div>", "{}"], weights=[6, 3, 4, 2, 3, 1])[0]
        top = [r.choice([f"<header><a href='/'>{words(0, 2)}</a><p>{words(1, 8)}</p></header>", f"<div{name('head')}>{words(1, 6)}</div>", ""]), r.choice([f"<nav><ul>{links(r.randint(1, 8))}</ul></nav>", f"<div{name('nav')}><ul>{links(4)}</ul></div>", ""])]
        top += [clutter() for _ in range(r.randint(0, 2))]
        main = wrap.format(body())
        inside = r.random() < 0.3 and "</article>" in main
        low = [comments()] if r.random() < 0.4 else []
        if inside and low:
            k = main.rindex("</article>")
            main, low = main[:k] + low[0] + main[k:], []
        low += [clutter() for _ in range(r.randint(0, 2))]
        low.append(r.choice([f"<footer>&copy; {words(2, 20)}</footer>", f"<footer><p>{words(2, 30)}</p><ul>{links(2)}</ul></footer>", f"<div{name('foot')}>{words(2, 20)}</div>", ""]))
        if r.random() < 0.12:
            out.append((main, content))  # a fragment
            continue
        out.append((f"<html><head><title>{words(1, 3)}</title></head><body>{''.join(top)}{main}{''.join(low)}</body></html>", content))
    return out


def _edge_kind(page: Page, i: int) -> str:
    """Kind of the edge above node i: a text block's, a paragraph-like element's or a container's."""
    if page.texts[i] is not None:
        return "text"
    return "container" if page.features[i][0] in CONTAINERS else "element"


def label(page: Page, content: list[str]) -> list[int]:
    """Observed labels: text blocks by their text, elements by whether all text below them is content."""
    good = set(content)
    n = len(page.parents)
    some, all_good = [False] * n, [True] * n
    for i in range(n - 1, -1, -1):
        if page.texts[i] is not None:
            some[i], all_good[i] = True, page.texts[i] in good
        if i:
            p = page.parents[i]
            some[p] |= some[i]
            all_good[p] &= all_good[i] or not some[i]
    y = [int(some[i] and all_good[i]) for i in range(n)]
    for i in range(n):  # the element that holds most content is content itself, whatever clutter it also holds
        if page.texts[i] is None and not y[i]:
            below = [k for k in range(n) if page.parents[k] == i]
            if (page.features[i][0] in ("tag=article", "tag=main") or "name=main" in page.features[i]) and any(y[k] for k in below):
                y[i] = 1
    return y


def train(pages: list[tuple[str, list[str]]], epochs: int = 80, rate: float = 0.5, decay: float = 1e-3) -> TreeModel:
    """Adaptive gradient ascent on the exact conditional log-likelihood."""
    data = []
    for source, content in pages:
        page = parse(source)
        data.append((page, label(page, content)))
    model = TreeModel({}, {"text": [0.0] * 4, "element": [0.0] * 4, "container": [0.0] * 4})
    norm: dict = {}
    for _ in range(epochs):
        grad: dict = {}
        for page, y in data:
            belief, pair = model.marginals(page)
            for i, p in enumerate(belief):
                d = y[i] - p
                if abs(d) > 1e-6:
                    for f in page.features[i]:
                        grad[f] = grad.get(f, 0.0) + d
                if i:
                    kind = _edge_kind(page, i)
                    seen = 2 * y[page.parents[i]] + y[i]
                    for k in range(4):
                        grad[kind, k] = grad.get((kind, k), 0.0) + (k == seen) - pair[i][k]
        for key, g in grad.items():
            g /= len(data)
            old = model.edge[key[0]][key[1]] if isinstance(key, tuple) else model.node.get(key, 0.0)
            g -= decay * old
            norm[key] = norm.get(key, 0.0) + g * g
            new = old + rate * g / (math.sqrt(norm[key]) + 1e-8)
            if isinstance(key, tuple):
                model.edge[key[0]][key[1]] = new
            else:
                model.node[key] = new
    return model


@lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return train(labelled_pages())


def extract(pages: DataFrame, model: TreeModel | None = None, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row."""
    common.python_ready(pages.sparkSession)
    m = model or default_model()
    node, edge = m.node, m.edge
    narrow = pages.select(F.col(key), F.col(url), F.col(source).alias("_html"))

    def work():
        model = TreeModel(node, edge)

        def compute(sources: list) -> list[pa.Array]:
            found = [model.extract(h) for h in sources]
            return [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]

        return compute

    return common.map_column(narrow, "_html", "text string, n_chars bigint", work)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every page's main text."""
    return extract(common.table(spark, sf_dir, "pages"))
