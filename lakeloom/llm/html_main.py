"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node that is content or not. Node potentials come from its tag, class words, text
and links, edge potentials couple it to its parent. Sum-product messages run up the tree and down
again, which gives each node's exact marginal; the text of the nodes that are likelier content than not is
the page's main text. Potentials are trained from labelled pages, by default those of `labelled_pages`.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role, and words of class, id and role attributes.
RAW = ["script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "select", "object", "canvas", "math"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
INLINE = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "button", "img", "wbr", "input", "picture", "source", "nobr"]
SHELL_TAGS = ["nav", "footer", "aside", "header", "form", "dialog", "menu", "fieldset"]
MAIN_TAGS = ["article", "main"]
SHELL_WORDS = ["nav", "navbar", "navigation", "menu", "header", "masthead", "banner", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "promo", "sponsor", "sponsored", "notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "form", "search", "login", "comment", "comments", "commentlist", "reply", "replies", "discussion", "respond", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "copyright", "legal", "disclaimer", "toolbar", "complementary", "contentinfo", "gdpr", "trending", "teaser", "toc", "tags", "skip"]
MAIN_WORDS = ["article", "content", "post", "entry", "main", "story", "body", "text", "page"]

_RAW, _VOID, _INLINE = set(RAW), set(VOID), set(INLINE)
_SHELL, _MAIN = set(SHELL_WORDS), set(MAIN_WORDS)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_LETTERS = re.compile(r"[a-z]+")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
KINDS = [["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["li", "dd", "dt"], ["td", "th"], ["blockquote", "pre", "figcaption"], ["ul", "ol", "dl", "table"], ["div", "section"], SHELL_TAGS, MAIN_TAGS, ["html", "body"]]
_KIND = {t: k for k, tags in enumerate(KINDS) for t in tags}
FEATURES = len(KINDS) + 13
#: Elements nested deeper lie beside each other, as in browsers; their text stays.
DEPTH = 500


class Page:
    """Block elements in document order, and the text blocks with the element that holds each."""

    __slots__ = ("parent", "tag", "names", "hidden", "depth", "blocks")

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.hidden, self.depth = [-1], ["html"], [""], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, words in links
        self._read(source)

    def _read(self, source: str) -> None:
        stack, pieces, linked, anchors, at = [0], [], 0, 0, 0
        n_anchor = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                pieces.clear()
            linked = 0

        size, last = len(source), source.rfind(">") + 1  # no tag ends after `last`, so none is looked for there
        opened: dict[str, int] = {}  # how many elements of a name are on the stack

        def close(k: int) -> None:
            for e in stack[k:]:
                opened[self.tag[e]] -= 1
            del stack[k:]

        while at < size:
            m = _TOKEN.search(source, at, last) if at < last else None
            end = m.start() if m else size
            if not m and (comment := source.find("<!--", at)) >= 0:
                end = comment
            if end > at:
                piece = source[at:end]
                pieces.append(piece)
                if anchors:
                    linked += len(piece.split())
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = size
                continue
            name, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] if m[2] else m[6]
            if name in _RAW and not closing:
                if not attrs.endswith("/"):
                    stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = stop.end() if stop else size
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name in _INLINE:
                if name == "a":
                    anchors = 0 if closing else 1
                    n_anchor += not closing
                continue
            flush()
            if name in _VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1) if opened.get(name) else ():
                    if self.tag[stack[k]] == name:
                        close(k)
                        break
                anchors = 0
                continue
            if self.tag[stack[-1]] == "p":
                close(len(stack) - 1)
            if any(opened.get(x) for x in _CLOSES.get(name, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in _CLOSES[name]:
                        close(k)
                        break
                    if self.tag[stack[k]] in _SCOPES[name]:
                        break
            if len(stack) >= DEPTH:
                close(len(stack) - 1)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.tag.append(name)
            opened[name] = opened.get(name, 0) + 1
            self.names.append(" ".join(filter(None, (a or b or c for a, b, c in _NAMES.findall(attrs)))) if attrs else "")
            self.hidden.append(bool(attrs and _HIDDEN.search(attrs)))
            stack.append(len(self.tag) - 1)
        flush()


@lru_cache(4096)
def _name_flags(names: str) -> tuple[bool, bool]:
    found = set(_LETTERS.findall(names.lower()))
    return bool(found & _SHELL), bool(found & _MAIN)


def forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parent or -1, depth, first node of each page, features) of all pages' nodes."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    parent = np.array([q + f if q >= 0 else -1 for p, f in zip(pages, first) for q in p.parent], np.int64)
    depth = np.array([d for p in pages for d in p.depth], np.int64)
    x = np.zeros((n, FEATURES))
    k = len(KINDS)
    x[np.arange(n), [_KIND.get(t, 6) for p in pages for t in p.tag]] = 1
    x[:, k : k + 2] = [_name_flags(s) for p in pages for s in p.names]
    x[:, k + 2] = [h for p in pages for h in p.hidden]
    words, links, own, copy = (np.zeros(n) for _ in range(4))
    for p, f in zip(pages, first.tolist()):
        for e, text, linked in p.blocks:
            e += f
            own[e] += text.count(" ") + 1
            links[e] += linked
            copy[e] += text[0] == "©" or "copyright" in text[:40].lower()
    words[:] = own
    for at in _levels(depth)[:0:-1]:  # sums over subtrees
        np.add.at(words, parent[at], words[at])
        np.add.at(links, parent[at], links[at])
    share = links / np.maximum(words, 1)
    x[:, k + 3], x[:, k + 4], x[:, k + 5] = share > 0.6, (share > 0.25) & (share <= 0.6), words == 0
    x[:, k + 6], x[:, k + 7], x[:, k + 8] = (words > 0) & (words <= 4), (words > 4) & (words <= 20), words > 60
    x[:, k + 9], x[:, k + 10], x[:, k + 11], x[:, k + 12] = copy > 0, depth <= 1, own > 20, 1
    return parent, depth, first, x


class Model:
    def __init__(self, weights: np.ndarray, edge: np.ndarray):
        self.weights, self.edge = weights, edge  # edge[parent's state, child's state], in logs

    def beliefs(self, parent: np.ndarray, levels: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unnormalised log beliefs, upward messages) of every node: messages go up level by level, then down."""
        belief = np.zeros((len(x), 2))
        belief[:, 1] = x @ self.weights
        up = np.zeros((len(x), 2))
        for at in levels[:0:-1]:
            for state in (0, 1):
                up[at, state] = np.logaddexp(self.edge[state, 0] + belief[at, 0], self.edge[state, 1] + belief[at, 1])
                belief[:, state] += np.bincount(parent[at], weights=up[at, state], minlength=len(x))
        for at in levels[1:]:
            above = belief[parent[at]] - up[at]
            for state in (0, 1):
                belief[at, state] += np.logaddexp(self.edge[0, state] + above[:, 0], self.edge[1, state] + above[:, 1])
        return belief, up

    def marginals(self, parent: np.ndarray, depth: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(content) of every node."""
        belief, _ = self.beliefs(parent, _levels(depth), x)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of every depth, in page order."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth, minlength=1))[:-1])


def fit(sources: list[str], content: list[set[str]], steps: int = 150) -> Model:
    """Trains from pages and their content blocks. A node is content if it holds such a block or an ancestor of one's node."""
    pages = [Page(s) for s in sources]
    parent, depth, first, x = forest(pages)
    y = np.zeros(len(x))
    for p, f, blocks in zip(pages, first, content):
        for e, text, _ in p.blocks:
            if text in blocks:
                y[e + f] = 1
    for at in _levels(depth)[:0:-1]:
        np.maximum.at(y, parent[at], y[at])
    # conditional likelihood: its gradient is what is seen less what the marginals expect
    levels, inner = _levels(depth), np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[inner]].astype(int), y[inner].astype(int)), 1)
    model, grown, pushed = Model(np.zeros(x.shape[1]), np.zeros((2, 2))), np.zeros(x.shape[1]), np.zeros((2, 2))
    scale, edge_scale = np.full(x.shape[1], 1e-8), np.full((2, 2), 1e-8)
    for _ in range(steps):
        belief, up = model.beliefs(parent, levels, x)
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        above = belief[parent[inner]] - up[inner]  # of the parent, without this child
        below = np.zeros((len(x), 2))
        below[:, 1] = x @ model.weights
        for at in levels[:0:-1]:
            for state in (0, 1):
                below[:, state] += np.bincount(parent[at], weights=up[at, state], minlength=len(x))
        joint = above[:, :, None] + model.edge[None] + below[inner][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        g, h = x.T @ (y - p) / len(pages) - 2e-3 * model.weights, (seen - expected) / len(pages) - 2e-3 * model.edge
        scale, edge_scale = 0.95 * scale + 0.05 * g**2, 0.95 * edge_scale + 0.05 * h**2
        grown, pushed = 0.9 * grown + 0.1 * g, 0.9 * pushed + 0.1 * h
        model = Model(model.weights + 0.1 * grown / np.sqrt(scale), model.edge + 0.1 * pushed / np.sqrt(edge_scale))
    return model


def labelled_pages(n: int = 600, seed: int = 3) -> tuple[list[str], list[set[str]]]:
    """Pages with known content, drawn from a small grammar of layouts, and their content blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    serial = iter(range(10**9))

    def say(lo: int, hi: int) -> str:
        words = ["".join(pick("abcdefghilmnoprstu") for _ in range(int(rng.integers(2, 9)))) for _ in range(int(rng.integers(lo, hi)))]
        return " ".join(words).capitalize() + f" {next(serial)}" + pick([".", ".", "", "!", " |"])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def named(word: str) -> str:
        return pick([f' class="{word}"', f' id="{word}"', f' class="site-{word} wide"', f' class="{word}-box"'])

    def shell(kind: str) -> str:
        body = {
            "nav": lambda: links(int(rng.integers(3, 9))),
            "header": lambda: f"<h1>{say(1, 4)}</h1><p>{say(2, 7)}</p>" + (links(3) if rng.random() < 0.5 else ""),
            "footer": lambda: f"<p>&copy; {say(3, 12)}</p>" + (links(3) if rng.random() < 0.5 else ""),
            "sidebar": lambda: f"<h3>{say(1, 4)}</h3>" + pick([links(5), f"<p>{say(5, 30)}</p>"]),
            "notice": lambda: f"<p>{say(5, 30)}</p>" + pick(["", f"<button>{say(1, 2)}</button>"]),
            "ad": lambda: pick([say(3, 25), f"<p>{say(3, 25)}</p>", f'<a href="/x">{say(2, 9)}</a>']),
            "form": lambda: f"<label>{say(1, 3)}</label><input name=q><p>{say(2, 12)}</p><button>Go</button>",
            "comments": lambda: f"<h3>{say(1, 3)}</h3>" + "".join(pick(["<div class='comment'><p>{}</p></div>", "<li><p>{}</p></li>", "<p>{}</p>"]).format(say(4, 60)) for _ in range(int(rng.integers(1, 6)))),
            "related": lambda: f"<h4>{say(1, 3)}</h4>" + links(4),
        }[kind]()
        words = {"nav": ["nav", "menu", "navigation"], "header": ["header", "masthead", "banner"], "footer": ["footer", "copyright"], "sidebar": ["sidebar", "widget", "aside"], "notice": ["notice", "cookie", "alert", "consent"], "ad": ["ad", "ads", "advert", "sponsored", "promo"], "form": ["search", "newsletter", "login", "form"], "comments": ["comments", "discussion", "replies"], "related": ["related", "share", "breadcrumb"]}[kind]
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        if tag and rng.random() < 0.6:
            return f"<{tag}{pick(['', named(pick(words))])}>{body}</{tag}>"
        box = pick(["div", "section", "div"])
        return f"<{box}{named(pick(words))}>{body}</{box}>"

    sources, content = [], []
    for _ in range(n):
        blocks: set[str] = set()

        def block(lo: int, hi: int) -> str:
            text = say(lo, hi)
            blocks.add(text)
            return text

        inner = [f"<h1>{block(1, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(int(rng.integers(1, 9))):
            r = rng.random()
            if r < 0.72:
                inner.append(pick(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div>{}</div>"]).format(block(1, pick([4, 30, 120]))))
            elif r < 0.8:
                inner.append(f"<h2>{block(1, 6)}</h2>")
            elif r < 0.86:
                inner.append("<ul>" + "".join(f"<li>{block(3, 25)}</li>" for _ in range(3)) + "</ul>")
            elif r < 0.9:
                inner.append(f"<blockquote><p>{block(5, 40)}</p></blockquote>")
            elif r < 0.93:
                inner.append(f"<table><tr><td>{block(1, 8)}</td><td>{block(1, 8)}</td></tr></table>")
            else:
                inner.append(shell(pick(["ad", "notice", "related"])))
        if rng.random() < 0.15:
            inner.append(shell("comments"))
        body = "".join(inner)
        body = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='post'>{}</div>", "<main><article>{}</article></main>", "<div>{}</div>", "<section class='story'>{}</section>"]).format(body)
        before = [shell(k) for k in ("header", "nav", "notice", "ad", "form") if rng.random() < 0.5]
        after = [shell(k) for k in ("sidebar", "comments", "related", "ad", "form") if rng.random() < 0.4] + ([shell("footer")] if rng.random() < 0.8 else [])
        page = "".join(before) + body + "".join(after)
        if rng.random() < 0.3:
            page = f"<div class='{pick(['wrapper', 'container', 'page', 'row'])}'>{page}</div>"
        sources.append(f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><script>var a='<p>';</script></head><body>{page}</body></html>")
        content.append(blocks)
    return sources, content


def main_texts(sources: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    parent, depth, first, x = forest(pages)
    content = model.marginals(parent, depth, x) > 0.5
    return ["\n\n".join(text for e, text, _ in p.blocks if content[e + f]) for p, f in zip(pages, first.tolist())]


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", html_col: str = "html", batch_chars: int = 1 << 20) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages; url is null if pages has none.

    Character references are decoded, white space within a block is one space, blocks are joined by two
    line ends in page order. A null or empty page, or one without content, has an empty text.
    Very long, deeply nested and broken pages are read whole, in time that grows with their length. Rows with a null or
    repeated id, and equal pages, are told each; other columns don't matter. An empty table gives no rows.
    """
    model = model or fit(*labelled_pages())

    def run(batches):
        for batch in batches:
            texts, todo, size = [], [], 0
            for s in batch.column(2).to_pylist():
                todo.append(s or "")
                size += len(todo[-1])
                if size > batch_chars:
                    texts += main_texts(todo, model)
                    todo, size = [], 0
            texts += main_texts(todo, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
