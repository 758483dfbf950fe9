"""Main text of web pages by a tree-structured graphical model.

The nodes are the page's block elements and, as leaves, its runs of text. Each has a label,
content or not, with a potential from what the node looks like, and one that ties it to its
parent. Sum-product messages go up from the leaves and down from the root and give each run's
marginal; runs more likely content than not make the text. Weights are fitted on labelled pages
by the exact gradient of their likelihood, which the same messages give.
"""

from __future__ import annotations

import html as references
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrow import freed, slices, strings

TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?|[!?][^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
GOLD = "data-gold"

# Element names of HTML.
BLOCKS = frozenset(
    "html head title body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend label button select option textarea blockquote pre figure figcaption address details summary dialog menu hr center template noscript "
    "iframe object video audio canvas svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object video audio".split())
CLOSED_BY = {
    "p": frozenset("article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol dl table form fieldset blockquote pre figure figcaption address details dialog menu hr center".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "head": frozenset(["body"]),
}
SCOPES = frozenset("ul ol dl table select body html".split())
END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
# For each element, the open ones further out that it ends, up to the next scope.
ENDS = {tag: [x for x, by in CLOSED_BY.items() if tag in by and x != "p"] for tag in BLOCKS}
DEEP = 500      # levels above which messages go node by node

# Words in class, id and role that tell what an element is for.
HINTS = {
    "content": "article content post entry story main body text page prose",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toolbar tabs skip toc",
    "head": "header masthead banner topbar branding logo",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside related rail widget recommended popular trending more tags",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted commercial",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe subscription paywall disclaimer message",
    "comments": "comment comments discussion respond reply replies disqus thread reader readers feedback",
    "share": "share sharing social follow tools meta byline",
    "form": "form search login signup register input contact",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
LEAF = "#text"

_features: dict[str, int] = {}


def feature(name: str) -> int:
    return _features.setdefault(name, len(_features))


for _tag in sorted(BLOCKS):
    feature(f"tag {_tag}")
for _hint in HINTS:
    feature(f"hint {_hint}")
for _size in range(6):
    feature(f"chars {_size}")
for _share in range(3):
    feature(f"links {_share}")
for _tag in sorted(BLOCKS):
    feature(f"in {_tag}")
for _name in ("element", "text", "under body"):
    feature(_name)
SIZES = (15, 40, 100, 250, 600)
EDGES = 3       # a run under its element; an element of text under another; any other element
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())


class Page:
    """Nodes of one page in document order: parent, depth, active features, edge kind, label, and text for runs."""

    def __init__(self, source: str, gold: bool = False):
        self.parent, self.depth, self.active, self.edge, self.label, self.text = [], [], [], [], [], []
        self.stack: list[tuple[int, str, int]] = []
        self.open_at: dict[str, list[int]] = {}     # places in the stack of the open elements of each name
        self.scopes: list[int] = []
        self.unended: set[str] = set()              # names of raw elements that nothing further on ends
        self.parts: list[str] = []
        self.linked = self.chars = self.in_link = 0
        self.gold = gold
        self.read(source)

    def add(self, names: list[int], edge: int, label: int, text: str | None = None) -> int:
        up = self.stack[-1][0] if self.stack else -1
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
        self.active.append(names)
        self.edge.append(edge)
        self.label.append(label)
        self.text.append(text)
        return len(self.parent) - 1

    def run(self) -> None:
        """End a run of text."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                tag, label = (self.stack[-1][1], self.stack[-1][2]) if self.stack else ("body", 0)
                n = sum(len(text) >= s for s in SIZES)
                share = self.linked / max(1, self.chars)
                names = [feature("text"), feature(f"chars {n}"), feature(f"links {0 if share < 0.2 else 1 if share < 0.7 else 2}"), feature(f"in {tag}")]
                self.add(names, 0, label, text)
            self.parts = []
            self.linked = self.chars = 0

    def words(self, raw: str) -> None:
        if raw:
            self.parts.append(references.unescape(raw) if "&" in raw else raw)
            self.chars += len(raw)
            self.linked += len(raw) if self.in_link else 0

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            name = self.stack.pop()[1]
            self.open_at[name].pop()
            if name in SCOPES:
                self.scopes.pop()

    def nearest(self, name: str) -> int:
        places = self.open_at.get(name)
        return places[-1] if places else -1

    def open(self, tag: str, attributes: str) -> None:
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][1], ()):
            self.close(len(self.stack) - 1)
        # An open li (td, tr ...) further out that this one ends, if no scope lies between.
        at = max((self.nearest(x) for x in ENDS.get(tag, ())), default=-1)
        if at > (self.scopes[-1] if self.scopes else -1):
            self.close(at)
        hints, label = set(), self.stack[-1][2] if self.stack else 0
        if "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role"):
                    for w in re.findall(r"[A-Z]?[a-z]+", value):
                        if w.lower() in HINT_OF:
                            hints.add(HINT_OF[w.lower()])
                elif self.gold and name == GOLD:
                    label = int(value)
        names = [feature("element"), feature(f"tag {tag}"), *(feature(f"hint {h}") for h in sorted(hints))]
        if self.stack and self.stack[-1][1] == "body":
            names.append(feature("under body"))
        self.open_at.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((self.add(names, 1 if tag in TEXTUAL else 2, label), tag, label))

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            if not m:
                self.words(source[at:])
                break
            self.words(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in RAW and not m[1]:
                done = None if tag in self.unended else END_OF[tag].search(source, at)
                if not done:
                    self.unended.add(tag)
                self.run()
                at = done.end() if done else (end if tag in ("script", "style") else at)
                continue
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.in_link = 0 if m[1] else 1
            elif tag in BLOCKS:
                self.run()
                if not m[1]:
                    if tag not in VOID:
                        self.open(tag, m[3])
                else:
                    if self.nearest(tag) >= 0:
                        self.close(self.nearest(tag))
                    self.in_link = 0
        self.run()


class Forest:
    """The nodes of several pages, by depth."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.n = int(starts[-1])
        flat = lambda name, kind=np.int64: np.fromiter((x for p in pages for x in getattr(p, name)), kind, self.n)
        self.parent = flat("parent")
        shift = np.repeat(starts[:-1], np.diff(starts))
        self.parent = np.where(self.parent >= 0, self.parent + shift, -1)
        self.edge, self.label, depth = flat("edge"), flat("label"), flat("depth")
        size = np.fromiter((len(a) for p in pages for a in p.active), np.int64, self.n)
        self.row = np.repeat(np.arange(self.n), size)
        self.col = np.fromiter((x for p in pages for a in p.active for x in a), np.int64, int(size.sum()))
        # Runs and elements of text speak with the root of their number, so that many short ones don't outvote their container.
        runs = np.repeat([max(1, sum(t is not None for t in p.text)) for p in pages], np.diff(starts)) if self.n else np.zeros(0)
        self.value = np.where(self.edge < 2, 2 / np.sqrt(runs), 1.0)[self.row]
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if self.n else []
        self.starts = starts

    def pass_messages(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginal of content for every node, and the joint of each node with its parent (parent, own)."""
        local = np.zeros((self.n, 2))
        local[:, 1] = np.bincount(self.row, weights[self.col] * self.value, self.n)
        table, up = ties[self.edge], np.zeros((self.n, 2))
        for level in reversed(self.levels[1:]):
            up[level] = np.logaddexp.reduce(table[level] + local[level][:, None, :], axis=2)
            np.add.at(local, self.parent[level], up[level])
        belief, joint = local.copy(), np.zeros((self.n, 2, 2))
        for level in self.levels[1:]:
            without = belief[self.parent[level]] - up[level]
            pair = table[level] + without[:, :, None]
            joint[level] = pair + local[level][:, None, :]
            belief[level] = local[level] + np.logaddexp.reduce(pair, axis=1)
        one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        return one, joint / joint.sum(axis=(1, 2), keepdims=True)


    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Marginal of content for every node; node by node where pages are so deep that levels hold few nodes."""
        if len(self.levels) <= DEEP:
            return self.pass_messages(weights, ties)[0]
        table, edge, parent = ties.tolist(), self.edge.tolist(), self.parent.tolist()
        one = np.bincount(self.row, weights[self.col] * self.value, self.n).tolist()
        none, order = [0.0] * self.n, np.concatenate(self.levels).tolist()
        up = [(0.0, 0.0)] * self.n
        for i in reversed(order):
            p = parent[i]
            if p >= 0:
                t, a, b = table[edge[i]], none[i], one[i]
                up[i] = (log_sum(t[0][0] + a, t[0][1] + b), log_sum(t[1][0] + a, t[1][1] + b))
                none[p] += up[i][0]
                one[p] += up[i][1]
        for i in order:
            p = parent[i]
            if p >= 0:      # parents come first and hold their belief by now
                t, a, b = table[edge[i]], none[p] - up[i][0], one[p] - up[i][1]
                none[i] += log_sum(t[0][0] + a, t[1][0] + b)
                one[i] += log_sum(t[0][1] + a, t[1][1] + b)
        return 1 / (1 + np.exp(np.clip(np.subtract(none, one), -60, 60)))


def log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(labelled: list[str], rounds: int = 200, rate: float = 0.15, ridge: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """Weights from pages whose elements carry the attribute data-gold (1 content, 0 not; inherited)."""
    forest = Forest([Page(x, gold=True) for x in labelled])
    weights, ties = np.zeros(len(_features)), np.zeros((EDGES, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    y, pages = forest.label, len(labelled)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
    theta = np.concatenate([weights, ties.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p, joint = forest.pass_messages(theta[:len(weights)], theta[len(weights):].reshape(ties.shape))
        g = np.bincount(forest.col, (y - p)[forest.row] * forest.value, len(weights))
        want = np.zeros_like(seen)
        np.add.at(want, forest.edge[child], joint[child])
        g = np.concatenate([g, (seen - want).ravel()]) / pages - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-6)
    return theta[:len(weights)], theta[len(weights):].reshape(ties.shape)


def labelled_pages(n: int = 600, seed: int = 1) -> list[str]:
    """Labelled training pages of many layouts, made by rule: the words carry no meaning, the structure does."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ka", "lo", "mi", "ren", "tu", "sa", "ver", "on", "e", "di")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    style = {"end": ".", "junk": ""}

    def sentence(a=5, b=25):
        got = words(a, b)
        return (re.sub(" ", lambda m: style["junk"] + " ", got) if style["junk"] else got.capitalize()) + style["end"]

    link = lambda a=1, b=4: f'<a href="/{word()}">{words(a, b)}</a>'

    def mark(tag, inner, gold, names=(), also=""):
        name = r.choice(names) if names and r.random() < 0.9 else ""
        attribute = f' {r.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag}{attribute}{also} {GOLD}="{gold}">{inner}</{tag}>'

    def inline(text):
        return re.sub(r"\b(\w+)\b", lambda m: r.choice(('<b>{}</b>', '<em>{}</em>', '<a href="/x">{}</a>', '<span>{}</span>')).format(m[1]) if r.random() < 0.04 else m[1], text)

    def links(tag="ul"):
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + f"</{tag}>"

    def paragraphs(a, b):
        return "".join(f"<p>{inline(' '.join(sentence() for _ in range(r.randint(1, 6))))}</p>" for _ in range(r.randint(a, b)))

    def menu():
        inner = links() if r.random() < 0.8 else " | ".join(link() for _ in range(5))
        return mark("nav", inner, 0, ("", "menu", "main-nav")) if r.random() < 0.6 else mark("div", inner, 0, ("menu", "nav", "navbar", "breadcrumbs", "topMenu"))

    def header():
        inner = f"<h1>{words(1, 3)}</h1><p>{sentence(3, 8)}</p>" if r.random() < 0.5 else f"<div>{link()}</div>" + (links() if r.random() < 0.5 else "")
        return mark("header", inner, 0) if r.random() < 0.6 else mark("div", inner, 0, ("header", "masthead", "site-header", "banner"))

    def footer():
        inner = r.choice((f"&copy; {word()}.example.com &middot; {sentence(3, 14)}", f"<p>{sentence(4, 14)}</p>" + links(), links() + sentence(3, 9)))
        return mark("footer", inner, 0) if r.random() < 0.6 else mark("div", inner, 0, ("footer", "site-footer", "copyright"))

    def side():
        inner = f"<h{r.randint(2, 4)}>{words(1, 3)}</h3>" + r.choice((links(), paragraphs(1, 2), links() + paragraphs(1, 1)))
        return mark("aside", inner, 0, ("", "sidebar")) if r.random() < 0.5 else mark("div", inner, 0, ("sidebar", "related", "widget", "side-column", "popularPosts"))

    def advert():
        inner = r.choice((sentence(4, 14), f"<p>{sentence(4, 14)}</p>", link(3, 8), paragraphs(1, 2)))
        return mark(r.choice(("div", "div", "section")), inner, 0, ("ad", "ads", "advert", "sponsored", "ad-box", "promo"))

    def notice():
        inner = f"<p>{sentence(6, 20)} {link(1, 2)}</p>" + ("<button>" + words(1, 2) + "</button>" if r.random() < 0.5 else "")
        return mark("div", inner, 0, ("cookie-notice", "consent", "notice", "newsletter", "alert", "gdpr-banner"), r.choice(("", ' role="alert"')))

    def form():
        inner = f"<label>{words(1, 3)}</label><input name='q'><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button>"
        return mark("form", inner + (f"<p>{sentence(4, 12)}</p>" if r.random() < 0.5 else ""), 0, ("", "search-form", "signup"))

    def comments():
        inner = "".join(mark(r.choice(("div", "li", "div", "section")), f"<p>{words(1, 2)}</p>{paragraphs(1, 2)}", 0, ("comment", "comment-body", "reply")) for _ in range(r.randint(1, 5)))
        return mark(r.choice(("section", "div", "div")), f"<h3>{words(1, 2)}</h3>{inner}", 0, ("comments", "discussion", "reader-comments", "commentList"))

    def share():
        return mark("div", " ".join(link(1, 1) for _ in range(4)), 0, ("share", "social-links", "sharing"))

    def article():
        parts = [f"<h1>{words(2, 12)}{r.choice(('.', ''))}</h1>"] if r.random() < 0.9 else []
        if r.random() < 0.4:
            parts.append(f"<p><b>{sentence()}<br>")
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 7))):
            parts.append(r.choice((lambda: paragraphs(1, 4), lambda: paragraphs(1, 4), lambda: f"<h2>{words(1, 6)}</h2>{paragraphs(1, 2)}",
                                   lambda: "<ul>" + "".join(f"<li>{sentence(2, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                                   lambda: f"<blockquote>{sentence(5, 30)}</blockquote>", lambda: f"<figure><img src='x'><figcaption>{sentence(3, 10)}</figcaption></figure>",
                                   lambda: f"<p>{words(1, 2)}.</p>", lambda: f"<p>{words(1, 3)}</p>" * r.randint(3, 40), lambda: f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>", lambda: f"<div>{paragraphs(1, 2)}</div>"))())
            if r.random() < 0.12:
                parts.append(r.choice((advert, share, notice, side, form))())
        if r.random() < 0.15:
            parts.append(comments())
        inner = "".join(parts)
        kind = r.random()
        if kind < 0.5:
            return mark("article", inner, 1, ("", "post", "entry", "story"))
        if kind < 0.7:
            return mark("main", inner, 1, ("", "content"))
        if kind < 0.95:
            return mark(r.choice(("div", "div", "section")), inner, 1, ("content", "post-body", "article-text", "entry-content", "main", "story"))
        return f'<div {GOLD}="1">{inner}</div>'

    out = []
    for _ in range(n):
        style.update(end=r.choice((".", ".", ".", "!", "")), junk=r.choice(("", "", "", "", "###", "&amp;&amp;&amp;")))
        some = lambda k, p: [k()] if r.random() < p else []
        body = some(header, 0.5) + some(menu, 0.8) + some(notice, 0.3) + some(advert, 0.5) + some(form, 0.25)
        rest = some(side, 0.4) + some(comments, 0.3) + some(advert, 0.3) + some(share, 0.2) + some(notice, 0.2) + some(form, 0.2)
        r.shuffle(rest)
        rest += some(footer, 0.85)
        if r.random() < 0.15:
            rest, body = rest[:-1] + body, rest[-1:]
        inner = "".join(body) + article() + "".join(rest)
        if r.random() < 0.25:
            inner = f'<div {r.choice(("id", "class"))}="{r.choice(("page", "wrapper", "container"))}" {GOLD}="0">{inner}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>track(0);</script></head><body>{inner}</body></html>")
    return out


def main_texts(sources: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(x) for x in sources]
    forest = Forest(pages)
    if not forest.n:
        return [""] * len(pages)
    p = forest.marginals(*model)
    starts = forest.starts.tolist()
    return ["\n".join(t for t, q in zip(page.text, p[a:b]) if t is not None and q > 0.5) for page, a, b in zip(pages, starts, starts[1:])]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Blocks are runs of text between block elements; white space inside is one space, character references are decoded,
    blocks are joined by a line feed. Null html, and pages without a content block, have an empty text. Null ids and
    repeated rows stay, one row each; other columns are ignored; an empty table gives no rows. ``labelled`` pages train
    the model; without them ``labelled_pages()`` do.
    """
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled if labelled is not None else labelled_pages()))

    @freed
    def run(batches):
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                texts = main_texts([x or "" for x in strings(part.column("html"))], model.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
