"""Main-text extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is a vector of its tag path
(tags and words of class, id and role), its hashed words and a few measures; a
bidirectional LSTM in numpy reads the whole sequence and labels every block, so
a label depends on the context of the page. Blocks labelled as article are
joined in page order.

There are no labelled pages, so the labeller is trained on page layouts composed
from the texts of a bounded sample of the pages, where each block's role is
known by construction (menus, headers, footers, side bars, notices, adverts,
forms, reader comments, articles), and on the sample itself where its own
sectioning elements leave no doubt. A share of the composed pages (``PLAIN``) has
no telling element or class name at all, and a share of all pages
(``BLIND``) is learnt once more without its paths, so that labels also follow from
the blocks' own words, shape, links and place.

Edge cases: null and empty pages have no blocks and an empty text; an empty
table trains on composed pages of fixed words; pages of one block are labelled
like others; very long pages are read whole; repeated rows come out alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optiloom.llm.html_blocks import Block, split_blocks
from optiloom.llm.words import read_words

PATH_DIM, WORD_DIM, HIDDEN = 64, 12, 24
#: Pages of the training sample, and the longest page taken into it (longer ones are still labelled).
SAMPLE_PAGES, SAMPLE_BYTES = 150, 100_000
COMPOSED_PAGES = 1200
#: Share of composed pages whose containers tell nothing, and of training pages that are repeated without paths.
PLAIN, BLIND = 0.4, 0.3
_WORDS = np.random.default_rng(3).normal(0, 1, (2048, WORD_DIM))
_MEASURES = 8
DIM = PATH_DIM + WORD_DIM + _MEASURES
#: Elements and class words that mark what is not the article.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select dialog menu".split())
#: Openings of blocks outside of articles, by role.
PHRASES = {
    "bottom": ("Copyright 2020", "Copyright 2024", "\u00a9 2023", "All rights reserved.", "Contact us", "Terms of use | Privacy policy", "Powered by", "About this site", "Imprint", "The Example Company", "Ltd. Registered office", "Published by"),
    "notice": ("We use cookies to improve", "This site uses cookies", "Accept all cookies", "Subscribe to our newsletter", "Please enable scripts", "Breaking:"),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Special offer", "Save 50%", "Order today"),
    "menu": ("Home", "News", "Sports", "About", "Contact", "Login", "Archive", "Search", "Help", "Next page"),
    "side": ("Related articles", "Most read", "Tags", "Recent posts", "Follow us", "Popular"),
    "comment": ("Comments", "3 comments", "Reply", "Anonymous wrote:", "Posted by a reader at 12:30", "I agree,", "Great post!"),
}
_PLAIN_NAMES = ("c1", "box", "wrap", "col", "row", "inner", "unit", "x7", "block", "grid", "cell", "part", "bodytext", "area", "layer", "zone", "holder", "main-col")
OUTSIDE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie footer header menu modal nav newsletter notice popup promo related share sidebar social sponsor subscribe widget".split())


def _path_vector(path: tuple[str, ...], known: dict) -> np.ndarray:
    if path not in known:
        total = np.zeros(PATH_DIM)
        for x in set(path):
            total += np.random.default_rng(zlib.crc32(x.encode())).normal(0, 1, PATH_DIM)
        if len(known) > 50_000:
            known.clear()
        known[path] = total / max(1, len(set(path))) ** 0.5
    return known[path]


def vectors(pages: list[list[Block]], known: dict) -> list[np.ndarray]:
    """One matrix of block vectors per page."""
    blocks = [b for page in pages for b in page]
    if not blocks:
        return [np.zeros((0, DIM)) for _ in pages]
    words = read_words([b.text.encode("utf-8", "replace") for b in blocks])
    count = np.diff(words.first)
    at = (words.hashes >> np.uint64(53)).astype(np.int64)
    mean = np.empty((len(blocks), WORD_DIM))
    for k in range(WORD_DIM):
        total = np.r_[0.0, np.cumsum(_WORDS[at, k])]
        mean[:, k] = (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(count, 1)
    size = np.array([len(b.text) for b in blocks], float)
    linked = np.minimum([b.linked for b in blocks] / size, 1)
    place = np.concatenate([np.arange(len(p)) for p in pages])
    rest = np.concatenate([np.arange(len(p))[::-1] for p in pages])
    marks = np.array([b.text.count(",") for b in blocks], float)
    measures = np.column_stack([np.log1p(size) / 5, linked, np.log1p(count) / 4, [b.text[-1] in ".!?" for b in blocks], [min(len(b.path), 16) / 8 for b in blocks], np.log1p(place) / 4, np.log1p(rest) / 4, marks * 20 / (size + 20)])
    every = np.column_stack([np.array([_path_vector(b.path, known) for b in blocks]), mean * 0.5, measures])
    return np.split(every, np.cumsum([len(p) for p in pages])[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Weights of both directions (inputs and state to four gates) and of the output."""

    wx: np.ndarray  # 2, DIM + 1, 4 * HIDDEN
    wh: np.ndarray  # 2, HIDDEN, 4 * HIDDEN
    out: np.ndarray  # 2 * HIDDEN + 1

    @classmethod
    def fresh(cls, seed: int = 11) -> Labeller:
        rng = np.random.default_rng(seed)
        wx = rng.normal(0, 0.15, (2, DIM + 1, 4 * HIDDEN))
        wx[:, -1] = 0
        wx[:, -1, HIDDEN : 2 * HIDDEN] = 1.0
        return cls(wx, rng.normal(0, 0.2, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.3, 2 * HIDDEN + 1))

    def run(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Margins for padded pages ``x`` (time, page, DIM) with mask ``live``; with ``keep`` also what learning needs."""
        steps, n, _ = x.shape
        hidden = np.zeros((2, steps, n, HIDDEN))
        kept = []
        for way in (0, 1):
            drive = x @ self.wx[way, :-1] + self.wx[way, -1]
            h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                gates = drive[t] + h @ self.wh[way]
                i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
                g = np.tanh(gates[:, 3 * HIDDEN :])
                m = live[t][:, None]
                c_new = f * c + i * g
                tc = np.tanh(c_new)
                if keep:
                    kept.append((way, t, h, c, i, f, o, g, tc))
                c = m * c_new + (1 - m) * c
                h = m * (o * tc) + (1 - m) * h
                hidden[way, t] = h
        both = np.concatenate([hidden[0], hidden[1]], axis=2)
        return both @ self.out[:-1] + self.out[-1], both, kept

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        margin, both, kept = self.run(x, live, True)
        d = (_sigmoid(margin) - y) * live / max(1.0, live.sum())
        g_out = np.append(np.tensordot(d, both, ((0, 1), (0, 1))), d.sum())
        d_both = d[..., None] * self.out[:-1]
        g_wx, g_wh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        n = x.shape[1]
        dh, dc, last = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), None
        for way, t, h, c, i, f, o, g, tc in reversed(kept):
            if way != last:
                dh, dc, last = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), way
            m = live[t][:, None]
            dh = dh + d_both[t][:, way * HIDDEN : (way + 1) * HIDDEN]
            now = m * dh
            dcn = m * dc + now * o * (1 - tc * tc)
            gates = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), now * tc * o * (1 - o), dcn * i * (1 - g * g)], axis=1)
            g_wx[way, :-1] += x[t].T @ gates
            g_wx[way, -1] += gates.sum(0)
            g_wh[way] += h.T @ gates
            dh = (1 - m) * dh + gates @ self.wh[way].T
            dc = (1 - m) * dc + dcn * f
        return [g_wx, g_wh, g_out]


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), DIM)), np.zeros((steps, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, 1
    return x, live


def fit(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 20, rate: float = 0.01, seed: int = 11) -> Labeller:
    """Adam on the logistic loss of all blocks."""
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    params = [model.wx, model.wh, model.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    some = [k for k in range(len(pages)) if len(pages[k])]
    for epoch in range(epochs):
        order = sorted(rng.permutation(some), key=lambda k: len(pages[k]) // 12)
        groups = [order[a : a + 32] for a in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            x, live = _padded([pages[k] for k in groups[g]])
            y = np.zeros(live.shape)
            for c, k in enumerate(groups[g]):
                y[: len(labels[k]), c] = labels[k]
            step += 1
            for p, grad, a, b in zip(params, model.gradients(x, live, y), first, second, strict=True):
                grad = np.clip(grad, -1, 1)
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                p -= rate * (0.3 if epoch > epochs * 2 // 3 else 1) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels by the page's own sectioning elements, or None where they say nothing."""
    inside = np.array(["article" in b.path or "main" in b.path for b in blocks])
    outside = np.array([bool(OUTSIDE_TAGS & set(b.path)) or any(x[1:] in OUTSIDE_WORDS for x in b.path if x[0] == ".") for b in blocks])
    return (inside & ~outside).astype(float) if inside.any() and not inside.all() else None


def compose(texts: list[str], seed: int) -> tuple[str, list[int]]:
    """A page made of the texts in a random layout, and the role of each of its blocks (1: article)."""
    rng = np.random.default_rng(seed)
    parts: list[str] = []
    roles: list[int] = []
    plain, table = rng.random() < PLAIN, rng.random() < 0.25

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def holder(*options: str) -> list[str]:
        """Opening and closing tag of a container: one of the options, or on a plain page one that tells nothing."""
        if not plain:
            return pick(*options).split("|")
        name = pick(*_PLAIN_NAMES)
        if table:
            return [f'<table><tr><td class="{name}">', "</td></tr></table>"]
        return pick(f'<div class="{name}">|</div>', f'<div id="{name}">|</div>', "<div>|</div>", "|", f'<section class="{name}">|</section>').split("|")

    def opening(kind: str, often: float = 0.6) -> str:
        return pick(*PHRASES[kind]) + " " if rng.random() < often else ""

    def words(low: int, high: int) -> str:
        have = texts[rng.integers(len(texts))].split() or ["text"]
        at = int(rng.integers(len(have)))
        return " ".join((have[at:] + have)[: int(rng.integers(low, high + 1))]).replace("&", "&amp;").replace("<", "&lt;")

    def put(role: int, open_: str, close: str, low: int, high: int, start: str = "") -> None:
        parts.append(f"{open_}{start}{words(low, high)}{close}")
        roles.append(role)

    def menu() -> None:
        tag = holder('<nav>|</nav>', '<div class="menu">|</div>', '<ul class="nav">|</ul>', '<div id="navigation">|</div>', '<nav class="breadcrumb">|</nav>')
        outer, inner = pick("<ul>|</ul>#<li>|</li>", "<table><tr>|</tr></table>#<td>|</td>", "|#<p>|</p>").split("#") if plain else ("<ul>|</ul>", "<li>|</li>")
        parts.append(tag[0] + outer.split("|")[0])
        for _ in range(rng.integers(2, 9)):
            put(0, inner.split("|")[0] + '<a href="/x">', "</a>" + inner.split("|")[1], 1, 2, opening("menu", 0.4))
        parts.append(outer.split("|")[1] + tag[1])

    def single(kind: str, low: int, high: int, *opens: str) -> None:
        if plain:
            tag, start = holder(), opening(kind, 0.9)
            put(0, tag[0] + pick("<p>", "<p>", "<div>") , pick("</p>", "</div>", "</p>") + tag[1], 0 if start else low, min(high, 12), start)
            return
        open_ = pick(*opens)
        inner = pick("", "", "<p>")
        put(0, open_ + inner, f"</{open_[1:].split()[0].rstrip('>')}>", low, high, opening(kind, 0.3))

    def advert() -> None:
        single("advert", 2, 30, '<div class="ad">', '<div class="advert">', '<div class="banner">', '<div class="sponsor">', '<div class="promo">', '<section class="related">')

    def notice() -> None:
        single("notice", 3, 25, '<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div class="popup">', '<dialog>', '<div role="alert" class="notice">')

    def side() -> None:
        tag = holder('<aside>|</aside>', '<div class="sidebar">|</div>', '<aside class="widget">|</aside>', '<section id="sidebar">|</section>')
        parts.append(tag[0])
        if plain:
            put(0, "<h3>", "</h3>", 0, 1, opening("side", 1.0))
        for _ in range(rng.integers(1, 5)):
            link = plain or rng.random() < 0.3
            put(0, pick("<h3>", "<p>", "<li>") + '<a href="/y">' * link, "</a>" * link, 2, 12 if plain else 30)
        parts.append(tag[1])

    def form() -> None:
        parts.append(pick("<form>", '<form class="subscribe">', '<form id="newsletter">'))
        put(0, "<label>", "</label><input name=q>", 1, 5)
        put(0, "<button>", "</button>", 1, 2)
        parts.append("</form>")

    def comments() -> None:
        tag = holder('<section class="comments">|</section>', '<div id="comments">|</div>', '<ol class="comment-list">|</ol>', '<div class="reader-comments">|</div>')
        parts.append(tag[0])
        if plain or rng.random() < 0.6:
            put(0, "<h3>", "</h3>", 0 if plain else 1, 1 if plain else 3, opening("comment", 1.0 if plain else 0.3))
        for _ in range(rng.integers(1, 6)):
            put(0, "<p>" if plain else pick('<div class="comment"><p>', "<li><p>", '<article class="comment"><p>', "<p>"), pick("</p>", "</p></div>"), 3, 60, opening("comment", 0.9 if plain else 0.2))
        parts.append("</div></li>" + tag[1])

    def article() -> None:
        tag = holder('<article>|</article>', '<article>|</article>', '<main><article>|</article></main>', '<main>|</main>', '<article class="post">|</article>', '<div class="article-body">|</div>', '<div class="content">|</div>', '<div class="entry-content">|</div>', '<section class="story">|</section>')
        parts.append(tag[0])
        if rng.random() < 0.9:
            put(1, "<h1>", "</h1>", 1, 14)
        for _ in range(1 if rng.random() < 0.2 else rng.integers(1, 16)):
            kind = rng.random()
            if kind < 0.7:
                put(1, "<p>", pick("</p>", "</p>", ""), 12 if plain else 1, 120)
            elif kind < 0.78:
                put(1, "<h2>", "</h2>", 1, 8)
            elif kind < 0.84:
                put(1, "<blockquote>", "</blockquote>", 3, 40)
            elif kind < 0.92:
                parts.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    put(1, "<li>", "</li>", 1, 20)
                parts.append("</ul>")
            elif kind < 0.95:
                put(1, "<table><tr><td>", "</td></tr></table>", 1, 6)
            else:
                put(1, "<p><b>", "<br><p>", 1, 60)
            if rng.random() < 0.06:
                pick_one = (advert, form, side)[rng.integers(3)]
                pick_one()
        if rng.random() < 0.1:
            single("side", 1, 12, '<div class="share">', '<div class="social-share">')
        parts.append("</p>" + tag[1])

    def top() -> None:
        single("menu", 1, 8, "<header>", '<div class="header">', '<div id="site-header">', '<header class="banner">')

    def bottom() -> None:
        single("bottom", 2, 25, "<footer>", "<footer>", '<div class="footer">', '<div id="footer">')

    before = [x for x, p in ((notice, 0.25), (top, 0.4), (menu, 0.75), (advert, 0.5), (side, 0.2)) if rng.random() < p]
    after = [x for x, p in ((comments, 0.4), (side, 0.25), (form, 0.25), (advert, 0.25), (menu, 0.1), (bottom, 0.8), (notice, 0.1)) if rng.random() < p]
    if plain and rng.random() < 0.15:
        before, after = [], []
    for part in [*before, article, *after]:
        part()
    return "<html><body>" + "".join(parts) + "</body></html>", roles


def examples(real: list[list[Block]], seeds: range) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and labels of composed pages, of the real pages whose elements leave no doubt, and of some of both without paths."""
    texts = [b.text for page in real for b in page] or ["These are a few plain words for an empty table of pages."]
    found, labels = [], []
    for seed in seeds:
        page, roles = compose(texts, seed)
        blocks = split_blocks(page)
        if len(blocks) == len(roles):
            found.append(blocks)
            labels.append(np.array(roles, float))
    for blocks in real:
        own = own_labels(blocks) if blocks else None
        if own is not None:
            found += [blocks] * 2
            labels += [own] * 2
    x = vectors(found, {})
    rng = np.random.default_rng(len(x))
    for k in np.flatnonzero(rng.random(len(x)) < BLIND):
        x.append(x[k].copy())
        x[-1][:, :PATH_DIM] = 0
        labels.append(labels[k])
    return x, labels


def train(pages: DataFrame, id_col: str = "page_id", text: str = "html") -> Labeller:
    """Fits on composed pages and on at most ``SAMPLE_PAGES`` pages of the table."""
    return fit(*examples([split_blocks(h) for h in sorted(_sample(pages, id_col, text))], range(COMPOSED_PAGES)))


def _sample(pages: DataFrame, id_col: str, text: str) -> list[str]:
    """Pages of least id hash among those short enough; only their ids are sorted. Of pages that repeat an id the one of least hash counts."""
    short = pages.where(F.octet_length(text).between(1, SAMPLE_BYTES)).select(F.col(id_col).alias("i"))
    chosen = short.distinct().orderBy(F.xxhash64("i"), "i").limit(SAMPLE_PAGES)
    rows = pages.join(F.broadcast(chosen), F.col(id_col) == F.col("i")).where(F.octet_length(text).between(1, SAMPLE_BYTES))
    html = F.col(text)
    return [r.one.html for r in rows.groupBy("i").agg(F.min(F.struct(F.xxhash64(html).alias("h"), html.alias("html"))).alias("one")).collect()]  # at most SAMPLE_PAGES


def label_pages(model: Labeller, pages: list[list[Block]], known: dict) -> list[np.ndarray]:
    """Whether each block belongs to the article; pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    found = vectors(pages, known)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and high - low < 256 and (high - low + 1) * len(pages[order[high]]) <= 1 << 14:
            high += 1
        x, live = _padded([found[k] for k in order[low:high]])
        margin = model.run(x, live)[0]
        for c, k in enumerate(order[low:high]):
            out[k] = margin[: len(pages[k]), c] > 0
        low = high
    return out


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_main for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                found = [split_blocks(h or "") for h in batch.column(2).to_pylist()]
                keep = label_pages(model, found, known)
                texts = ["\n\n".join(b.text for b, k in zip(blocks, ks, strict=True) if k) for blocks, ks in zip(found, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64()), pa.array([int(k.sum()) for k in keep], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(text).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_main long")


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages)).select("page_id", "url", "text", "n_chars")
