"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with a hashed tag path (names, classes and ids of the open elements)
and hashed words. A bidirectional LSTM in numpy reads the whole sequence and labels every block, so a block's label rests
on the page around it. The labeller is trained on a bounded sample of the pages themselves: blocks below article elements
are main text, navigation, adverts and the like are not; copies of the pages under other tag and class names, with
sidebars, notices, forms and comments put in, teach it what the sample's markup does not show.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the labeller is trained on, at most: those with the smallest id hashes, whole.
SAMPLE = 300
COPIES = 3
#: Blocks of a training sequence; a longer page is cut into several.
TRAIN_BLOCKS = 64
TAGS, WORDS, EMBED, HIDDEN = 512, 1024, 16, 16
EPOCHS = 3
SEED = 11
_GROUP = 64

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")
#: Content that is never text of the page.
_RAW = frozenset("script style noscript template textarea title svg iframe".split())
#: Of these, the ones that a page goes on after if their end tag is missing; after the others browsers take the rest for content.
_OPEN_RAW = frozenset("noscript template svg".split())
#: Elements around a block that its path names, the innermost ones.
DEPTH = 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float
    main: int = 0


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    open: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            path = tuple(n for _, names in self.stack[-DEPTH:] for n in names)
            self.blocks.append(Block(path, text, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def push(self, tag: str, names: list[str]) -> None:
        self.stack.append((tag, tuple(names)))
        self.open[tag] += 1

    def cut(self, where: int) -> None:
        self.open.subtract(tag for tag, _ in self.stack[where:])
        del self.stack[where:]


def _markup(page: str, at: int) -> tuple[int, int, re.Match | None]:
    """The next piece of markup from ``at`` on: its start, its end, and the match if it is a tag. A sign that starts nothing is
    text. Every step goes past a ``>``, or there is none left, so a page is read in about one pass."""
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 4]
        if after == "!--":
            return start, _COMMENT.match(page, start).end(), None
        if not after or not (after[0] in "!?" or (after[1:] if after[0] == "/" else after)[:1].isalpha()):
            at = start + 1
            continue
        close = page.find(">", start)
        if close < 0:
            break
        if after[0] in "!?":
            return start, close + 1, None
        # A quote that is never closed hides no end of a tag.
        match = _TAG.match(page, start) or _PLAIN_TAG.match(page, start)
        if match:
            return start, match.end(), match
        at = start + 1
    return len(page), len(page), None


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a whole page, in order. White space and character references are resolved; unclosed and stray
    tags are borne as browsers do for paragraphs and list items. A script, style, textarea, title or iframe without an end takes
    the rest of the page, as in browsers; a noscript, template or svg without one, or closed by itself, takes nothing."""
    page, out, at = page or "", _Reader(), 0
    endless: set[str] = set()
    while True:
        start, end, match = _markup(page, at)
        piece = page[at:start]
        if piece and not any(tag == "head" for tag, _ in out.stack[-2:]):
            out.parts.append(piece)
            out.linked += len(piece) if out.open["a"] > 0 else 0
        if start == len(page):
            break
        at = end
        if not match:
            continue
        tag = match[2].lower()
        if match[1]:
            if tag not in _INLINE:
                out.flush()
            if out.open[tag] > 0:
                out.cut(next(i for i in range(len(out.stack) - 1, -1, -1) if out.stack[i][0] == tag))
            continue
        if tag in _RAW:
            if tag == "svg" and match[3].endswith("/"):
                continue
            found = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif tag in _OPEN_RAW:
                endless.add(tag)
            else:
                at = len(page)
            continue
        if tag == "br":
            out.parts.append(" ")
        if tag not in _INLINE:
            out.flush()
            closed = ("p",) if tag in _CLOSES_P else (tag,) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ()
            for i in range(len(out.stack) - 1, -1, -1):
                if out.stack[i][0] in closed:
                    out.cut(i)
                    break
                if out.stack[i][0] not in _INLINE:
                    break
        if tag in _VOID or match[3].endswith("/"):
            continue
        names = [tag]
        if match[3]:
            for m in _NAMES.finditer(match[3]):
                names += [f".{w.lower()}" for w in re.split(r"[\s_-]+", m[2] or m[3] or m[4] or "") if w]
        out.push(tag, names)
    out.flush()
    return out.blocks


#: Names under which pages put what is not main text, and main text itself.
_OUTSIDE = frozenset(
    "nav footer header aside form button menu .ad .ads .advert .banner .sponsored .promo .sidebar .comment .comments .cookie .notice "
    ".related .share .social .newsletter .subscribe .breadcrumb .menu .footer .nav".split()
)
_INSIDE = frozenset("article main .article .content .post .entry .story".split())


def weak_labels(page: list[Block]) -> list[Block]:
    """Blocks below an element of main text, unless something nearer is named as not being so."""
    for b in page:
        inside = max((i for i, n in enumerate(b.path) if n in _INSIDE), default=-1)
        outside = max((i for i, n in enumerate(b.path) if n in _OUTSIDE), default=-1)
        b.main = int(inside > outside)
    return page


def _ids(names: tuple[str, ...] | list[str], size: int) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % size for n in names]


#: Other names for an element in the training copies: (its own, in main text).
_OTHER = {
    "article": (("div", ".content"), ("div", ".post", ".body"), ("main",), ("section", ".entry"), ("div", ".article", ".text"), ("div", ".story")),
    "nav": (("div", ".menu"), ("ul", ".nav"), ("header", "nav"), ("div", ".navigation"), ("div", ".breadcrumb")),
    "footer": (("div", ".footer"), ("div", ".bottom"), ("div", ".copyright"), ("footer", ".site")),
    ".ad": ((".ads",), (".advert",), (".sponsored",), (".banner",), (".promo",)),
}
_PUT_IN = (
    (("header",), False), (("div", ".header"), False), (("aside",), True), (("div", ".sidebar"), True), (("aside", "ul", "li"), False),
    (("div", ".cookie", ".notice"), True), (("div", ".notice"), True), (("div", ".banner", ".cookie"), True), (("form",), False),
    (("form", "label"), False), (("div", ".newsletter", "form"), True), (("div", ".comments", "div", ".comment", "p"), True),
    (("section", ".comments", "article", ".comment", "p"), True), (("section", ".comments", "li", ".comment", "p"), True),
    (("div", ".related", "li", "a"), False), (("div", ".share"), False), (("div", ".advert"), True), (("div", ".ad"), True),
    (("div", ".disqus", "p"), True), (("ul", ".social", "li", "a"), False), (("div", ".popup"), True), (("div", ".widget", "p"), True),
)


def _copy(page: list[Block], pool: list[str], random: np.random.Generator) -> list[Block]:
    """The page under other names, with blocks put in that are not main text: in, between and around it."""
    chosen = {k: v[int(random.integers(len(v)))] for k, v in _OTHER.items() if random.random() < 0.6}
    out = []
    for b in page:
        path = tuple(m for n in b.path for m in chosen.get(n, (n,)))
        out.append(Block(path, b.text, b.linked, b.main))
    inner = [i for i, b in enumerate(out) if b.main]
    for _ in range(int(random.integers(1, 5))):
        names, prose = _PUT_IN[int(random.integers(len(_PUT_IN)))]
        count = int(random.integers(1, 5))
        words = [pool[int(random.integers(len(pool)))].split() for _ in range(count)]
        texts = [" ".join(w if prose else w[: int(random.integers(1, 5))]) for w in words]
        linked = float("a" in names)
        late = ".comment" in names or ".comments" in names or random.random() < 0.4
        below = out[inner[-1]].path[: int(random.integers(1, 5))] if inner and random.random() < 0.3 else ("html", "body")
        at = int(random.integers(len(out) + 1)) if random.random() < 0.3 else len(out) if late else 0
        out[at:at] = [Block(tuple(below) + names, t, linked, 0) for t in texts if t]
    return out


@dataclass
class Labeller:
    """Weights of the network. ``probabilities`` labels pages given as lists of blocks."""

    p: dict[str, np.ndarray]

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        for i in range(0, len(order), _GROUP):
            group = order[i : i + _GROUP]
            # Groups of equal length, nearly: a page that is much longer goes alone.
            while group:
                some = [j for j in group if len(pages[j]) <= 2 * len(pages[group[0]]) + 8]
                group = group[len(some) :]
                chance, _ = _through(self.p, *_embedded(self.p, [pages[j] for j in some]))
                for column, j in enumerate(some):
                    out[j] = chance[: len(pages[j]), column]
        return out


_tag_ids: dict[tuple[str, ...], list[int]] = {}
_word_ids: dict[str, int] = {}


def _path_ids(b: Block) -> list[int]:
    ids = _tag_ids.get(b.path)
    if ids is None:
        if len(_tag_ids) > 1 << 14:
            _tag_ids.clear()
        ids = _tag_ids[b.path] = _ids(b.path + tuple(f"{i}:{x}" for i, x in enumerate(b.path[-2:])), TAGS)
    return ids


def _bags(pages: list[list[Block]]):
    """Of every block, page by page: hashed path names, hashed words, and other features; and the time-major places."""
    if len(_word_ids) > 1 << 19:
        _word_ids.clear()
    tags, words, other, places = [], [], [], []
    for j, page in enumerate(pages):
        for t, b in enumerate(page):
            found = _WORD.findall(b.text)
            for w in set(found).difference(_word_ids):
                _word_ids[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            size = len(b.text)
            tags.append(_path_ids(b))
            words.append([_word_ids[w] for w in found])
            other.append((np.log1p(size) / 5, np.log1p(len(found)) / 4, b.linked, t / len(page), (size - sum(map(len, found))) / size))
            places.append((t, j))
    return tags, words, np.array(other, np.float32), tuple(np.array(places).T)


def _blank(pages: list[list[Block]], width: int) -> np.ndarray:
    return np.zeros((max(map(len, pages)), len(pages), width), np.float32)


def _inputs(pages: list[list[Block]]):
    """Time-major arrays for training: path and word bags, other features, and a mask."""
    tags, words, other, at = _bags(pages)
    out = _blank(pages, TAGS), _blank(pages, WORDS), _blank(pages, 5), _blank(pages, 1)
    for bags, full in ((tags, out[0]), (words, out[1])):
        for t, j, ids in zip(*at, bags):
            full[t, j] = np.bincount(ids, minlength=full.shape[2]) / max(1, len(ids)) ** 0.5
    out[2][at], out[3][at] = other, 1
    return out


def _embedded(p: dict[str, np.ndarray], pages: list[list[Block]]):
    """The network's input for the same, by sums of embeddings, and the mask."""
    tags, words, other, at = _bags(pages)
    x, mask = _blank(pages, 2 * EMBED + 5), _blank(pages, 1)
    rows = []
    for bags, table in ((tags, p["tags"]), (words, p["words"])):
        sizes = np.array([len(b) for b in bags])
        sums = np.zeros((sizes.sum() + 1, EMBED))
        np.cumsum(table[np.fromiter((i for b in bags for i in b), np.int64, sizes.sum())], axis=0, out=sums[1:])
        ends = np.cumsum(sizes)
        rows.append((sums[ends] - sums[ends - sizes]) / np.maximum(1, sizes)[:, None] ** 0.5)
    x[at], mask[at] = np.concatenate([*rows, other], axis=1), 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """One LSTM over time; masked steps keep the state."""
    z0 = x @ w + b
    steps, n, h = len(x), x.shape[1], HIDDEN
    state, cell, out, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), [], []
    for t in range(steps):
        z = z0[t] + state @ u
        gates = _sigmoid(z[:, : 3 * h])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        g = np.tanh(z[:, 3 * h :])
        new = f * cell + i * g
        tan = np.tanh(new)
        kept.append((i, f, o, g, tan, cell, state))
        m = mask[t]
        cell, state = m * new + (1 - m) * cell, m * (o * tan) + (1 - m) * state
        out.append(state)
    return np.stack(out), kept


def _unscan(grad: np.ndarray, kept, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray):
    """Gradients of ``_scan`` for its input and weights."""
    n, h = x.shape[1], HIDDEN
    dz_all = np.zeros((len(x), n, 4 * h), np.float32)
    du, dstate, dcell = np.zeros_like(u), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, tan, cell, state = kept[t]
        m = mask[t]
        dh = grad[t] + dstate
        dnew = m * (dcell + dh * o * (1 - tan * tan))
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), m * dh * tan * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += state.T @ dz
        dcell = dnew * f + (1 - m) * dcell
        dstate = dz @ u.T + (1 - m) * dh
    flat = dz_all.reshape(-1, 4 * h)
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _forward(p: dict[str, np.ndarray], tags, words, other, mask):
    return _through(p, np.concatenate([tags @ p["tags"], words @ p["words"], other], axis=2), mask)


def _through(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray):
    ahead, kept_a = _scan(x, mask, p["wa"], p["ua"], p["ba"])
    back, kept_b = _scan(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return _sigmoid(both @ p["v"] + p["c"])[:, :, 0], (x, kept_a, kept_b, both)


def _gradients(p: dict[str, np.ndarray], tags, words, other, mask, right: np.ndarray) -> dict[str, np.ndarray]:
    chance, (x, kept_a, kept_b, both) = _forward(p, tags, words, other, mask)
    d = ((chance - right)[:, :, None] * mask / mask.sum()).astype(np.float32)
    g = {"v": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "c": d.sum(axis=(0, 1))}
    dboth = d @ p["v"].T
    dx, g["wa"], g["ua"], g["ba"] = _unscan(dboth[:, :, :HIDDEN], kept_a, x, mask, p["wa"], p["ua"])
    dback, g["wb"], g["ub"], g["bb"] = _unscan(dboth[::-1, :, HIDDEN:], kept_b, x[::-1], mask[::-1], p["wb"], p["ub"])
    dx = dx + dback[::-1]
    g["tags"] = tags.reshape(-1, TAGS).T @ dx[:, :, :EMBED].reshape(-1, EMBED)
    g["words"] = words.reshape(-1, WORDS).T @ dx[:, :, EMBED : 2 * EMBED].reshape(-1, EMBED)
    return g


def train(pages: list[str], copies: int = COPIES, epochs: int = EPOCHS) -> Labeller:
    """A labeller from a bounded list of whole pages (see the module), by Adam on the cross-entropy of every block."""
    random = np.random.default_rng(SEED)
    scale = lambda *shape: (random.standard_normal(shape) * (1 / shape[0] ** 0.5)).astype(np.float32)
    width = 2 * EMBED + 5
    p = {"tags": scale(TAGS, EMBED) * 4, "words": scale(WORDS, EMBED), "v": scale(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}
    for d in "ab":
        p |= {f"w{d}": scale(width, 4 * HIDDEN), f"u{d}": scale(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
    own = [weak_labels(b) for b in map(blocks, pages) if b]
    pool = [b.text for page in own for b in page] or ["text"]
    whole = own + [_copy(page, pool, random) for page in own for _ in range(copies)]
    data = [page[i : i + TRAIN_BLOCKS] for page in whole for i in range(0, len(page), TRAIN_BLOCKS)]
    data.sort(key=len)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    batches = [data[i : i + 32] for i in range(0, len(data), 32)]
    for epoch in range(epochs if data else 0):
        for i in random.permutation(len(batches)):
            tags, words, other, mask = _inputs(batches[i])
            right = np.zeros(mask.shape[:2], np.float32)
            for j, page in enumerate(batches[i]):
                right[: len(page), j] = [b.main for b in page]
            # Words and paths are left out at times, so that neither is relied on alone.
            words = words * (random.random((*mask.shape[:2], 1)) < 0.6)
            tags = tags * (random.random((1, 1, TAGS)) < 0.9)
            grads, step = _gradients(p, tags.astype(np.float32), words.astype(np.float32), other, mask, right), step + 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Labeller(p)


def learn(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller from the ``sample`` pages with the smallest id hashes; only those reach the driver."""
    ids = pages.filter("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select("page_id", "html").distinct().collect()
    return train([r[1] for r in sorted(rows, key=lambda r: (r[0], r[1] or "")) if r[1]])


def main_text(labeller: Labeller, pages: list[str | None]) -> list[str]:
    split = [blocks(page) for page in pages]
    chances = labeller.probabilities(split)
    return ["\n".join(b.text for b, p in zip(page, chance) if p >= 0.5) for page, chance in zip(split, chances)]


def _extractor(labeller: Labeller):
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            pages = list(part)
            yield pd.Series([t for i in range(0, len(pages), 1024) for t in main_text(labeller, pages[i : i + 1024])], dtype=object)

    return run


def with_main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """``pages`` (page_id, html, ..) with ``text``, the main blocks joined by line ends, and ``n_chars``, its code points.

    A NULL or empty page, and one without main text, has an empty text. Every page is labelled alone, from its whole html, so
    repeated rows agree and ids may be NULL. Columns of ``pages`` with the new names are replaced.
    """
    rest = pages.drop("text", "n_chars")
    found = rest.withColumn("text", _extractor(labeller or learn(pages))(F.col("html")))
    return found.withColumn("n_chars", F.length("text").cast("long"))
