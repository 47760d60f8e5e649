"""Main text of web pages with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between the borders of block elements. Every block has the tags, classes and ids
of its whole path, pooled by mean, by maximum and by the innermost known name, so that wrappers of no meaning hide nothing;
its hashed words, and a few measures. A bidirectional LSTM (numpy) reads the blocks of a page in order and labels each as main
text or not. It is trained on ``TRAIN_PAGES`` generated pages whose blocks are known: articles in many kinds of containers and
neutral wrappers among menus, headers, footers, sidebars, notices, adverts, forms and comments.

Defined cases: a null or empty page has an empty text. Scripts, styles, templates, comments and the head never make blocks.
Character references are decoded once; white space (no-break spaces and ``<br>`` included) becomes one space. Elements
that are left open end with their parent, a paragraph at the next block. Whole pages are read; nothing is cut. Every
input row gives one output row; only the named columns are read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?/]")
MARK = re.compile(r"""[>"']""")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_]+")
# Kinds of HTML elements.
RAW = frozenset("script style noscript template svg textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)

WORD_SLOTS = 512
PATH_SIZE, WORD_SIZE, MEASURES, HIDDEN = 16, 6, 5, 20
TRAIN_PAGES, EPOCHS = 1200, 8
CACHED = 100_000
STEPS = 4096  # blocks of a page that are labelled at once
DEEPEST = 512  # elements within each other; as in browsers, a deeper one stands beside the last
BROKEN = 8  # tags with quotes that never close, after which quotes mean nothing


def slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots


class Slots(dict):
    """Hashed places of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED:
            self.clear()
        value = self[word] = slot(word, WORD_SLOTS)
        return value


class Names(dict):
    """Places of the names that mean something on pages; all others share one, so that made-up names tell nothing."""

    def __init__(self) -> None:
        known = sorted(set(STRUCTURE) | set(BUILDER_NAMES) | {part for n in (*" ".join(SIDE_NAMES.values()).split(), *MAIN_NAMES) for part in n.split("-")})
        super().__init__((name, i + 1) for i, name in enumerate(known))
        self.size = len(known) + 1

    def __missing__(self, name: str) -> int:
        return 0


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int) -> None:
        self.path, self.text, self.linked = path, text, linked


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    paths: dict[tuple, tuple] = {}  # equal paths are held once
    linked = links = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(path, text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, path
        if "&" in text:
            text = html.unescape(text)
        if not text.isspace():
            if not parts:
                path = tuple(x for _, names in stack for x in names)
                path = paths.setdefault(path, path)
            if links:
                linked += len(text)
        elif not parts:
            return
        parts.append(text)

    at, end = 0, len(page)
    for begin, stop, closing, tag, attributes in tokens(page):
        if begin > at:
            add(page[at:begin])
        at = max(at, stop)
        if tag is None:
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        block = tag not in INLINE
        if block:
            close()
        keep = len(stack)
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    keep = k
                    break
                if not block and stack[k][0] not in INLINE:
                    break
        elif tag not in VOID and block:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag == "li":
                    keep = k
                    break
                if stack[k][0] not in INLINE:
                    break
        if not closing and tag not in VOID:
            keep = min(keep, DEEPEST - 1)
        links -= sum(t == "a" for t, _ in stack[keep:])
        del stack[keep:]
        if not closing and tag not in VOID:
            names = [tag]
            if attributes:
                for found in NAMES.findall(attributes):
                    names += map(str.lower, PARTS.findall("".join(found)))
            stack.append((tag, names))
            links += tag == "a"
    if at < end:
        add(page[at:])
    close()
    return out


def tokens(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, closing, tag, attributes) of tags, and of comments and raw elements without a tag; linear in the page."""
    at, end, broken = 0, len(page), 0
    last = {q: page.rfind(q) for q in "\"'>"}
    while True:
        m = OPEN.search(page, at)
        if m is None:
            return
        tag = m.group(2)
        if tag is None:
            closer = "-->" if m.group() == "<!--" else ">"
            stop = page.find(closer, m.end())
            at = end if stop < 0 else stop + len(closer)
            yield m.start(), at, False, None, ""
            continue
        if last[">"] < m.end():
            # nothing closes any more: a tag that begins last is dropped, others are text
            if page.find("<", m.end()) < 0:
                yield m.start(), end, False, None, ""
            return
        stop, place = -1, m.end()
        while True:
            mark = MARK.search(page, place)
            if mark is None:
                break
            place = mark.end()
            if mark.group() == ">":
                stop = mark.start()
                break
            if broken < BROKEN and last[mark.group()] >= place:
                place = page.index(mark.group(), place) + 1
        if stop < 0:
            broken += 1
            stop = page.index(">", m.end())
        at, tag, attributes = stop + 1, tag.lower(), page[m.end() : stop]
        if tag in RAW and not m.group(1) and not attributes.endswith("/"):
            raw = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = raw.end() if raw else end
            yield m.start(), at, False, None, ""
        else:
            yield m.start(), at, bool(m.group(1)), tag, attributes


class Labeller:
    """Bidirectional LSTM over block vectors; the vectors of hashed names and words are learned as well."""

    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        inputs = 3 * PATH_SIZE + WORD_SIZE + MEASURES
        w = {"path": rng.normal(0, 0.3, (Names().size, PATH_SIZE)), "word": rng.normal(0, 0.1, (WORD_SLOTS, WORD_SIZE))}
        for side in ("f", "b"):
            w[f"x{side}"] = rng.normal(0, inputs**-0.5, (inputs, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"c{side}"] = np.zeros(4 * HIDDEN)
            w[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1.0
        w["out"] = rng.normal(0, 0.2, (2 * HIDDEN + inputs, 1))
        w["bias"] = np.zeros(1)
        self.w = w

    @staticmethod
    def features(pages: list[list[Block]], names: Names, words: Slots) -> tuple[list, list, np.ndarray]:
        """Per block: places of the names of the whole path, slots of the words, measures."""
        paths, texts, measures = [], [], []
        for page in pages:
            for i, b in enumerate(page):
                paths.append([names[x] for x in b.path] or [0])
                texts.append([words[x] for x in b.text.lower().split()])
                n = len(b.text)
                measures.append((np.log1p(n) / 6, b.linked / max(n, 1), np.log1p(len(b.path)) / 3, sum(map(b.text.count, ".,!?")) * 5 / (n + 5), i / (len(page) + 5)))
        return paths, texts, np.array(measures).reshape(-1, MEASURES)

    @staticmethod
    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((x for y in lists for x in y), np.int64, int(sizes.sum())), sizes, np.cumsum(sizes) - sizes

    def vectors(self, pages: list[list[Block]], names: Names, words: Slots) -> tuple[np.ndarray, tuple]:
        """Input vectors of all blocks: of the path the mean, the largest and the innermost known name; of the words the mean."""
        paths, texts, measures = self.features(pages, names, words)
        p, p_sizes, p_start = self.flat(paths)
        q, q_sizes, q_start = self.flat(texts)
        inner = np.array([next((x for x in reversed(y) if x), 0) for y in paths], np.int64)
        table = self.w["path"][p]
        if not len(paths):
            return np.empty((0, 3 * PATH_SIZE + WORD_SIZE + MEASURES)), ()
        mean = np.add.reduceat(table, p_start, axis=0) / p_sizes[:, None]
        most = np.maximum.reduceat(table, p_start, axis=0)
        word = np.add.reduceat(self.w["word"][q], q_start, axis=0) / q_sizes[:, None]
        return np.concatenate([mean, most, self.w["path"][inner], word, measures], axis=1), (p, p_sizes, table, most, p_start, inner, q, q_sizes)

    def run(self, x: np.ndarray, mask: np.ndarray, side: str, trace: list | None = None, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
        """Hidden states (pages, steps, HIDDEN) of one direction, and the last state; masked steps leave the state as it is."""
        w, u, c0 = self.w[f"x{side}"], self.w[f"h{side}"], self.w[f"c{side}"]
        pre = x @ w + c0
        n, steps = mask.shape
        h, c = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        out = np.zeros((n, steps, HIDDEN))
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            a = pre[:, t] + h @ u
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            new = f * c + i * g
            th = np.tanh(new)
            if trace is not None:
                trace.append((t, i, f, o, g, c, th, h, m))
            c, h = np.where(m, new, c), np.where(m, o * th, h)
            out[:, t] = h
        return out, (h, c)

    def back(self, d: np.ndarray, x: np.ndarray, trace: list, side: str, grads: dict) -> np.ndarray:
        w, u = self.w[f"x{side}"], self.w[f"h{side}"]
        dh, dc = np.zeros(d[:, 0].shape), np.zeros(d[:, 0].shape)
        da_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        gu = np.zeros_like(u)
        for t, i, f, o, g, c, th, h, m in reversed(trace):
            dh = dh + d[:, t]
            live = np.where(m, dh, 0)
            dnew = np.where(m, dc, 0) + live * o * (1 - th**2)
            da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            da_all[:, t] = da
            gu += h.T @ da
            dh = np.where(m, da @ u.T, dh)
            dc = np.where(m, dnew * f, dc)
        grads[f"h{side}"] = gu
        grads[f"x{side}"] = np.einsum("nti,ntj->ij", x, da_all)
        grads[f"c{side}"] = da_all.sum((0, 1))
        return da_all @ w.T

    def forward(self, pages: list[list[Block]], names: Names, words: Slots) -> tuple:
        vectors, kept = self.vectors(pages, names, words)
        sizes = np.fromiter(map(len, pages), np.int64, len(pages))
        mask = np.arange(sizes.max(initial=1))[None, :] < sizes[:, None]
        x = np.zeros((*mask.shape, vectors.shape[1]))
        x[mask] = vectors
        tf, tb = [], []
        z = np.concatenate([self.run(x, mask, "f", tf)[0], self.run(x, mask, "b", tb)[0], x], axis=2)
        logit = (z @ self.w["out"])[:, :, 0] + self.w["bias"]
        return logit, mask, x, z, tf, tb, kept

    def labels(self, pages: list[list[Block]], names: Names, words: Slots, cells: int = 20_000) -> list[np.ndarray]:
        """Main text or not, per page and block; pages of similar length run together, long ones in stretches."""
        out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and len(pages[order[end]]) * (end - at + 1) <= cells:
                end += 1
            some = [pages[i] for i in order[at:end]]
            longest = max(map(len, some))
            sizes = np.array(list(map(len, some)))

            def stretch(begin: int) -> tuple[np.ndarray, np.ndarray]:
                mask = np.arange(begin, min(begin + STEPS, longest))[None, :] < sizes[:, None]  # noqa: B023
                part = [p[begin : begin + STEPS] for p in some]  # noqa: B023
                vectors, _ = self.vectors(part, names, words)
                # the place in the page counts from its begin
                offset = np.concatenate([(begin + np.arange(len(q))) / (len(p) + 5) for p, q in zip(some, part, strict=True)])  # noqa: B023
                vectors[:, -1] = offset
                x = np.zeros((*mask.shape, vectors.shape[1]))
                x[mask] = vectors
                return x, mask

            begins = range(0, longest, STEPS)
            behind, state = {}, None
            for begin in reversed(begins):
                x, mask = stretch(begin)
                behind[begin], state = self.run(x, mask, "b", None, state)
            state, logits = None, []
            for begin in begins:
                if len(begins) > 1:
                    x, mask = stretch(begin)
                ahead, state = self.run(x, mask, "f", None, state)
                logits.append((np.concatenate([ahead, behind.pop(begin), x], axis=2) @ self.w["out"])[:, :, 0] + self.w["bias"])
            logit = np.concatenate(logits, axis=1)
            for row, i in enumerate(order[at:end]):
                out[i] = logit[row, : len(pages[i])] > 0
            at = end
        return out

    def fit(self, pages: list[list[Block]], truth: list[np.ndarray], epochs: int = EPOCHS, batch: int = 40, rate: float = 1e-2, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        names, words = Names(), Slots()
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(pages), batch):
                some = [pages[i] for i in order[at : at + batch]]
                logit, mask, x, z, tf, tb, (p, p_sizes, table, most, p_start, inner, q, q_sizes) = self.forward(some, names, words)
                y = np.zeros(mask.shape)
                y[mask] = np.concatenate([truth[i] for i in order[at : at + batch]])
                d = np.where(mask, 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y, 0)[:, :, None] / mask.sum()
                grads = {"out": np.einsum("nti,ntj->ij", z, d), "bias": d.sum((0, 1))}
                dz = d @ self.w["out"].T
                dx = dz[:, :, 2 * HIDDEN :] + self.back(dz[:, :, :HIDDEN], x, tf, "f", grads) + self.back(dz[:, :, HIDDEN : 2 * HIDDEN], x, tb, "b", grads)
                dx = dx[mask]
                d_mean, d_most, d_inner, d_word = np.split(dx[:, : 3 * PATH_SIZE + WORD_SIZE], [PATH_SIZE, 2 * PATH_SIZE, 3 * PATH_SIZE], axis=1)
                top = table == np.repeat(most, p_sizes, axis=0)
                ties = np.repeat(np.add.reduceat(top.astype(float), p_start, axis=0), p_sizes, axis=0)
                grads["path"], grads["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
                np.add.at(grads["path"], p, np.repeat(d_mean / p_sizes[:, None], p_sizes, axis=0) + top * np.repeat(d_most, p_sizes, axis=0) / ties)
                np.add.at(grads["path"], inner, d_inner)
                np.add.at(grads["word"], q, np.repeat(d_word / q_sizes[:, None], q_sizes, axis=0))
                step += 1
                now = rate * (1 - epoch / epochs) + rate / 10
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


# Names that pages give to their parts.
SIDE_NAMES = {
    "menu": "menu nav navigation navbar topnav main-menu menu-list mainnav links",
    "header": "header site-header masthead top topbar logo branding page-header",
    "footer": "footer site-footer bottom copyright legal colophon page-footer foot",
    "sidebar": "sidebar side widget widget-area rail secondary related recent-posts sidebar-right more popular",
    "notice": "notice cookie cookie-banner alert consent gdpr banner popup modal newsletter subscribe announcement warning",
    "advert": "ad ads advert advertisement ad-slot sponsor sponsored promo banner-ad adsbox promotion",
    "form": "search login signup contact-form searchform form",
    "comments": "comments comment-list comment respond discussion replies disqus reader-comments thread reply",
    "small": "share social breadcrumb breadcrumbs tags pagination pager meta byline toolbar",
}
STRUCTURE = "html body div section article main nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 table tr td th blockquote pre figure figcaption dl dt dd button label select option fieldset details summary address input".split()
PLAIN_NAMES = "container wrapper wrap row col inner outer grid flex block box layout page site app root group column area holder md sm lg xl fluid center clearfix elementor widget-wrap vc stack shell card panel".split()
BUILDER_NAMES = "elementor vc wp et pb fl fusion block module element section container column widget inner text editor wrap row group".split()
MAIN_NAMES = "content main post entry story article article-body post-content entry-content body-text text main-content page-content post-body story-body".split()
NOTICE_WORDS = "we use cookies to improve your experience accept privacy policy subscribe to our newsletter sign up log in search share terms all rights reserved".split()


class Writer:
    """Generates pages with known main text."""

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.main: set[str] = set()
        self.syllables = [a + b for a in "b d f g l m n r s t v th sch qu é ü ñ c p".split() for b in "a e i o u en er on in au ié".split()]

    def one(self, *values: str) -> str:
        return str(self.rng.choice(list(values)))

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, low: int, high: int) -> str:
        # new words each time, so that none of them tells anything
        parts = self.rng.choice(self.syllables, (self.rng.integers(low, high), 3))
        words = ["".join(p[: k + 1]) for p, k in zip(parts.tolist(), self.rng.integers(0, 3, len(parts)).tolist(), strict=True)]
        if self.chance(0.3):
            words[self.rng.integers(len(words))] = self.one(*NOTICE_WORDS)
        return " ".join(words).capitalize() + self.one(".", ".", "", "!", " &amp; " + words[0] + ".")

    def phrase(self, low: int = 1, high: int = 12) -> str:
        if self.chance(0.4):
            return " ".join(self.rng.choice(NOTICE_WORDS, self.rng.integers(low, high)))
        return self.prose(low, high + 14)

    def own(self, tag: str, text: str) -> str:
        self.main.add(" ".join(html.unescape(re.sub("<[^>]*>", "", text)).split()))
        return f"<{tag}>{text}" + self.one(f"</{tag}>", f"</{tag}>", f"</{tag}>", "<br>" if tag == "p" else f"</{tag}>")

    def within(self, kind: str, inner: str) -> str:
        name = self.one(*SIDE_NAMES[kind].split())
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section", "advert": "aside"}.get(kind, "div")
        tag = self.one(tag, tag, "div", "div", "section")
        mark = self.one(f' class="{name}"', f' id="{name}"', f' class="{name} x{self.rng.integers(9)}"')
        return self.wrapped(f"<{tag}{mark if tag in ('div', 'section') or self.chance(0.4) else ''}>{self.wrapped(inner, 3)}</{tag}>", 4)

    def made_up(self) -> str:
        """Names that say nothing: of a grid, of a builder, or hashed."""
        kind = self.rng.random()
        if kind < 0.25:
            return self.one("elementor-", "vc_", "wp-block-", "et_pb_", "fl-", "fusion-") + self.one("section", "container", "column", "widget", "widget-wrap", "element", "text-editor", "row", "module", "inner", "group", "text")
        if kind < 0.5:
            return " ".join(self.rng.choice(PLAIN_NAMES, self.rng.integers(1, 4)))
        if kind < 0.7:
            return self.one("col-md-8 col-sm-12", "col-lg-9", "col-xs-12 col-md-7", "w-full max-w-4xl mx-auto", "x y", "a b", "c1")
        return " ".join("".join(self.rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEF0123456789"), self.rng.integers(2, 9))) + self.one("", "", "_3", "-" + str(self.rng.integers(99))) for _ in range(self.rng.integers(1, 3)))

    def wrapped(self, inner: str, most: int) -> str:
        """Inside some neutral elements."""
        for _ in range(self.rng.integers(0, most + 1) if self.chance(0.5) else 0):
            inner = f'<div{self.one("", f""" class="{self.made_up()}\"""", f""" class="{self.made_up()}\"""", f""" id="{self.made_up()}\"""")}>{inner}</div>'
        return inner

    def links(self) -> str:
        items = [f'<a href="/{i}">{self.phrase(1, 3)}</a>' for i in range(self.rng.integers(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else " ".join(items)

    def texts(self, most: int) -> str:
        tags = [self.one("p", "p", "h3", "div", "span", "li") for _ in range(self.rng.integers(1, most + 1))]
        return "".join(f"<{t}>{self.phrase()}</{t}>" for t in tags) if self.chance(0.6) else self.phrase(3, 20)

    def side(self, kind: str) -> str:
        if kind == "menu":
            return self.within(kind, self.links())
        if kind == "header":
            return self.within(kind, self.one("", f"<h1>{self.phrase(1, 4)}</h1>", f"<div>{self.phrase(1, 4)}</div>") + (self.side("menu") if self.chance(0.5) else self.phrase(1, 6)))
        if kind == "footer":
            return self.within(kind, self.one("&copy; ", "", "Copyright 2024 ") + self.phrase(2, 12) + (self.links() if self.chance(0.4) else ""))
        if kind == "form":
            return self.within(kind, f"<label>{self.phrase(1, 3)}</label><input name=q><select><option>{self.phrase(1, 2)}<option>{self.phrase(1, 2)}</select><button>{self.phrase(1, 2)}</button>")
        if kind == "comments":
            each = [f'<{t} class="comment"><b>{self.phrase(1, 2)}</b><p>{self.prose(4, 50)}</p></{t}>' for t in [self.one("div", "li", "article")] * self.rng.integers(1, 6)]
            return self.within(kind, self.one("", "<h3>Comments</h3>", "<h2>Responses</h2>") + "".join(each))
        if kind == "sidebar":
            return self.within(kind, f"<h3>{self.phrase(1, 4)}</h3>" * self.chance(0.6) + (self.links() if self.chance(0.5) else self.texts(4)))
        return self.within(kind, self.texts(2))

    def article(self) -> str:
        out = [self.own("h1", self.prose(2, 14))] if self.chance(0.8) else []
        if out and self.chance(0.15):
            out = [f"<header>{out[0]}</header>"]
        for _ in range(self.rng.integers(1, 14)):
            kind = self.rng.random()
            if kind < 0.72:
                lead = self.one("", "", "", "<b>", "<em>", f"<b>{self.prose(1, 3)}</b> ", f'<a href="/w">{self.prose(1, 4)}</a> ')
                out.append(self.own("p", lead + self.prose(1, 90)))
            elif kind < 0.80:
                out.append(self.own(self.one("h2", "h3", "blockquote", "pre"), self.prose(2, 20)))
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.own("li", self.prose(2, 20)) for _ in range(self.rng.integers(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append("<table><tr>" + "".join(self.own("td", self.prose(1, 6)) for _ in range(3)) + "</tr></table>")
            elif kind < 0.93:
                out.append(self.own("div", self.prose(5, 60)))
            else:
                out.append(self.side(self.one("advert", "small", "notice", "sidebar", "form")))
        if self.chance(0.3):
            out = [self.wrapped(x, 2) for x in out]
        inner = self.wrapped("".join(out), 6)
        name = self.one(*MAIN_NAMES)
        box = self.rng.random()
        if box < 0.45:
            inner = f"<article>{inner}</article>"
        elif box < 0.6:
            inner = f"<main>{inner}</main>"
        elif box < 0.9:
            inner = f'<div {self.one("class", "id")}="{name}">{inner}</div>'
        if self.chance(0.3):
            inner = f'<div {self.one("class", "id")}="{self.one("wrapper", "container", "page", "row", *MAIN_NAMES)}">{inner}</div>'
        return self.wrapped(inner, 8)

    def page(self) -> tuple[list[Block], np.ndarray]:
        self.main = set()
        before = [self.side(k) for k in ("header", "menu", "notice", "advert", "form", "small", "sidebar") if self.chance(0.4)]
        after = [self.side(k) for k in ("small", "comments", "sidebar", "advert", "form", "notice", "footer") if self.chance(0.45)]
        self.rng.shuffle(before)
        body = "".join(before) + self.article() + "".join(after)
        text = "<!DOCTYPE html><html><head><title>t</title></head><body>" + self.wrapped(body, 3) + "</body></html>"
        found = blocks(text)
        return found, np.array([b.text in self.main for b in found], float)


@cache
def trained(pages: int = TRAIN_PAGES, seed: int = 1) -> Labeller:
    writer = Writer(seed)
    made = [writer.page() for _ in range(pages)]
    made = [(b, y) for b, y in made if b]
    labeller = Labeller()
    labeller.fit([b for b, _ in made], [y for _, y in made])
    return labeller


def main_text(pages: DataFrame, labeller: Labeller | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every row with ``text`` and ``n_chars``."""
    labeller = labeller or trained()

    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, words = Names(), Slots()
        for batch in batches:
            out = []
            for at in range(0, len(batch), 512):
                found = [blocks(x) if isinstance(x, str) else [] for x in batch.iloc[at : at + 512]]
                labels = labeller.labels(found, names, words)
                out += ["\n".join(b.text for b, y in zip(page, label, strict=True) if y) for page, label in zip(found, labels, strict=True)]
            yield pd.DataFrame({"text": out, "n_chars": list(map(len, out))})

    extract = F.pandas_udf(extracted, "text string, n_chars long")
    rows = pages.select(F.struct(*keep).alias("k"), extract(F.col(html_col).cast("string")).alias("r"))
    return rows.select("k.*", "r.*")
