"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each
block has a vector of its tag path (hashed names and classes of the elements around it), a vector
of its hashed words, and a few counts. A bidirectional LSTM in numpy reads the whole sequence and
gives each block the probability of belonging to the article; blocks above one half are joined.

The labeller is trained here, on pages made by `example_page` from a fixed seed, whose labels are
known; no table is read for it. The weights depend only on the arguments of `train`.

Edge cases. A null or empty html gives the empty text. Unclosed and crossed tags are repaired as
they come, text outside any element counts, and an unfinished tag or comment at the end of a page
ends it. Of a deep tag path the innermost names count; pages of many thousand blocks are read in overlapping
stretches. Character references are decoded after the split into blocks. Repeated rows are treated
alike; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A quote is one only after an equals sign; elsewhere in a tag it is a character like others.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "textarea", "title"}
#: Of these, those that end with the page if nothing else ends them, and those that can hold their like.
ENDLESS = {"script", "style"}
NESTING = {"template", "svg", "object"}
#: Names of a path that count, the innermost ones.
DEEPEST = 64
#: Longer pages are read in stretches of so many blocks, each with so many more on either side.
STRETCH, BESIDE = 8192, 256
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that do not end a block.
INLINE = set("math mi mn mo ms mtext mrow msup msub mfrac msqrt a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())

PATH, WORDS, COUNTS = 96, 48, 6
SIZE = PATH + WORDS + COUNTS
HIDDEN = 16


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # elements, each with the names on the path down to it
    open_: Counter[str] = Counter()
    held: list[str] = []
    path: tuple[str, ...] = ()
    linked = at = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append(Block(path, text, linked))
        held.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            m_start, m_end = end, end
        else:
            m_start, m_end = m.span()
        if m_start > at:
            if not held:
                path = stack[-1][1] if stack else ()
            held.append(page[at:m_start])
            linked += (m_start - at) * (open_["a"] > 0)
        at = m_end
        name = (m.group(2) or "").lower() if m else ""
        if not name:
            continue
        if name == "br":
            held.append(" ")
        if name not in INLINE:
            close()
        if m.group(1):
            if open_[name] > 0:
                while pop() != name:
                    pass
            continue
        if name in SILENT and not m.group(3).rstrip().endswith("/"):
            at = _silent_end(page, at, name)
            continue
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if name not in INLINE:  # a new block-level element ends an open paragraph, item or cell of its kind
            while stack and (stack[-1][0] in INLINE or (stack[-1][0] == name and name in ("p", "li", "td", "th", "tr", "option", "dt", "dd")) or stack[-1][0] == "p"):
                pop()
        names = [name]
        for a, b, c in NAMES.findall(m.group(3)):
            names += ["." + x for x in re.split(r"[^a-z]+", (a or b or c).lower()) if x]
        stack.append((name, ((stack[-1][1] if stack else ()) + tuple(names))[-DEEPEST:]))
        open_[name] += 1
    close()
    return out


@lru_cache(maxsize=64)
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}\b[^>]*(?:>|\Z)", re.I)


def _silent_end(page: str, at: int, name: str) -> int:
    """Where the content of a silent element that begins at `at` ends. One that is never closed, or opened again
    before it is closed, was left open by mistake and hides nothing; scripts and styles go on to the end."""
    depth = 1
    for m in _ends(name).finditer(page, at):
        if m.group(1):
            depth -= 1
            if not depth:
                return m.end()
        elif name in NESTING:
            depth += 1
        elif name not in ENDLESS:
            return at
    return len(page) if name in ENDLESS else at


# ---- features


def _slot(word: str, slots: int) -> tuple[int, float]:
    h = crc32(word.encode("utf-8", "surrogatepass"))
    return h % slots, 1.0 if h >> 31 else -1.0


class _WordSlots(dict):
    """Word to slot; words of negative sign have the second half of the slots."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        i, sign = _slot(word, WORDS)
        self[word] = i = i + WORDS * (sign < 0)
        return i


_WORD_SLOTS = _WordSlots()


@lru_cache(maxsize=1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for depth, name in enumerate(path):
        # Each name counts as itself; the innermost two also by their place.
        for key in (name, *((f"{len(path) - depth}:{name}",) if len(path) - depth <= 2 else ())):
            i, sign = _slot("path " + key, PATH)
            v[i] += sign
    return v


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), SIZE), np.float32)
    for row, b in zip(out, page):
        row[:PATH] = _path_vector(b.path)
        words = b.text.lower().split()
        counts = np.bincount([_WORD_SLOTS[w] for w in words], minlength=2 * WORDS)
        row[PATH : PATH + WORDS] = (counts[:WORDS] - counts[WORDS:]) / (2 * np.linalg.norm(counts))
        n = len(b.text)
        row[PATH + WORDS :] = (np.log1p(len(words)) / 4, min(1, b.linked / n), sum(map(b.text.count, ".,!?")) / len(words or " "), np.log1p(n) / 8, b.text[-1] in ".!?", 1)
    return out


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[d + "x"] = (rng.standard_normal((SIZE, 4 * HIDDEN)) * 0.08).astype(np.float32)
            w[d + "h"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            w[d + "b"] = bias
        w["o"] = (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction. x is time, page, feature; masked steps pass the state on."""
        steps, pages, _ = x.shape
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        given = x @ self.w[d + "x"] + self.w[d + "b"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.w[d + "h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            cell = m * new + (1 - m) * c
            tanh = np.tanh(cell)
            state = m * (o * tanh) + (1 - m) * h
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            h, c = state, cell
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], axis=2)
        return _sigmoid(both @ self.w["o"] + self.w["c"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(x, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        p = _sigmoid(both @ self.w["o"] + self.w["c"])
        total = max(1.0, float(mask.sum()))
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        e = mask * (p - y) / total
        grad = {"o": np.tensordot(e, both, ([0, 1], [0, 1])), "c": np.array([e.sum()], np.float32)}
        for n, d in enumerate("fb"):
            given = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            wh, gh = self.w[d + "h"], np.zeros_like(self.w[d + "h"])
            for t, h, c, i, f, o, g, tanh, m in reversed(kept[d]):
                dh = dh + e[t][:, None] * self.w["o"][n * HIDDEN : (n + 1) * HIDDEN]
                inner = m * dh
                cell = dc + inner * o * (1 - tanh**2)
                new = m * cell
                dz = np.concatenate([new * g * i * (1 - i), new * c * f * (1 - f), inner * tanh * o * (1 - o), new * i * (1 - g**2)], axis=1)
                given[t] = dz
                gh += h.T @ dz
                dh = (1 - m) * dh + dz @ wh.T
                dc = (1 - m) * cell + new * f
            grad[d + "h"] = gh
            grad[d + "x"] = np.tensordot(x, given, ([0, 1], [0, 1]))
            grad[d + "b"] = given.sum((0, 1))
        return loss, grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), SIZE), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i] = p
        mask[: len(p), i] = 1
    return x, mask


# ---- training pages

#: Words that stand in boilerplate of each kind.
PHRASES = {
    "menu": "home about contact news products services login search blog shop account archive help sitemap",
    "header": "welcome site name tagline subscribe search menu sign in register",
    "footer": "© copyright all rights reserved privacy policy terms imprint · contact powered by",
    "aside": "related articles popular posts tags categories recent most read trending follow us share",
    "notice": "we use cookies accept reject settings consent notice warning update your browser newsletter",
    "advert": "advertisement sponsored buy now offer sale discount promo deal click here",
    "form": "name email password send submit message required field subscribe",
    "comments": "comment reply posted by said ago likes report great thanks agree first",
}


def example_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it belongs to the article."""
    vowels, letters = "aeiouéèüöñ", "bcdfghklmnprstvz"
    kind = rng.random()

    def word() -> str:
        w = "".join(rng.choice(letters) + rng.choice(vowels) + rng.choice(["", "", "n", "r", "st"]) for _ in range(rng.randint(1, 4)))
        return w.upper() + "!!" if kind < 0.1 else w + rng.choice(["***", "%%%", "$$$", "&amp;&amp;&amp;"]) if kind < 0.2 else w

    def sentence(n: int) -> str:
        style = rng.random()
        if style < 0.06:  # one word, again and again
            s = " ".join([word()] * (3 * n))
        elif style < 0.12:  # a flattened table
            s = " | ".join(word() for _ in range(n)) + "."
            return s[:1].upper() + s[1:] + " |" * (rng.random() < 0.5)
        else:
            s = " ".join(word() for _ in range(n))
        return s[:1].upper() + s[1:] + rng.choice([".", ".", "!", "?"])

    def prose() -> str:
        return " ".join(sentence(rng.randint(1, 14)) for _ in range(rng.choice([1, 1, 2, 3, 6, 12])))

    out: list[str] = []
    labels: list[bool] = []

    def put(markup: str, text: str, main: bool) -> None:
        out.append(markup.format(text))
        labels.append(main)

    def phrase(name: str, n: int) -> str:
        if rng.random() < 0.45:
            return sentence(rng.randint(1, 2 * n))
        return " ".join(rng.choice(PHRASES[name].split()) if rng.random() < 0.7 else word() for _ in range(n))

    def links(tag: str, name: str, n: int) -> None:
        out.append(tag)
        for _ in range(n):
            put('<li><a href="/x">{}</a></li>', phrase(name, rng.randint(1, 2)), False)
        out.append("</ul>")

    def junk(name: str) -> None:
        if name == "menu":
            open_, close_ = rng.choice([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="nav">', "</div>"), ('<nav class="navbar">', "</nav>"), ('<div class="breadcrumb">', "</div>"), ('<div role="navigation">', "</div>"), ('<div class="top-links">', "</div>"), ('<td class="left nav">', "</td>"), ('<div class="toc">', "</div>"), ('<div id="sitemap" class="navbox">', "</div>")])
            links(open_ + "<ul>", "menu", rng.randint(2, 9))
            if rng.random() < 0.2:  # a line of links
                out.append(rng.choice(['<p class="crumbs">', "<td>", '<div class="links">', "<p>"]))
                put(" | ".join(f'<a href="/{i}">{phrase("menu", 1)}</a>' for i in range(rng.randint(2, 6))) + "{}", "", False)
                out.append("</td></p></div>")
            out.append(close_)
            return
        shapes = {
            "header": [("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead">', "</div>"), ('<div class="site-header top">', "</div>"), ('<div class="banner">', "</div>")],
            "footer": [("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"), ('<div class="copyright">', "</div>"), ('<footer class="site-footer">', "</footer>")],
            "aside": [("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar">', "</div>"), ('<div class="widget related">', "</div>"), ('<aside class="sidebar">', "</aside>"), ('<div class="share social">', "</div>"), ('<div id="catlinks" class="catlinks">', "</div>"), ('<td class="right">', "</td>"), ('<div class="navbox">', "</div>"), ('<div class="tags">', "</div>")],
            "notice": [('<div class="cookie-banner">', "</div>"), ('<div class="notice">', "</div>"), ('<div id="cookie-consent">', "</div>"), ('<div class="newsletter popup">', "</div>"), ('<div class="alert">', "</div>"), ('<section class="notice">', "</section>")],
            "advert": [('<div class="ad">', "</div>"), ('<div class="ads">', "</div>"), ('<div class="advert">', "</div>"), ('<div id="advertisement">', "</div>"), ('<div class="sponsored promo">', "</div>"), ('<aside class="ad">', "</aside>")],
            "form": [("<form>", "</form>"), ('<form class="search">', "</form>"), ('<form id="login" action="/l">', "</form>"), ('<div class="form"><form>', "</form></div>")],
            "comments": [('<div class="comments">', "</div>"), ('<section id="comments">', "</section>"), ('<div class="comment-list">', "</div>"), ('<section class="comments">', "</section>"), ('<ol class="comment">', "</ol>"), ('<div class="comment-body">', "</div>"), ('<ul class="commentlist">', "</ul>"), ('<div id="respond" class="replies">', "</div>")],
        }[name]
        open_, close_ = rng.choice(shapes)
        out.append(open_)
        for _ in range(rng.choice([1, 1, 2, 4]) if name != "comments" else rng.randint(1, 6)):
            long = name in ("comments", "advert", "notice") and rng.random() < 0.5
            text = prose() if long else phrase(name, rng.randint(1, 9))
            put(rng.choice(["<p>{}</p>", "<div>{}</div>", "<p><b>{}</b></p>"]) if name != "form" else rng.choice(["<label>{}</label>", "<p>{}</p>", "<button>{}</button>"]), text, False)
        if name in ("header", "footer", "aside") and rng.random() < 0.5:
            links("<ul>", name, rng.randint(1, 5))
        elif rng.random() < 0.5:
            out.append("<!-- x -->")
        out.append(close_)

    def bare(name: str) -> None:
        """One block right inside its container, as many pages have it."""
        tag = {"footer": ["<footer>{}</footer>", '<div class="footer">{}</div>'], "advert": ['<div class="ad">{}</div>', '<div class="advert">{}</div>', '<div class="ad-box">{}</div>'], "notice": ['<div class="notice">{}</div>', '<div class="cookie">{}</div>'], "header": ["<header>{}</header>", '<div class="header">{}</div>']}[name]
        put(rng.choice(tag), prose() if rng.random() < 0.5 else phrase(name, rng.randint(2, 9)), False)

    out.append("<html><head><title>" + sentence(4) + "</title><style>p{{}}</style></head><body>".replace("{{}}", "{margin:0}"))
    for name, chance in (("notice", 0.25), ("header", 0.4), ("menu", 0.8), ("aside", 0.15), ("advert", 0.4)):
        if rng.random() < chance:
            bare(name) if name in ("notice", "header", "advert") and rng.random() < 0.5 else junk(name)
    open_, close_ = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<main><article class="post">', "</article></main>"), ('<div class="article">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post-content entry">', "</div>"), ('<section class="content">', "</section>"), ("<div>", "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="mw-parser-output">', "</div>"), ('<table><tr><td class="main">', "</td></tr></table>"), ('<table class="layout"><tr><td>', "</td></tr></table>"), ('<div class="story text">', "</div>"), ('<div itemprop="articleBody">', "</div>")])
    out.append(open_)
    if rng.random() < 0.85:
        put(rng.choice(["<h1>{}</h1>", "<h1 class=\"title\">{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]), sentence(rng.randint(1, 8)), True)
    for _ in range(rng.choice([1, 2, 3, 5, 9, 20])):
        r = rng.random()
        if r < 0.06:
            put("<h2>{}</h2>", sentence(rng.randint(1, 5)), True)
        elif r < 0.1:
            put("<blockquote>{}</blockquote>", prose(), True)
        elif r < 0.15:
            out.append("<ul>")
            for _ in range(rng.randint(1, 4)):
                put("<li>{}</li>", sentence(rng.randint(1, 10)), True)
            out.append("</ul>")
        elif r < 0.2:
            junk(rng.choice(["advert", "aside", "form"])) if rng.random() < 0.7 else bare("advert")
        elif r < 0.23:
            out.append("<table><tr>")
            for _ in range(rng.randint(1, 4)):
                put("<td>{}</td>", sentence(2), True)
            out.append("</tr></table>")
        elif r < 0.27:  # linked items, terms, code, captions
            shape = rng.choice(['<ul><li><a href="/y">{}</a> LATER</li></ul>', "<dl><dt>{}</dt></dl>", "<dl><dd>{}</dd></dl>", "<pre><code>{}</code></pre>", "<figure><figcaption>{}</figcaption></figure>", "<h3>{}</h3>", "<ol><li><a href='z'>{}</a></li></ol>"])
            put(shape.replace("LATER", sentence(3)), sentence(rng.randint(2, 12)), True)
        elif r < 0.36:  # prose full of links
            words = prose().split()
            put("<p>{}</p>", " ".join(f'<a href="/w">{w}</a>' if rng.random() < 0.3 else w for w in words), True)
        else:
            put(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p><b>{}<br>", "<div>{}</div>", "<p>{} <a href=\"/\">x</a></p>"]), prose(), True)
    if rng.random() < 0.15:
        junk("comments")
    out.append(close_)
    for name, chance in (("comments", 0.25), ("advert", 0.15), ("aside", 0.3), ("form", 0.2), ("menu", 0.1), ("notice", 0.1), ("footer", 0.85)):
        if rng.random() < chance:
            bare(name) if name in ("footer", "advert", "notice") and rng.random() < 0.5 else junk(name)
    out.append("</body></html>")
    return "".join(out), labels


@lru_cache(maxsize=2)
def train(pages: int = 3000, epochs: int = 9, batch: int = 24, seed: int = 11, rate: float = 0.006) -> Labeller:
    """Fit a labeller by Adam on so many example pages."""
    rng = random.Random(seed)
    examples = []
    while len(examples) < pages:
        page, labels = example_page(rng)
        found = blocks(page)
        if len(found) == len(labels):
            examples.append((features(found), np.array(labels, np.float32)))
    net = Labeller.start(seed)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(examples)
        ordered = sorted(range(len(examples)), key=lambda i: len(examples[i][1]) + rng.random())
        groups = [ordered[i : i + batch] for i in range(0, len(ordered), batch)]
        rng.shuffle(groups)
        for group in groups:
            x, mask = _padded([examples[i][0] for i in group])
            y = np.zeros_like(mask)
            for k, i in enumerate(group):
                y[: len(examples[i][1]), k] = examples[i][1]
            _, grad = net.gradients(x, mask, y)
            step += 1
            norm = max(1.0, float(np.sqrt(sum((g**2).sum() for g in grad.values()))))
            for k, g in grad.items():
                g = g / norm
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                now = rate * (1 - 0.8 * epoch / epochs)
                net.w[k] = (net.w[k] - now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# ---- the operator


def label(net: Labeller, pages: list[list[Block]], batch: int = 64) -> list[np.ndarray]:
    """The probability of each block of each page."""
    parts = [(i, a) for i, page in enumerate(pages) for a in range(0, len(page), STRETCH)]
    taken = [pages[i][max(0, a - BESIDE) : a + STRETCH + BESIDE] for i, a in parts]
    found: list[np.ndarray] = [np.empty(0, np.float32)] * len(parts)
    order = sorted(range(len(parts)), key=lambda n: len(taken[n]))
    for a, b in slices([len(taken[n]) * 16 for n in order], 16 * 64 * batch):
        x, mask = _padded([features(taken[n]) for n in order[a:b]])
        p = net.scores(x, mask)
        for k, n in enumerate(order[a:b]):
            skip = min(parts[n][1], BESIDE)
            found[n] = p[skip : min(len(taken[n]), skip + STRETCH), k]
    out: list[list[np.ndarray]] = [[] for _ in pages]
    for (i, _), scores in zip(parts, found):
        out[i].append(scores)
    return [np.concatenate(x) if x else np.empty(0, np.float32) for x in out]


def main_texts(net: Labeller, pages: list[str | None]) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    return ["\n\n".join(b.text for b, p in zip(bs, ps) if p > 0.5) for bs, ps in zip(found, label(net, found))]


def extracted(pages: DataFrame, html: str = "html", net: Labeller | None = None) -> Column:
    """The main text of the html column; the weights are broadcast (their size is fixed)."""
    shared = pages.sparkSession.sparkContext.broadcast((net or train()).w)

    @F.arrow_udf(returnType="string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = Labeller(shared.value)
        for batch in batches:
            raw = batch.to_pylist()
            texts: list[str] = []
            for a, b in slices([len(p or "") for p in raw], 1 << 20):
                texts += main_texts(net, raw[a:b])
            yield pa.array(texts, pa.string())

    return extract(F.col(html))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows page_id, url, text, n_chars: one for each row of pages."""
    made = pages.select("page_id", "url", extracted(pages).alias("text"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
