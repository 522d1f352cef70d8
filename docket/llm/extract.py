"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags, each with the path of its open elements. A
bidirectional LSTM in numpy reads a vector per block, made of hashed tokens of the tag path (tags, and words of class and
id), hashed words of the text and how it is written (sentences, commas, capitals), and so labels every block with the whole page as context. Blocks labelled as main
text are joined by line feeds. Pages are read by HTML's own tokenizer rules, in one pass.

The model is trained here, on pages that `make_page` and, with names that say nothing, `make_plain_page` compose from a
seed with known labels: `PAGES` pages in all, whatever the input. Scripts, styles and comments of the markup are no blocks.

Defined cases: a null, empty or markup-free page gives its text as one block to the labeller; unclosed and stray tags are
handled as browsers do for paragraphs, list items and table cells; a tag that the page's end cuts off gives nothing, and
quotes count only where a value begins; very long and very deep pages take time in proportion to their length, and all
their path counts; character references are decoded, white space in a block becomes one space; repeated rows are
labelled each; an empty table gives no rows; columns `text` and `n_blocks` are replaced.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docket.functions.markup import VOID, OpenElements, tokens
from docket.llm.jaccard import word_hashes
from docket.llm.shared import shared_folder, with_python_columns

#: Fixed values of HTML: elements within a line, elements without content, elements whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset("script style template iframe noframes svg math".split())
#: An element that begins closes an open one of these kinds, as far up as an element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

PATH_SIZE, WORD_SIZE, EXTRA = 192, 64, 7
INPUT = PATH_SIZE + WORD_SIZE + EXTRA
HIDDEN = 16
PAGES, BATCH, STEPS = 3000, 16, 1800
#: (tag of the innermost open element, text, share of characters in links, vector of the path)
Block = tuple[str, str, float, np.ndarray]


@lru_cache(20_000)
def names_of(tag: str, said: str) -> tuple[str, ...]:
    """The tag and the words of its class, id and role."""
    return (tag, *(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).lower()) if w))


@lru_cache(50_000)
def places_of(token: str) -> tuple[tuple[int, float], ...]:
    """The three places of a vector that a token sets, by hashes of its name."""
    hashes = [zlib.crc32(f"{k}:{token}".encode()) for k in range(3)]
    return tuple((h % PATH_SIZE, 1.0 if h >> 16 & 1 else -1.0) for h in hashes)


class OpenPath(OpenElements):
    """Open elements with the sum of the vectors of all distinct tokens on the path, kept up as they open and close."""

    def __init__(self):
        super().__init__()
        self.vector = np.zeros(PATH_SIZE, np.float32)
        self.times: dict[str, int] = {}

    def add(self, token: str, step: int) -> None:
        before = self.times.get(token, 0)
        self.times[token] = before + step
        if not before or not before + step:
            for place, sign in places_of(token):
                self.vector[place] += sign * step

    def push(self, tag: str, *more) -> None:
        super().push(tag, *more)
        for token in more[0]:
            self.add(token, 1)

    def close(self, at: int) -> list[tuple]:
        closed = super().close(at)
        for _, names in closed:
            for token in names:
                self.add(token, -1)
        return closed


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order. Work is in proportion to the page's length."""
    out: list[Block] = []
    stack = OpenPath()
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack.items[-1][0] if stack.items else ""
                vector = stack.vector.copy()
                for place, sign in places_of(f"own:{own}"):
                    vector[place] += sign
                out.append((own, text, min(1.0, linked / len(text)), vector))
            parts.clear()
        linked = 0

    for kind, x, attributes, slash in tokens(page or "", SKIPPED):
        if kind == "text":
            parts.append(x)
            if in_link:
                linked += len(x)
        elif x in INLINE:
            if x == "br":
                parts.append(" ")
            elif x == "a":
                in_link = kind == "open"
        elif kind == "close":
            flush()
            in_link = False
            if (at := stack.last(x)) >= 0:
                stack.close(at)
        else:
            flush()
            if stack.items and stack.items[-1][0] == "p":
                stack.close(len(stack.items) - 1)
            if x in IMPLIED:
                closes, until = IMPLIED[x]
                while (at := stack.last(*closes)) > stack.last(*until):
                    stack.close(at)
            if x not in VOID and not (slash and x not in ("p", "div", "li")):
                said = " ".join(filter(None, (attributes.get(k) for k in ("class", "id", "role"))))
                stack.push(x, names_of(x, said))
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    words, first = word_hashes([b[1].lower().encode("utf-8", "replace") for b in blocks])
    owner = np.repeat(np.arange(len(blocks)), np.diff(first))
    place = owner * WORD_SIZE + (words >> np.uint64(58)).astype(np.int64)
    sign = np.where(words & np.uint64(1), 1.0, -1.0)
    bag = np.bincount(place, sign, len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
    count = np.maximum(np.diff(first), 1)
    x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.clip(bag / np.sqrt(count)[:, None] / 5, -0.5, 0.5)
    x[:, -7:-3] = [appearance(b[1]) for b in blocks]
    x[:, -3] = np.log1p(count) / 4
    x[:, -2] = [b[2] for b in blocks]
    x[:, -1] = 1
    for i, b in enumerate(blocks):
        x[i, :PATH_SIZE] = b[3]
    return x


def appearance(text: str) -> tuple[float, ...]:
    """What a text looks like in any language: ends of sentences, commas, capitals at word starts of short texts."""
    words = text.count(" ") + 1
    last = text.rstrip("\"'»”’)]")[-1:]
    signs = sum(text.count(c) for c in ".!?…。؟।")
    commas = sum(text.count(c) for c in ",;、،")
    capitals = sum(w[0].isupper() for w in text.split())
    return (
        float(last != "" and last in ".!?…。؟।:"),
        min(1.0, signs / 3),
        min(1.0, 5 * commas / words),
        capitals / words if words <= 12 else 0.0,
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states (time, page, HIDDEN) over x (time, page, INPUT). Padded steps keep the state as it is."""
    steps, pages, _ = x.shape
    before = x @ w
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    out, saved = np.zeros((steps, pages, HIDDEN), np.float32), []
    for t in range(steps):
        z = before[t] + h @ u
        i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep:
            saved.append((i, f, o, g, c, h, th, m))
        c = np.where(m, new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    return (out, saved) if keep else out


def lstm_gradients(x: np.ndarray, u: np.ndarray, saved: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u, from those of the hidden states."""
    steps, pages, _ = x.shape
    dz = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh_next, dc_next = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, h, th, m = saved[t]
        dh = d_out[t] + dh_next
        live = dh * m
        dc = dc_next * m + live * o * (1 - th * th)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), live * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        du += h.T @ dz[t]
        dh_next = dz[t] @ u.T + dh * ~m
        dc_next = dc * f + dc_next * ~m
    return np.tensordot(x, dz, ([0, 1], [0, 1])), du


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


class Labeller:
    """Two LSTMs, one over the reversed sequence, and a logistic output over both states and the block itself."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = [normal(INPUT, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), normal(INPUT, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN)]
        self.p += [normal(2 * HIDDEN, 1), np.zeros((INPUT, 1), np.float32)]

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        forth = run_lstm(x, self.p[0], self.p[1], mask)
        back = run_lstm(x[::-1], self.p[2], self.p[3], mask[::-1])[::-1]
        return (np.concatenate([forth, back], axis=2) @ self.p[4] + x @ self.p[5])[:, :, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        forth, saved_forth = run_lstm(x, self.p[0], self.p[1], mask, True)
        back, saved_back = run_lstm(x[::-1], self.p[2], self.p[3], mask[::-1], True)
        both = np.concatenate([forth, back[::-1]], axis=2)
        d = ((sigmoid((both @ self.p[4] + x @ self.p[5])[:, :, 0]) - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        d_both = d @ self.p[4].T
        dw, du = lstm_gradients(x, self.p[1], saved_forth, d_both[:, :, :HIDDEN])
        dv, ds = lstm_gradients(x[::-1], self.p[3], saved_back, d_both[::-1, :, HIDDEN:])
        return [dw, du, dv, ds, np.tensordot(both, d, ([0, 1], [0, 1])), np.tensordot(x, d, ([0, 1], [0, 1]))]

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.015) -> Labeller:
        mean, square = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        rng = np.random.default_rng(2)
        for step in range(1, steps + 1):
            chosen = [pages[i] for i in rng.choice(len(pages), min(BATCH, len(pages)), replace=False)]
            x, mask = padded([c[0] for c in chosen])
            y = np.zeros(mask.shape, np.float32)
            for k, c in enumerate(chosen):
                y[: len(c[1]), k] = c[1]
            grads = self.gradients(x, mask, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * (1 - step / (steps + 1))
            for a, g, m, s in zip(self.p, grads, mean, square):
                g = g / max(1.0, norm)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                a -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        return self

    def main_blocks(self, pages: list[np.ndarray], most: int = 8192) -> list[np.ndarray]:
        """For each page, which blocks are main text. Pages of similar length are labelled together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]
            while order and (len(group) + 1) * len(pages[group[0]]) <= most:
                group.append(order.pop())
            z = self.logits(*padded([pages[i] for i in group]))
            for k, i in enumerate(group):
                out[i] = z[: len(pages[i]), k] > 0
        return out


#: How the parts of composed pages are marked: for each kind, tags and names; the last word says how blocks look.
FRAMES = {
    "menu": ("nav div ul section", "nav menu navbar navigation topbar breadcrumb links"),
    "header": ("header div", "header masthead banner top logo"),
    "sidebar": ("aside div section", "sidebar widget related aside recommended popular rail"),
    "advert": ("div aside section", "ad ads advert advertisement sponsor sponsored promo promotion"),
    "notice": ("div section aside", "notice cookie consent alert gdpr banner newsletter popup message"),
    "comments": ("section div ol", "comments comment replies discussion responses thread respond"),
    "footer": ("footer div", "footer copyright bottom legal colophon"),
    "form": ("form", "search login signup subscribe contact"),
}
BODIES = ("article main div section", "content article post entry story main body text")
#: Words that are frequent in such parts. Half of the composed pages use them among random ones.
TYPICAL = {
    "menu": "home about contact news products services blog login archive categories search help",
    "header": "welcome home your the daily official site",
    "sidebar": "related popular recent posts read more tags follow us trending also most",
    "advert": "buy now sale offer free shop discount sponsored deal today save order only",
    "notice": "cookies we use accept policy subscribe newsletter consent continue agree settings privacy",
    "comments": "reply posted ago says comment comments like agree thanks author wrote share",
    "footer": "copyright rights reserved privacy terms all contact imprint inc company legal",
    "form": "name email search submit send password sign login message your required",
    "main": "the of and to in a is that was for it with as his on be at by had not are but from or have an they which",
}


def make_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A composed page and its main blocks."""
    pick = lambda s: (s.split() if isinstance(s, str) else s)[rng.integers(len(s.split() if isinstance(s, str) else s))]

    typical = rng.random() < 0.5
    kind_now = "main"

    noise = rng.choice([0.0, 0.0, 0.0, 0.8, 1.0])
    kinds_of_noise = ["###", "%%%", "***", " |", " /", "&", "$", "7", " -"]
    kinds_of_noise = [pick(kinds_of_noise)] if noise == 1 else kinds_of_noise

    def word() -> str:
        if typical and rng.random() < 0.4:
            return pick(TYPICAL[kind_now])
        signs = pick(kinds_of_noise) if noise and rng.random() < noise else ""
        return "".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) + signs

    sentences = rng.choice([0.0, 0.3, 0.9])  # written alike in all parts, so that names tell them apart

    def prose(low: int, high: int) -> str:
        words = [word() for _ in range(int(rng.integers(low, high)))]
        if high > 20 and rng.random() < 0.05:  # one word again and again
            return " ".join([words[0].capitalize()] * len(words) * int(rng.integers(1, 5)))
        if rng.random() < sentences:
            ends = [rng.random() < 0.1 for _ in words[1:]] + [rng.random() < 0.9]
            words = [w.capitalize() if not i or ends[i - 1] else w for i, w in enumerate(words)]
            words = [w + (pick("... ... ... ! ?")[:1] if end else "," * (rng.random() < 0.06)) for w, end in zip(words, ends)]
        return " ".join(words)

    def opened(tags: str, names: str, always: bool) -> tuple[str, str]:
        tag = pick(tags)
        plain = tag in ("nav", "header", "aside", "footer", "form", "article", "main")
        if plain and not always and rng.random() < 0.6:
            return f"<{tag}>", f"</{tag}>"
        kind = pick("class id class")
        extra = " " + word().strip(" |/") if rng.random() < 0.3 else ""
        return f'<{tag} {kind}="{pick(names)}{extra}">', f"</{tag}>"

    def part(kind: str) -> str:
        nonlocal kind_now
        start, end = opened(*FRAMES[kind], always=False)
        kind_now = kind
        try:
            return start + inside(kind) + end
        finally:
            kind_now = "main"

    def inside(kind: str) -> str:
        n = int(rng.integers(1, 6))
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="/x">{prose(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
        elif kind == "form":
            inner = f"<label>{prose(1, 3)}</label><input><button>{prose(1, 2)}</button><p>{prose(2, 9)}</p>"
        elif kind == "comments":
            inner = "".join(pick([f"<p>{prose(2, 40)}</p>", f"<li>{prose(2, 30)}</li>", f"<div class=reply><p>{prose(2, 30)}</p></div>", f"<h3>{prose(1, 4)}</h3>"]) for _ in range(n))
        elif kind == "header":
            inner = pick([f"<h1>{prose(1, 4)}</h1>", f"<div>{prose(1, 5)}</div>", f"<p>{prose(1, 6)}</p>", prose(1, 5)])
        else:
            inner = pick([prose(2, 30), "".join(f"<p>{prose(2, 25)}</p>" for _ in range(n)), f"<h3>{prose(1, 4)}</h3><ul>" + "".join(f"<li><a href=x>{prose(1, 6)}</a></li>" for _ in range(n)) + "</ul>"])
        return inner

    main: list[str] = []

    def block() -> str:
        tag = pick("p p p p p h2 h3 li blockquote pre td dd figcaption div")
        text = prose(1, 6) if rng.random() < 0.4 else prose(5, 60)
        main.append(text)
        inner = pick([text, text, text, f"<b>{text}</b>", f"<b>{text}<br>", f"<a href=y>{text}</a>"])
        around = {"li": "ul", "td": "table", "dd": "dl", "figcaption": "figure"}.get(tag)
        closed = f"<{tag}>{inner}</{tag}>" if tag != "p" or rng.random() < 0.8 else f"<p>{inner}"
        return f"<{around}>{closed}</{around}>" if around else closed

    start, end = opened(*BODIES, always=True) if rng.random() < 0.5 else (lambda t: (f"<{t}>", f"</{t}>"))(pick("article article main"))
    inner = ""
    if rng.random() < 0.8:
        main.append(title := prose(1, 8))
        inner += f"<h1>{title}</h1>"
    for _ in range(int(rng.integers(1, 14 if rng.random() < 0.9 else 40))):
        if rng.random() < 0.08:
            inner += part(pick(["advert", "sidebar", "form", "notice"]))
        inner += block()
    if rng.random() < 0.3:
        inner += part("comments")
    wrap = pick(["", "", "wrapper", "container", "page", "row"])
    before = [part(k) for k in ("header", "menu", "notice", "advert", "sidebar") if rng.random() < 0.5]
    after = [part(k) for k in ("comments", "sidebar", "advert", "form", "notice", "menu") if rng.random() < 0.3]
    after += [part("footer")] * (rng.random() < 0.7)
    body = "".join(before) + start + inner + end + "".join(after)
    if wrap:
        body = f'<div class="{wrap}">{body}</div>'
    if rng.random() < 0.15:
        return body, main
    return f"<html><head><title>{prose(1, 9)}</title></head><body>{body}</body></html>", main


def make_plain_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A composed page whose names say nothing, and its main blocks.

    Elements are plain (divisions, tables, paragraphs), without names or with invented ones. What tells main text is how it
    is written (sentences, or a heading or list among them) and where it stands: other parts are links, labels and remarks.
    """
    pick = lambda values: values[int(rng.integers(len(values)))]
    chance = lambda p: rng.random() < p
    letters = "aaaabcdeeeeefghiiijklmnnooooprrsstttuuvwyzäéö" if chance(0.5) else "abcdefghijklmnopqrstuvwxyz"
    named = chance(0.5)
    layout = pick(["div", "div", "table", "bare"])
    seldom = pick([0.0, 0.1, 0.3])
    short = chance(0.5)

    def word() -> str:
        if chance(seldom):
            return pick(TYPICAL["main"].split())
        return "".join(pick(letters) for _ in range(int(rng.integers(1, 10))))

    def label(most: int = 4) -> str:
        words = [word() for _ in range(int(rng.integers(1, most + 1)))]
        if chance(0.15):
            words = [pick(TYPICAL[pick([k for k in TYPICAL if k != "main"])].split())]
        every = chance(0.4)
        return " ".join(w.capitalize() if every or not i else w for i, w in enumerate(words))

    def sentence(low: int = 3, high: int = 25) -> str:
        words = [word() for _ in range(int(rng.integers(low, high)))]
        words = [w + "," if i + 1 < len(words) and chance(0.08) else w.capitalize() if chance(0.05) else w for i, w in enumerate(words)]
        return " ".join([words[0].capitalize(), *words[1:]]) + pick("......?!")

    def opened(*tags: str) -> tuple[str, str]:
        tag = pick(tags)
        said = f' {pick(["class", "id"])}="{word()}"' if named and chance(0.7) else ""
        return f"<{tag}{said}>", f"</{tag}>"

    def around(text: str, *tags: str) -> str:
        start, end = opened(*tags)
        return start + text + end

    def links(n: int) -> str:
        return "".join(pick(["", " ", " | "]) * (i > 0) + f'<a href="/{word()}">{label(3)}</a>' for i in range(n))

    def small_part(text: str) -> str:
        return text if layout == "table" and chance(0.6) else around(text, "div", "div", "p")

    def menu() -> str:
        n = int(rng.integers(1, 8))
        kind = rng.integers(4)
        if kind == 0:
            return around("".join(f"<li><a href=/>{label(3)}</a></li>" for _ in range(n)), "ul", "ol")
        if kind == 1:
            return around("".join(around(label(2), "div", "li") for _ in range(n)), "div")
        return small_part(links(n) if kind == 2 else " ".join(label(1) for _ in range(n)))

    def footer() -> str:
        year = str(int(rng.integers(1995, 2030)))
        texts = [label(3), f"© {year} {label(3)}", f"{label(2)} | {label(2)}", f"{label(1)} {year}", links(int(rng.integers(1, 6)))]
        return around("".join(around(pick(texts), "div", "p") for _ in range(int(rng.integers(1, 4)))) if chance(0.4) else pick(texts), "div", "p")

    def paragraph() -> str:
        return " ".join(sentence(3, 12 if short else 25) for _ in range(1 if short else int(rng.integers(1, 6))))

    main: list[str] = []

    def said(text: str) -> str:
        main.append(text)
        return text

    def body() -> str:
        out = []
        if chance(0.6):
            out.append(f"<{(h := pick(['h1', 'h1', 'h2']))}>{said(label(8))}</{h}>")
        many = pick([1, 2, 3]) if short else pick([1, 2, 3, int(rng.integers(1, 14)), int(rng.integers(1, 14))])
        if many == 1 and not out and chance(0.6):
            return said(paragraph())
        tags = pick([("p",), ("p",), ("p", "blockquote"), ("div",), ("div",)])
        for i in range(many):
            if i and chance(0.12):
                out.append(f"<{(h := pick(['h2', 'h3', 'h4']))}>{said(label(6))}</{h}>")
            text = paragraph()
            linked = f"{text} <a href=/>{label(2)}</a>." if chance(0.1) else text
            out.append(around(linked, *tags))
            said(re.sub("<[^>]*>", "", linked))
            if i and chance(0.08):
                out.append("<ul>" + "".join(f"<li>{said(pick([label(5), sentence(2, 12)]))}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        return "".join(out)

    before = [part for part, p in ((small_part(label(4)), 0.3), (menu(), 0.5)) if chance(p)]
    after = [part for part, p in ((menu(), 0.3), (footer(), 0.6)) if chance(p)]
    if chance(0.15):
        before = after = []
    inner = body()
    if layout == "table":
        cell = lambda text: f"<td>{text}</td>"
        if chance(0.5):
            page = "<table>" + "".join(f"<tr>{cell(x)}</tr>" for x in (*before, inner, *after)) + "</table>"
        else:
            page = f"<table><tr>{''.join(map(cell, (*before, inner)))}</tr>" + "".join(f"<tr>{cell(x)}</tr>" for x in after) + "</table>"
    else:
        middle = inner if layout == "bare" else around(inner, "div", "div", "section")
        page = "".join((*before, middle, *after))
        if chance(0.2):
            page = around(page, "div")
    if chance(0.3):
        return page, main
    return f"<html><head>{f'<title>{label(8)}</title>' if chance(0.8) else ''}</head><body>{page}</body></html>", main


def trained(pages: int = PAGES, steps: int = STEPS) -> Labeller:
    rng = np.random.default_rng(7)
    samples = []
    for k in range(pages):
        page, main = make_plain_page(rng) if k % 2 else make_page(rng)
        blocks, at = blocks_of(page), 0
        y = np.zeros(len(blocks), np.float32)
        for i, b in enumerate(blocks):
            if at < len(main) and b[1] == main[at]:
                y[i], at = 1, at + 1
        samples.append((features(blocks), y))
    return Labeller().train(samples, steps)


#: Labellers that this process has, by the application that trained or read them.
FITTED: dict[str, Labeller] = {}


def stored_weights(spark: SparkSession) -> str:
    """The folder of the weights that this code trains: the seeds are fixed, so they change with the code alone."""
    code = hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/labeller-{code}"


def fitted(spark: SparkSession) -> Labeller:
    """The trained labeller. One task trains it, on composed pages alone; its weights are kept in the shared folder."""
    name = spark.sparkContext.applicationId
    if name in FITTED:
        return FITTED[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            for k, a in enumerate(trained().p):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([a.tobytes()])], ["k", "weights"])

    labeller, folder = Labeller(), stored_weights(spark)
    done = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f"{folder}/_SUCCESS"))
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        weights = spark.range(1).coalesce(1).mapInArrow(run, "k long, weights binary")
        weights.write.mode("overwrite").parquet(folder)
    for r in spark.read.parquet(folder).collect():
        labeller.p[r.k] = np.frombuffer(r.weights, np.float32).reshape(labeller.p[r.k].shape)
    FITTED[name] = labeller
    return labeller


def main_texts(pages: list[str | None], labeller: Labeller) -> list[tuple[str, int]]:
    cut = [blocks_of(p) for p in pages]
    x = features([b for c in cut for b in c])
    ends = np.cumsum([len(c) for c in cut])
    marked = labeller.main_blocks(np.split(x, ends[:-1]))
    return [("\n".join(b[1] for b, m in zip(c, marks) if m), len(c)) for c, marks in zip(cut, marked)]


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """`pages` (html, ...) with `text`, the main text, and `n_blocks`."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or fitted(pages.sparkSession))

    def make():
        def run(part):
            found = main_texts(part.column("html").to_pylist(), shared.value)
            return [list(column) for column in zip(*found)]

        return run

    return with_python_columns(pages, make, "text string, n_blocks int", rows=128)
