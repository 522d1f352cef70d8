"""Benchmark decontamination by the q-gram lemma.

A text that holds an item of m bytes with at most k edits shares at least m - q + 1 - k q q-grams with it, and these
lie within k + 1 neighbouring diagonals (text position less item position). Shared q-grams are counted in bands of
2 (k + 1) diagonals that overlap by half, so that one band holds them all; bands that reach the bound are verified by a
banded alignment.

Texts and items are compared in lower case, without ASCII characters other than letters and digits, as UTF-8 bytes.
The budget k is `edit_rate` of an item's bytes; q is 8, or what is less in m / (k + 1), so that the lemma always demands a
q-gram at least. Short items have short q-grams, and the same bound holds for them. Items of fewer than 16 compared bytes
are found only where the place begins and ends at word borders, as such letters stand inside other words by chance.

The items are a stated query set. It is taken in blocks of a bounded size; each block is compared with all rows, and no
row of a text is shuffled.

Defined cases: a null or empty text has no leaks; items that are null or without a byte to compare are never found;
items with several ids are each reported, rows that are equal in id and text once; repeated documents are each reported;
of several places of an item in a text, the one with fewest edits is given, of these the first; very long texts are
searched whole, and runs of one letter or line cost memory by their length alone; an empty benchmark or an empty table gives no leaks; a column `leaks` is replaced, all others stay.
Positions are code points of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.shared import free_name, with_python_columns

Q = 8
LEAKS = "leaks array<struct<item_id:long,start:int,end:int,edits:int>>"
#: Bytes that are compared; all others are dropped.
KEPT = np.zeros(256, bool)
KEPT[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = True
KEPT[128:] = True
SPREAD = np.uint64(0x9E3779B97F4A7C15)
SIEVE_BITS = 20
#: Counts that are held at once.
STEP = 1 << 20
#: Items of fewer compared bytes are found at word borders only.
SHORT = 2 * Q
#: From here on, scripts set no spaces between words, so that each character is a word.
UNSPACED = "\u2e80"


def compared(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    return data[KEPT[data]]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position on, as one number."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    codes, width = data.astype(np.uint64), 1
    while width < q:
        step = min(width, q - width)
        codes = (codes[:-step] << np.uint64(8 * step)) | (codes[step:] & np.uint64((1 << 8 * step) - 1))
        width += step
    return codes


@dataclass
class Items:
    """Items of a block that have one q, and where each of them holds a q-gram: runs of places at most k + 1 apart."""

    q: int
    ids: np.ndarray
    texts: list[np.ndarray]
    budgets: np.ndarray
    needs: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sieve: np.ndarray


def index_items(rows: list[tuple[int, str | None]], edit_rate: float) -> list[Items]:
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, t in rows:
        data = compared(t)
        if len(data):
            by_q.setdefault(min(Q, len(data) // (int(edit_rate * len(data)) + 1)), []).append((i, data))
    return [index_of(kept, q, edit_rate) for q, kept in sorted(by_q.items())]


def index_of(kept: list[tuple[int, np.ndarray]], q: int, edit_rate: float) -> Items:
    sizes = np.array([len(d) for _, d in kept], np.int64)
    budgets = np.floor(edit_rate * sizes).astype(np.int64)
    codes = [grams(d, q) for _, d in kept]
    every = np.concatenate([np.zeros(0, np.uint64), *codes])
    owner = np.repeat(np.arange(len(kept)), [len(c) for c in codes])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(c)) for c in codes)])
    order = np.argsort(every, kind="stable")
    every, owner, place = every[order], owner[order], place[order]
    same = (every[1:] == every[:-1]) & (owner[1:] == owner[:-1]) & (np.diff(place) <= budgets[owner[1:]] + 1)
    new = np.flatnonzero(np.concatenate([[True], ~same]))
    unique, starts = np.unique(every[new], return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(unique * SPREAD) >> np.uint64(64 - SIEVE_BITS)] = True
    return Items(
        q, np.array([i for i, _ in kept], np.int64), [d for _, d in kept], budgets, sizes - q + 1 - budgets * q,
        unique, np.append(starts, len(new)), owner[new], place[new], place[np.append(new[1:], len(every)) - 1], sieve,
    )


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the sum of each key's values)."""
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, np.concatenate(values), len(unique)).astype(np.int64)


def regions(docs: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first diagonal, last diagonal) of the bands that reach the bound; touching bands are joined.

    A text position counts once for each run of its q-gram's places in an item, in all bands that the run's diagonals
    touch: it adds one where these begin and takes one where they end. That is never too few, and a gram that an item
    repeats costs no more than ten runs. Positions are taken STEP counts at a time, so that memory is bounded.
    """
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = grams(np.concatenate([*docs, np.zeros(0, np.uint8)]), items.q)
    at = np.flatnonzero(items.sieve[(codes * SPREAD) >> np.uint64(64 - SIEVE_BITS)])
    if not len(at) or not len(items.codes):
        return
    slot = np.minimum(np.searchsorted(items.codes, codes[at]), len(items.codes) - 1)
    doc = np.searchsorted(starts, at, "right") - 1
    real = (items.codes[slot] == codes[at]) & (at + items.q <= starts[doc + 1])
    at, slot, doc = at[real], slot[real], doc[real]
    if not len(at):
        return
    times = items.starts[slot + 1] - items.starts[slot]
    cuts = np.flatnonzero(np.diff((np.cumsum(times) - times) // STEP)) + 1
    cuts = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]))
    n = len(items.ids)

    def runs(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, text position, run) of the counts of the positions a to b."""
        t = times[a:b]
        source = np.repeat(np.arange(a, b), t)
        run = np.arange(len(source)) - np.repeat(np.cumsum(t) - t, t) + items.starts[slot[source]]
        return doc[source] * n + items.owner[run], (at - starts[doc])[source], run

    found = [np.unique(runs(*cut)[0], return_counts=True) for cut in cuts]
    pairs, counts = summed([p for p, _ in found], [c for _, c in found])
    pairs = pairs[counts >= items.needs[pairs % n]]
    if not len(pairs):
        return
    below = max(map(len, items.texts)) + 2
    width = below + int(sizes.max()) + 3
    keys, steps = [], []
    for cut in cuts:
        pair, position, run = runs(*cut)
        which = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        enough = pairs[which] == pair
        which, position, run = which[enough], position[enough], run[enough]
        half = items.budgets[items.owner[run]] + 1
        base = which * width + below
        opened = base + (position - items.last[run]) // half - 1
        closed = base + (position - items.first[run]) // half + 1
        keys += [opened, closed]
        steps += [np.ones(len(opened)), -np.ones(len(closed))]
        if sum(map(len, keys)) > STEP:
            key, step = summed(keys, steps)
            keys, steps = [key], [step]
    key, step = summed(keys, steps)
    good = np.flatnonzero(np.cumsum(step) >= items.needs[pairs[key // width] % n])
    last = None
    for p, b, e in zip(pairs[key[good] // width].tolist(), (key[good] % width - below).tolist(), (key[good + 1] % width - below).tolist()):
        h = int(items.budgets[p % n]) + 1
        if last and last[0] == p and last[2] >= b * h - 1:
            last[2] = (e + 1) * h - 1
            continue
        if last:
            yield last[0] // n, last[0] % n, last[1], last[2]
        last = [p, b * h, (e + 1) * h - 1]
    if last:
        yield last[0] // n, last[0] % n, last[1], last[2]


def align(
    item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int, borders: np.ndarray | None = None
) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of `item` in `text` on diagonals from low - budget to high + budget.

    Row i of the table holds, for each diagonal d, the edits of the item's first i bytes against text ending at d + i.
    Diagonals at both sides whose edits are beyond the budget are dropped as the rows go on. Where `borders` is given,
    a place begins and ends at positions of the text for which it is true.
    """
    inf = 1 << 30
    ends = np.arange(max(low - budget, -len(item)), min(high + budget, len(text)) + 1)
    if not len(ends):
        return None
    steps = np.arange(len(ends))
    cost = np.where(ends >= 0, 0, inf)
    if borders is not None:
        cost[(ends >= 0) & ~borders[np.maximum(ends, 0)]] = inf
    begin = ends.copy()
    # Diagonals below 0 are reached by dropping the item's first bytes.
    for i in range(1, len(item) + 1):
        at = ends + i - 1
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(ends), bool)
        same[inside] = text[at[inside]] == item[i - 1]
        across = np.where(inside, cost + ~same, inf)
        drop = np.append(cost[1:] + 1, inf)
        best = np.minimum(across, drop)
        start = np.where(across <= drop, begin, np.append(begin[1:], 0))
        # A run of added text bytes costs one a diagonal: a running minimum over cost less diagonal.
        keyed = best - steps
        low_so_far = np.minimum.accumulate(keyed)
        origin = np.maximum.accumulate(np.where(keyed == low_so_far, steps, 0))
        cost = np.minimum(low_so_far + steps, inf)
        cost[(ends + i < 0) | (ends + i > len(text))] = inf
        begin = start[origin]
        if i % 64 == 0:
            live = np.flatnonzero(cost <= budget)
            if not len(live):
                return None
            part = slice(max(0, live[0] - budget), live[-1] + budget + 1)
            ends, cost, begin = ends[part], cost[part], begin[part]
            steps = np.arange(len(ends))
    if borders is not None:
        cost[~borders[np.clip(ends + len(item), 0, len(text))]] = inf
    least = int(cost.min())
    if least > budget:
        return None
    d = int(np.argmin(cost))
    return least, int(begin[d]), int(ends[d]) + len(item)


def word_borders(text: str, places: np.ndarray) -> np.ndarray:
    """Whether each position among the compared bytes, both ends included, is no place inside a word."""
    out = np.ones(len(places) + 1, bool)
    inside = places[1:] - places[:-1] <= 1
    if not text.isascii():
        joined = np.array([c.isalnum() and c < UNSPACED for c in text], bool)
        inside &= (places[1:] == places[:-1]) | (joined[places[1:]] & joined[places[:-1]])
    out[1:-1] = ~inside
    return out


def code_points(text: str) -> np.ndarray:
    """The code point in `text` of each compared byte."""
    if text.isascii():
        return np.flatnonzero(KEPT[np.frombuffer(text.lower().encode(), np.uint8)])
    sizes = [int(KEPT[ord(c.lower())]) if c <= "\x7f" else len(compared(c)) for c in text]
    return np.repeat(np.arange(len(text)), sizes)


def leaks_in(texts: list[str | None], blocks: list[Items]) -> list[list[dict]]:
    docs = [compared(t) for t in texts]
    out: list[list[dict]] = [[] for _ in texts]
    for items in blocks:
        for doc, leaks in enumerate(leaks_of(texts, docs, items)):
            out[doc] += leaks
    return [sorted(x, key=lambda leak: leak["item_id"]) for x in out]


def leaks_of(texts: list[str | None], docs: list[np.ndarray], items: Items) -> list[list[dict]]:
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    borders: dict[int, np.ndarray] = {}
    for doc, item, low, high in regions(docs, items):
        budget, pattern = int(items.budgets[item]), items.texts[item]
        begin = max(0, low - budget)
        if len(pattern) < SHORT:
            if doc not in borders:
                borders = {doc: word_borders(texts[doc], code_points(texts[doc]))}
            found = align(pattern, docs[doc], low, high, budget, borders[doc])
        else:
            window = docs[doc][begin : high + budget + len(pattern)]
            exact = window.tobytes().find(pattern.tobytes())
            if exact >= 0:
                found = (0, begin + exact, begin + exact + len(pattern))
            else:
                found = align(pattern, docs[doc], low, high, budget)
        if found and (doc, item) in best:
            found = min(found, best[doc, item])
        if found:
            best[doc, item] = found
    out: list[list[dict]] = [[] for _ in texts]
    places: dict[int, np.ndarray] = {}
    for (doc, item), (edits, start, end) in sorted(best.items()):
        if doc not in places:
            places = {doc: code_points(texts[doc])}
        a = int(places[doc][start]) if start < len(places[doc]) else len(texts[doc])
        b = int(places[doc][end - 1]) + 1 if end > start else a
        out[doc].append({"item_id": int(items.ids[item]), "start": a, "end": b, "edits": edits})
    return out


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    edit_rate: float = 0.1,
    block_mb: float = 2.0,
) -> DataFrame:
    """`documents` with `leaks`: items found in the text, with their place and edits.

    The items' bytes are summed first, and they go to the tasks in blocks of about `block_mb`.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / (block_mb * 1e6)))
    earlier = free_name(documents, "before")
    out = documents.withColumn("leaks", F.array().cast(LEAKS.split(" ", 1)[1]))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted((r.item_id, r.text) for r in mine.where("item_id is not null").collect())
        if not rows:
            continue

        def make(rows=rows):
            index = index_items(rows, edit_rate)

            def run(part):
                before = part.column(earlier).to_pylist()
                texts = part.column("text").to_pylist()
                found, first, size = [], 0, 0
                for i, t in enumerate(texts):
                    size += len(t or "")
                    if size > 1_000_000 or i + 1 == len(texts):
                        found += leaks_in(texts[first : i + 1], index)
                        first, size = i + 1, 0
                return [[x + y for x, y in zip(before, found)]]

            return run

        out = with_python_columns(out.withColumnRenamed("leaks", earlier), make, LEAKS, rows=1024).drop(earlier)
    return out
