"""Pairs of similar strings among many, in one process: bounds on blocks of strings, then on pairs, then distances, by numpy.

The indel distance of two strings is what they have besides a longest common subsequence, in characters of both. It is at
least the sum of differences of their counts of any groups of characters, which all bounds here come from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Strings of a block, at most and (but for rests) at least; characters of its strings' common beginning or end that are looked at.
BLOCK, LEAST, AFFIX = 256, 64, 24
#: Groups of characters that are counted; words of 64 bits of a string's counts; bytes of tables of a step.
GROUPS, WORDS, TABLE = 128, 4, 16 << 20
#: Candidates that are verified together, and steps after which the hopeless ones of them are dropped.
TOGETHER, STEPS = 1 << 16, 32


def budget(n: np.ndarray, m: np.ndarray, percent: float) -> np.ndarray:
    """The largest indel distance with which strings of n and m characters have a ratio of `percent`."""
    return np.floor((1 - percent / 100) * (n + m) + 1e-6).astype(np.int64)


class Cell:
    """Strings to be paired. Each has `sides`: 1 to be a pair's first string, 2 its second, 3 both.

    With `second`, only pairs of a string that has it and one that hasn't are sought, otherwise all pairs of different strings.
    """

    def __init__(self, texts: list[str], sides: np.ndarray, second: np.ndarray, percent: float):
        self.percent = percent
        self.crossed = bool(second.any())
        codes, lengths = dense_codes(texts)
        counts = group_counts(*codes, lengths)
        kind = second * 4 + sides
        step = math.log((200 - percent) / percent) + 1e-9 if percent < 100 else 1.0
        scale = np.floor(np.log(lengths) / step).astype(np.int64)
        offsets = np.cumsum(lengths) - lengths
        self.codes, self.alphabet = codes
        ends = offsets + lengths - 1
        both = ((texts, offsets, 1), ([x[::-1] for x in texts], ends, -1))
        sorts = (ordered(keys, kind, scale, affixes(self.codes, self.alphabet, begin, way, lengths), counts) for keys, begin, way in both)
        order, starts, self.affix, self.known, _ = min(sorts, key=lambda x: x[4])
        self.order, self.starts, self.ends = order, starts, np.append(starts[1:], len(texts))
        self.lengths, self.kind, self.offsets = lengths[order], kind[order], offsets[order]
        counts = counts[order]
        self.bits = threshold_bits(counts)
        self.low, self.high = (f.reduceat(counts, starts).astype(np.int32) for f in (np.minimum, np.maximum))
        self.shortest, self.longest = (f.reduceat(self.lengths, starts) for f in (np.minimum, np.maximum))

    def meeting(self, p: int) -> np.ndarray:
        """The blocks whose strings may be similar to block p's; each pair of blocks is met once."""
        kinds = self.kind[self.starts]
        sides, own = kinds % 4, kinds[p] % 4
        useful = ((sides & 1) & (own >> 1) | (sides >> 1) & (own & 1)).astype(bool)
        useful &= (kinds >= 4) if self.crossed else (np.arange(len(kinds)) >= p)
        found = np.flatnonzero(useful)
        most = budget(self.longest[p], self.longest[found], self.percent)
        gap = np.maximum(self.shortest[p] - self.longest[found], self.shortest[found] - self.longest[p])
        found, most = found[gap <= most], most[gap <= most]
        gap = np.maximum(np.maximum(self.low[p] - self.high[found], self.low[found] - self.high[p]), 0).sum(axis=1)
        found, most = found[gap <= most], most[gap <= most]
        return found[self.affix_distances(p, found) <= most] if len(found) else found

    def affix_distances(self, p: int, others: np.ndarray) -> np.ndarray:
        """Bounds from the common beginnings (or ends) u of block p's strings and v of another's: u or a beginning of it against v or one of it, one of them whole."""
        n, m = int(self.known[p]), self.known[others]
        v, longest, every = self.affix[others].T, int(m.max()), np.arange(len(others))
        row = np.repeat(np.arange(longest + 1, dtype=np.int16)[:, None], len(others), axis=1)
        least = row[m, every].copy()
        for i in range(n):
            new = np.empty_like(row)
            new[0] = i + 1
            same = v[:longest] == self.affix[p, i]
            for j in range(longest):
                new[j + 1] = np.where(same[j], row[j], np.minimum(row[j + 1], new[j]) + 1)
            row = new
            np.minimum(least, row[m, every], out=least)
        whole = np.where(np.arange(longest + 1)[:, None] <= m, row, 32767)
        return np.minimum(least, whole.min(axis=0))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in order (i, j) of pairs whose counts don't exclude that they are similar."""
        one = self.bits[0]
        differ, count, fits = np.empty(BLOCK * BLOCK, np.uint64), np.empty(BLOCK * BLOCK, np.uint8), np.empty(BLOCK * BLOCK, bool)
        for p in range(len(self.starts)):
            if self.crossed and self.kind[self.starts[p]] >= 4:
                break
            a, rows = self.starts[p], self.ends[p] - self.starts[p]
            i, j, held = [], [], 0
            for q in self.meeting(p):
                b, columns = self.starts[q], self.ends[q] - self.starts[q]
                size, shape = rows * columns, (rows, columns)
                most = min(255, int(budget(self.longest[p], self.longest[q], self.percent)))
                np.bitwise_xor(one[a : a + rows, None], one[None, b : b + columns], out=differ[:size].reshape(shape))
                np.bitwise_count(differ[:size], out=count[:size])
                np.less_equal(count[:size], most, out=fits[:size])
                hit = np.flatnonzero(fits[:size])
                if len(hit):
                    x, y = np.divmod(hit, columns)
                    if p == q:
                        x, y = x[x < y], y[x < y]
                    i.append(x + a)
                    j.append(y + b)
                    held += len(x)
                if held >= TOGETHER:
                    yield self.fitting(np.concatenate(i), np.concatenate(j))
                    i, j, held = [], [], 0
            if held:
                yield self.fitting(np.concatenate(i), np.concatenate(j))

    def fitting(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that all bits of their counts and their lengths allow."""
        most = budget(self.lengths[i], self.lengths[j], self.percent)
        apart = sum(np.bitwise_count(word[i] ^ word[j]).astype(np.int64) for word in self.bits)
        good = (apart <= most) & (np.abs(self.lengths[i] - self.lengths[j]) <= most)
        return i[good], j[good]

    def verified(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that have the ratio, with it."""
        found = [(i[:0], j[:0], np.empty(0))]
        words = -(-self.lengths[i] // 64)
        for n in np.unique(words):
            x, y = i[words == n], j[words == n]
            rows = np.unique(x)
            at_once = max(1, TABLE // (8 * int(n) * self.alphabet))
            for k in range(0, len(rows), at_once):
                part = rows[k : k + at_once]
                masks = self.masks(part, int(n))
                inside = (x >= part[0]) & (x <= part[-1])
                u, v = x[inside], y[inside]
                for s in range(0, len(u), TOGETHER):
                    found.append(self.compared(part, masks, u[s : s + TOGETHER], v[s : s + TOGETHER]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def masks(self, rows: np.ndarray, words: int) -> list[np.ndarray]:
        """For each row and character, the places of the character in the row's string as bits; an array for each word."""
        found = [np.zeros((len(rows), self.alphabet), np.uint64) for _ in range(words)]
        lengths, offsets, at = self.lengths[rows], self.offsets[rows], np.arange(len(rows))
        for k in range(int(lengths.max())):
            some = lengths > k
            found[k // 64][at[some], self.codes[offsets[some] + k]] |= np.uint64(1 << k % 64)
        return [x.reshape(-1) for x in found]

    def compared(self, rows: np.ndarray, masks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """verified() of pairs whose first strings are among `rows`: the common subsequence by 64 cells of a row at a time."""
        by_length = np.argsort(-self.lengths[j], kind="stable")
        i, j = i[by_length], j[by_length]
        total, length = self.lengths[i] + self.lengths[j], self.lengths[j]
        least = (total - budget(self.lengths[i], self.lengths[j], self.percent) + 1) // 2
        base, offset = np.searchsorted(rows, i) * self.alphabet, self.offsets[j]
        rest = [np.full(len(i), ~np.uint64(0)) for _ in masks]
        common = lambda: sum(64 - np.bitwise_count(r).astype(np.int64) for r in rest)
        k, longest = 0, int(length[0])
        while k < longest and len(i):
            active = int(np.searchsorted(-length, -k))  # those with more than k characters
            places = base[:active] + self.codes[offset[:active] + k]
            carry = None
            for r, mask in zip(rest, masks):
                old = r[:active]
                hit = old & mask[places]
                new = old + hit
                if len(masks) > 1:
                    over = new < old
                    if carry is not None:
                        new += carry
                        over |= new < carry
                    carry = over
                old ^= hit
                old |= new
            k += 1
            if k % STEPS == 0:
                hope = common() + np.maximum(length - k, 0) >= least
                if not hope.all():
                    i, j, total, length, least, base, offset = (x[hope] for x in (i, j, total, length, least, base, offset))
                    rest = [r[hope] for r in rest]
        ratio = 200 * common() / total
        good = ratio >= self.percent
        return i[good], j[good], ratio[good]

    def named(self, i: np.ndarray, j: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs of places as pairs of numbers of strings, first and second as their sides allow: some of them both ways."""
        x, y = self.kind[i] % 4, self.kind[j] % 4
        there, back = (x & 1) & (y >> 1) == 1, (y & 1) & (x >> 1) == 1
        first = np.concatenate([self.order[i[there]], self.order[j[back]]])
        second = np.concatenate([self.order[j[there]], self.order[i[back]]])
        return first, second, *(np.concatenate([c[there], c[back]]) for c in more)


def dense_codes(texts: list[str]) -> tuple[tuple[np.ndarray, int], np.ndarray]:
    """The characters of all texts one after the other, numbered without gaps by falling frequency, with the count of numbers; lengths."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    often = np.bincount(codes)
    rank = np.zeros(len(often), np.int64)
    known = np.argsort(-often, kind="stable")[: np.count_nonzero(often)]
    rank[known] = np.arange(len(known))
    return (rank[codes], len(known)), np.fromiter(map(len, texts), np.int64, len(texts))


def group_counts(codes: np.ndarray, alphabet: int, lengths: np.ndarray) -> np.ndarray:
    """How often each group of characters stands in each text. Frequent characters are groups of their own."""
    groups, alone = min(alphabet, GROUPS), GROUPS * 7 // 8
    if alphabet > GROUPS:
        codes = np.where(codes < alone, codes, alone + codes % (GROUPS - alone))
    out = np.empty((len(lengths), groups), np.uint16)
    ends = np.cumsum(lengths)
    for lo in range(0, len(lengths), 4096):
        part = lengths[lo : lo + 4096]
        own = codes[ends[lo] - lengths[lo] : ends[lo + len(part) - 1]]
        found = np.bincount(np.repeat(np.arange(len(part)), part) * groups + own, minlength=len(part) * groups)
        out[lo : lo + len(part)] = np.minimum(found, 65535).reshape(len(part), groups)
    return out


def affixes(codes: np.ndarray, alphabet: int, begin: np.ndarray, way: int, lengths: np.ndarray) -> np.ndarray:
    """The first characters of each text from `begin` on, forwards or backwards, in a row of AFFIX."""
    out = np.full((len(lengths), AFFIX), alphabet, np.int32)
    for k in range(AFFIX):
        some = lengths > k
        out[some, k] = codes[begin[some] + way * k]
    return out


def ordered(keys: list[str], kind: np.ndarray, scale: np.ndarray, affix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """An order of texts by kind, class of length and key; the starts of blocks in it; what their keys begin with, and how far they all do; how widely the counts in the blocks differ.

    Blocks end where neighbours have least in common.
    """
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    order = order[np.lexsort((scale[order], kind[order]))]
    affix = affix[order]
    common = np.append(0, np.cumprod(affix[1:] == affix[:-1], axis=1).sum(axis=1))  # with the text before
    new = np.append(True, (kind[order][1:] != kind[order][:-1]) | (scale[order][1:] != scale[order][:-1]))
    starts, known = [], []
    runs = np.append(np.flatnonzero(new), len(keys)).tolist()
    for start, end in zip(runs, runs[1:]):
        while start < end:
            stop = min(end, start + BLOCK)
            if stop < end:
                cuts = common[start + LEAST : stop + 1]
                stop = start + LEAST + len(cuts) - 1 - int(np.argmin(cuts[::-1]))
            starts.append(start)
            known.append(int(common[start + 1 : stop].min()) if stop - start > 1 else int((affix[start] != affix.max()).sum()))
            start = stop
    starts = np.array(starts)
    low, high = (f.reduceat(counts[order], starts).astype(np.int64) for f in (np.minimum, np.maximum))
    spread = int(((high - low).sum(axis=1) * np.diff(np.append(starts, len(keys)))).sum())
    return order, starts, affix[starts], np.array(known), spread


def threshold_bits(counts: np.ndarray) -> list[np.ndarray]:
    """Words of bits that tell whether a group's count reaches some number; those that differ most come first.

    The bits in which two texts differ are a part of the sum of differences of their counts.
    """
    told = []
    for c in range(counts.shape[1]):
        reach = np.bincount(np.minimum(counts[:, c], 255))[::-1].cumsum()[::-1][1:] / len(counts)
        told += [(p * (1 - p), c, k + 1) for k, p in enumerate(reach)]
    told = sorted((x for x in told if x[0] > 0), reverse=True)[: 64 * WORDS]
    words = [np.zeros(len(counts), np.uint64) for _ in range(max(1, -(-len(told) // 64)))]
    for n, (_, c, k) in enumerate(told):
        words[n // 64] |= (counts[:, c] >= k).astype(np.uint64) << np.uint64(n % 64)
    return words
