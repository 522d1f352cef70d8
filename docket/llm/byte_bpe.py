"""Byte-level BPE encoding and decoding by replaying the merges over all words at once.

Words of a block of texts are laid end to end as bytes. An inverted index holds, for every rank, the places where two
neighbours join to a token of that rank. The ranks are then applied in order, each at all of its places in all words, and
only the two pairs beside a merge are looked up and indexed anew. Merges in different words don't touch, so the corpus is
replayed in blocks: a task replays the words of its share of the texts that it hasn't met yet, each once, and looks up
the others. No text is shuffled.

A merge may make a pair of a lower rank than its own, as a token needn't be the sum of the two pieces it was learnt from.
That pair comes first then, so the other places of the word wait until it is merged; so results are exactly those of
merging each word's lowest rank, leftmost place first. A word that is a token as a whole is that token.

Defined cases: a null or empty text has no tokens; texts are encoded whole, a word of any length at some
twenty bytes for each of its own; strings of special tokens are plain text; repeated rows are encoded each; an empty table gives no rows;
columns n_tokens, ids and decoded are replaced, others kept.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain
from typing import Any

import numpy as np
import regex
from pyspark.sql import DataFrame

from docket.llm.shared import with_python_columns


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank: a line is a token in base 64 and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Replay:
    """The merges of one vocabulary. `show` makes what is remembered of a word from its ids."""

    def __init__(self, tokens: list[bytes], pattern: str, show: Callable[[list[int]], Any] = list, keep: int = 500_000):
        self.tokens, self.split, self.show, self.keep = tokens, regex.compile(pattern), show, keep
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        joins = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.joins = np.array(joins, np.int32)
        self.known: dict[str, Any] = {}

    def rank(self, left: int, right: int) -> int:
        return self.ranks.get(self.tokens[left] + self.tokens[right], -1)

    def words(self, words: list[bytes], many: int = 128) -> list[list[int]]:
        """The ids of each word, none of which is empty. `many`: so many places of a rank are merged by numpy together."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = len(data)
        ends = np.cumsum([len(w) for w in words])
        at_first = np.concatenate([[0], ends[:-1]])
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
        first = np.full(size, -1, np.int32)
        first[:-1] = self.joins[data[:-1].astype(np.int32) * 256 + data[1:]]
        first[ends - 1] = -1
        # for each place: its id or -1 once it's merged into another, the rank of its pair or -1, its neighbours or -1
        ids, pair, after, before = (array("i", bytes(4 * size)) for _ in range(4))
        all_ids, all_pair, all_after, all_before = (np.frombuffer(x, np.int32) for x in (ids, pair, after, before))
        all_ids[:], all_pair[:] = self.bytes[data], first
        all_after[:], all_before[:] = np.arange(1, size + 1), np.arange(-1, size - 1)
        all_after[ends - 1] = all_before[at_first] = -1
        index: dict[int, array] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order].astype(np.int32), ranks[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(ranks)]):
                add_to(int(ranks[i])).frombytes(places[i:j].tobytes())

        def add_to(rank: int) -> array:
            if rank not in index:
                index[rank] = array("i")
                heappush(heap, rank)
            return index[rank]

        def together(rank: int, i: np.ndarray) -> None:
            """Merges places in different words."""
            j = all_after[i]
            k, h = all_after[j], all_before[i]
            all_ids[i], all_ids[j], all_pair[j], all_after[i], all_pair[i] = rank, -1, -1, k, -1
            for at, neighbour, is_left in ((i[k >= 0], k[k >= 0], True), (h[h >= 0], h[h >= 0], False)):
                found, which = np.unique(all_ids[neighbour], return_inverse=True)
                made = [self.rank(rank, x) if is_left else self.rank(x, rank) for x in found.tolist()]
                new = np.array(made, np.int32)[which]
                all_pair[at] = new
                add(at, new)
            all_before[k[k >= 0]] = i[k >= 0]

        def in_turn(rank: int, places: list[int]) -> None:
            """Merges places from left to right. Those of a word that gets a lower rank wait."""
            waiting, wait_to = array("i"), 0
            for i in places:
                if pair[i] != rank:
                    continue
                if i < wait_to:
                    waiting.append(i)
                    continue
                j = after[i]
                k, h = after[j], before[i]
                ids[i], ids[j], pair[j], after[i] = rank, -1, -1, k
                lower, pair[i] = False, -1
                if k >= 0:
                    before[k] = i
                    new = pair[i] = self.rank(rank, ids[k])
                    if new >= 0:
                        lower = new < rank
                        add_to(new).append(i)
                if h >= 0:
                    new = pair[h] = self.rank(ids[h], rank)
                    if new >= 0:
                        lower |= new < rank
                        add_to(new).append(h)
                if lower:
                    wait_to = int(ends[word_of[i]])
            if waiting:
                add_to(rank).extend(waiting)

        add(np.arange(size), first)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            if len(places) < many:
                in_turn(rank, sorted(set(places)))
                continue
            places = np.unique(np.frombuffer(places, np.int32))
            places = places[all_pair[places] == rank]
            word = word_of[places]
            alone = np.ones(len(word), bool)
            alone[1:] &= word[1:] != word[:-1]
            alone[:-1] &= word[1:] != word[:-1]
            if alone.any():
                together(rank, places[alone])
            in_turn(rank, places[~alone].tolist())
        stands = all_ids >= 0
        cuts = np.cumsum(stands)[ends - 1].tolist()
        left = all_ids[stands].tolist()
        return [left[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def block(self, texts: list[str | None]) -> list[list[Any]]:
        """What `show` makes of each word of each text. Short words are remembered, up to `keep` of them and a block's."""
        if len(self.known) > self.keep:
            self.known.clear()
        split = [self.split.findall(t) if t else [] for t in texts]
        known, show = self.known, self.show
        new = {w: w.encode("utf-8", "surrogatepass") for w in set(chain.from_iterable(split)).difference(known)}
        whole = {w: self.ranks[data] for w, data in new.items() if data in self.ranks}
        known.update((w, show([i])) for w, i in whole.items())
        rest = [w for w in new if w not in whole]
        if rest:
            known.update(zip(rest, map(show, self.words([new[w] for w in rest]))))
        found = [list(map(known.__getitem__, words)) for words in split]
        for w in [w for w in rest if len(w) > 64]:
            del known[w]
        return found

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(1)
def replay_at(path: str, pattern: str) -> Replay:
    """One in each Python worker, for all its tasks. Of a word it keeps the number of its ids, them as text, and their bytes."""
    replay = Replay(read_ranks(path), pattern)
    replay.show = lambda ids: (len(ids), ",".join(map(str, ids)), replay.decode(ids))
    return replay


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`documents` (text, ...) with n_tokens, ids (decimal, joined by commas) and decoded (the bytes that they stand for).

    Each match of `pattern` is a word. The file is read where the tasks run, as part of their Python installation.
    """

    def make():
        replay = replay_at(ranks_path, pattern)

        def run(part):
            counts, said, decoded = [], [], []
            for words in replay.block(part.column("text").to_pylist()):
                counts.append(sum([w[0] for w in words]))
                said.append(",".join([w[1] for w in words]))
                decoded.append(b"".join([w[2] for w in words]))
            return [counts, said, decoded]

        return run

    return with_python_columns(documents, make, "n_tokens long, ids string, decoded binary", rows=2048)
