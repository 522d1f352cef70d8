"""Token counts by greedy longest match, in one pass over each word and without building pieces.

A trie over the vocabulary has failure links: where the next byte has no edge, the walk pops the tokens that are certain
by then and goes on from a shorter suffix. How many tokens each node pops is computed once, so that a walk adds up
numbers only. Pieces that begin with a space open a word, all others continue it; a word is its UTF-8 bytes after a
space.

Defined cases: a null or empty text has no words and no tokens; words are runs of other characters than blanks (space
and U+0009 to U+000D); a word with a byte that no piece covers counts as one unknown token; very long words are
walked in linear time; repeated rows are counted each; an empty table gives no rows; columns n_words and n_tokens are
replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from docket.llm.shared import with_python_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> set[bytes]:
    """Pieces of a byte-level vocabulary file as bytes, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    table = printable_bytes()
    return {bytes(table[c] for c in p) for p in model["model"]["vocab"] if p not in special}


class Counter:
    """The automaton: edges, failure links, and the number of tokens popped on following each link."""

    def __init__(self, pieces: set[bytes], keep: int = 400_000):
        self.edges: list[dict[int, int]] = [{}]
        whole = [False]
        for p in pieces:
            if not p or b" " in p[1:]:
                continue
            node = 0
            for c in p:
                node = self.edges[node].setdefault(c, len(self.edges))
                if node == len(whole):
                    self.edges.append({})
                    whole.append(False)
            whole[node] = True
        self.link: list[int] = [-1] * len(whole)
        self.pops = [0] * len(whole)
        layer = [(0, c, v) for c, v in self.edges[0].items()]
        while layer:
            following = []
            for parent, c, v in layer:
                if whole[v]:
                    self.link[v], self.pops[v] = 0, 1
                else:
                    z, popped = self.link[parent], self.pops[parent]
                    while z >= 0 and c not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.pops[v] = self.edges[z][c], popped
                following += [(v, d, w) for d, w in self.edges[v].items()]
            layer = following
        self.keep, self.known = keep, {}

    def walk(self, word: bytes) -> int:
        """Tokens of a word; 1 if some part can't be matched."""
        edges, link, pops = self.edges, self.link, self.pops
        node = count = 0
        for c in word:
            while c not in edges[node]:
                if link[node] < 0:
                    return 1
                count += pops[node]
                node = link[node]
            node = edges[node][c]
        while node:
            if link[node] < 0:
                return 1
            count += pops[node]
            node = link[node]
        return count

    def word(self, word: str) -> int:
        count = self.walk(b" " + word.encode("utf-8", "surrogatepass"))
        if len(word) < 64:
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = count
        return count

    def text(self, text: str | None) -> tuple[int, int]:
        words = WORD.findall(text or "")
        known, count = self.known.get, self.word
        return len(words), sum([known(w) or count(w) for w in words])


@lru_cache(1)
def counter_at(path: str) -> Counter:
    """One in each Python worker, for all its tasks."""
    return Counter(read_vocabulary(path))


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """`documents` with n_words and n_tokens. The file is read where the tasks run, as part of their Python installation."""

    def make():
        counter = counter_at(vocabulary_path)

        def run(part):
            found = [counter.text(t) for t in part.column("text").to_pylist()]
            return [list(column) for column in zip(*found)]

        return run

    return with_python_columns(documents, make, "n_words long, n_tokens long")
