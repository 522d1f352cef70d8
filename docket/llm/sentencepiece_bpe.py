"""SentencePiece BPE encoding by a table over prefixes, and decoding.

The ids of a text under merge-type BPE follow from one fact: the encoding of a prefix ends in exactly one token, the only
suffix token whose own prefix's last token can stand before it. So a table of the last token of every prefix is filled
from left to right: an automaton over the vocabulary gives the tokens that end at a position, longest first, and a test
of the pair decides. Ids are then read off backwards.

A pair (a, b) can stand together if undoing the merges of both from the last merge on never finds a merge across the
border that the library would have made earlier. Merges are ranked by the score of what they make; among equal
scores the left one comes first.

The model file is read by a small reader of its own wire format, so that encoding needs no tokenizer library. No
piece contains the space mark after another character, and line feeds are in no piece, so stretches between these are
encoded apart, and those of common words are kept in a table of bounded size.

Defined cases: a null text is empty; an empty text has the end id alone; characters outside the vocabulary become
their UTF-8 bytes' ids; the decoder drops control ids, joins byte ids to characters and puts U+FFFD for each byte that
is no part of one, and drops the first space if it came from the dummy prefix. Repeated rows are encoded each; an empty
table gives no rows; columns `n_tokens`, `ids` and `decoded` are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from docket.llm.shared import with_python_columns

MARK = "▁"
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = 4 if kind == 5 else 8 if kind == 1 else varint()
            yield key >> 3, data[at : at + size]
            at += size


class BpeModel:
    """Vocabulary, automaton and pair tests of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or spec.get(2) or spec.get(4, 1):
            raise ValueError("only merge-type models with byte fallback and no normalisation are read")
        self.prefix = bool(spec.get(3, 1))
        self.eos = self.kinds.index(CONTROL) + 1 if trainer.get(42) is None else trainer[42]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses the border between words")
        #: Ids from here on are pieces of text.
        self.first_word = 1 + max(i for i, k in enumerate(self.kinds) if k != NORMAL)
        self.written = [f" {i}" for i in range(len(self.pieces))]
        self._split: dict[int, tuple[int, int] | None] = {}
        self._pair: dict[int, bool] = {}
        self._build()

    def _build(self) -> None:
        """Trie with failure links over the pieces that merges can make; `out`: tokens that end here, longest first."""
        chars = {p for p in self.ids if len(p) == 1}
        self.usable = {p for p in self.ids if len(p) == 1 or set(p) <= chars}
        self.goto: list[dict[str, int]] = [{}]
        token: list[int] = [-1]
        for p in sorted(self.usable, key=len):
            if len(p) > 1 and self.parts(self.ids[p]) is None:
                continue
            node = 0
            for c in p:
                node = self.goto[node].setdefault(c, len(self.goto))
                if node == len(token):
                    self.goto.append({})
                    token.append(-1)
            token[node] = self.ids[p]
        self.fail = [0] * len(token)
        self.out: list[tuple[tuple[int, int], ...]] = [()] * len(token)
        layer = list(self.goto[0].values())
        for node in layer:
            self.out[node] = ((token[node], 1),) if token[node] >= 0 else ()
        while layer:
            following = []
            for node in layer:
                for c, child in self.goto[node].items():
                    f = self.fail[node]
                    while f and c not in self.goto[f]:
                        f = self.fail[f]
                    self.fail[child] = self.goto[f].get(c, 0)
                    own = ((token[child], len(self.pieces[token[child]])),) if token[child] >= 0 else ()
                    self.out[child] = own + self.out[self.fail[child]]
                    following.append(child)
            layer = following

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a character, or where merging its characters ends elsewhere."""
        if token not in self._split:
            piece = self.pieces[token]
            self._split[token] = None
            work = [c for c in piece]
            last = None
            while len(work) > 1:
                best = None
                for i in range(len(work) - 1):
                    made = self.ids.get(work[i] + work[i + 1])
                    if made is not None and (best is None or self.scores[made] > best[0]):
                        best = (self.scores[made], i)
                if best is None:
                    break
                i = best[1]
                last = (work[i], work[i + 1])
                work[i : i + 2] = [work[i] + work[i + 1]]
            if len(work) == 1 and last:
                self._split[token] = (self.ids[last[0]], self.ids[last[1]])
        return self._split[token]

    def may_stand(self, left: int, right: int) -> bool:
        """Whether merging leaves exactly the tokens (left, right) of the characters of both."""
        key = left * len(self.pieces) + right
        if key not in self._pair:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            self._pair[key] = self._test(left, right)
        return self._pair[key]

    def _test(self, left: int, right: int) -> bool:
        """Undoes the later of both sides' last merges, step by step.

        While the pair that now meets at the border would be merged before the merge that was undone last, the tokens
        cannot stand together. `bar` is the score of that merge; `left_bar` tells on which side it was: among equal
        scores the left merge comes first.
        """
        a, b = left, right
        bar, left_bar = -float("inf"), False
        while True:
            made = self.ids.get(self.pieces[a] + self.pieces[b])
            if made is not None:
                score = self.scores[made]
                if score > bar or (score == bar and not left_bar):
                    return False
            pa, pb = self.parts(a), self.parts(b)
            if pa is None and pb is None:
                return True
            sa = self.scores[a] if pa else float("inf")
            sb = self.scores[b] if pb else float("inf")
            if pa and (pb is None or sa < sb):
                bar, left_bar, a = sa, True, pa[1]
            else:
                bar, left_bar, b = sb, False, pb[0]

    def encode_stretch(self, stretch: str) -> list[int]:
        """Ids of a stretch without a border inside, by the table of last tokens.

        Steps of the automaton that followed failure links are kept as edges of their own, as are tested pairs.
        """
        step, out, pairs, n = self.goto, self.out, self._pair, len(self.pieces)
        tokens: list[int] = []
        begins: list[int] = []
        node = end = 0
        for c in stretch:
            try:
                node = step[node][c]
            except KeyError:
                node = self.follow(node, c)
            end += 1
            for token, size in out[node]:
                begin = end - size
                if begin:
                    before = tokens[begin - 1]
                    if before >= 0:
                        stands = pairs.get(before * n + token)
                        if stands is None:
                            stands = self.may_stand(before, token)
                        if not stands:
                            continue
                tokens.append(token)
                begins.append(begin)
                break
            else:
                tokens.append(-1)
                begins.append(end - 1)
        ids: list[int] = []
        while end:
            token, begin = tokens[end - 1], begins[end - 1]
            if token >= 0:
                ids.append(token)
            else:
                ids.extend([self.bytes[b] for b in reversed(stretch[begin].encode())])
            end = begin
        ids.reverse()
        return ids

    def follow(self, node: int, c: str) -> int:
        """The node after `c`, through failure links; kept as an edge for characters of the vocabulary, a bounded set."""
        at = node
        while at and c not in self.goto[at]:
            at = self.fail[at]
        to = self.goto[at].get(c, 0)
        if to:
            self.goto[node][c] = to
        return to

    def decode(self, ids: list[int], begins: bool = True) -> str:
        """The text of ids, as decode(encode(text)) of the library; `begins`: the first space is the dummy prefix."""
        if self.first_word <= min(ids, default=0):
            text = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
            return text[1:] if begins and self.prefix and text.startswith(" ") else text
        parts: list[str] = []
        pending = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                parts.append(decode_bytes(bytes(pending)))
                pending.clear()
            if i >= 0 and self.kinds[i] != CONTROL:
                parts.append(self.pieces[i] if self.kinds[i] != UNKNOWN else " ⁇ ")
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if begins and self.prefix and text.startswith(" ") else text


def decode_bytes(data: bytes) -> str:
    """UTF-8, with U+FFFD for each single byte that is no part of a character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


#: Stretches that are encoded apart.
STRETCH = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class Encoder:
    """Encodes texts; keeps what it found for at most twice `keep` short stretches, those of late use."""

    def __init__(self, model: BpeModel, keep: int = 150_000):
        self.model, self.keep = model, keep
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def stretch(self, s: str) -> tuple[int, str, str]:
        """(number of ids, the ids each after a space, decoded text) of a stretch that isn't in `known`."""
        found = self.older.get(s)
        if found is None:
            found = self.encoded(s)
        if len(s) < 64:
            if len(self.known) >= self.keep:
                self.older, self.known = self.known, {}
            self.known[s] = found
        return found

    def encoded(self, s: str) -> tuple[int, str, str]:
        ids = self.model.encode_stretch(s)
        written = self.model.written
        return len(ids), "".join([written[i] for i in ids]), self.model.decode(ids, False)

    def text(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids with the end id, ids joined by spaces, decoded text)."""
        marked = (text or "").replace(" ", MARK)
        if marked and self.model.prefix:
            marked = MARK + marked
        stretch, parts = self.stretch, []
        for s in STRETCH.findall(marked):
            parts.append(self.known.get(s) or stretch(s))
        ids = "".join([p[1] for p in parts]) + f" {self.model.eos}"
        decoded = "".join([p[2] for p in parts])
        if self.model.prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        return sum(p[0] for p in parts) + 1, ids[1:], decoded


@lru_cache(1)
def encoder_at(path: str) -> Encoder:
    """One in each Python worker, for all its tasks."""
    return Encoder(BpeModel(path))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """`documents` with n_tokens (end id included), ids (decimal, joined by spaces) and decoded.

    The model file is read where the tasks run; it is part of their Python installation.
    """

    def make():
        encoder = encoder_at(model_path)

        def run(part):
            found = [encoder.text(t) for t in part.column("text").to_pylist()]
            return [list(column) for column in zip(*found)]

        return run

    return with_python_columns(documents, make, "n_tokens long, ids string, decoded string", rows=128)
