"""Alignment of two tokenizers: which tokens of A and B cover the same bytes, and in how many documents each pair does.

Each task cuts its documents into blocks and inverts them: for a pair of ids, a bitmap has the block's documents that
hold it linked, and further bitmaps (planes) the bits of how often more than once. A bitmap is kept as sorted 16-bit
document numbers or, where that is longer, as plain bits. A block is one container of the corpus-wide bitmap, and no
document is in two; so the OR of a pair's containers is all of them, its popcount the sum of theirs, and only popcounts are
shuffled to count documents. The counts return to the postings, and from there, block by block, to the documents, as
sums over bitmaps. A block's size is bounded by its links, and no pair's postings are ever in one place.

A: byte-level BPE, encoded by replayed merges (byte_bpe). B: SentencePiece, encoded by its library; where no piece goes on
after a character with a space, each run of spaces with what follows is encoded once in a task.

Defined cases: texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens, zeros, and
empty groups; strings of special tokens are plain text; a text of any length is one document; rows with equal ids or texts
are documents of their own; ties for the highest count all count; an empty table gives no rows; the columns n_a, n_b,
n_groups, n_links, n_best, count_sum and groups are replaced, others of any name are kept.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docket.llm.byte_bpe import Replay
from docket.llm.shared import free_name, written
from docket.llm.wordpiece import printable_bytes

#: Links of a block: it ends with the document that reaches as many. Documents of a block: what 16 bits hold.
LINKS, SLOTS = 1_500_000, 60_000
#: So many counts of pairs are sent to all tasks, some 60 MB in memory; more of them are joined as Spark sees fit.
MOST_COUNTS = 1_000_000
UNITS = re.compile(" *[^ ]+| +")
POSTINGS = [
    T.StructField("block", T.LongType()),
    T.StructField("slot", T.IntegerType()),
    T.StructField("pair", T.LongType()),
    T.StructField("plane", T.IntegerType()),
    T.StructField("n_docs", T.IntegerType()),
    T.StructField("dense", T.BooleanType()),
    T.StructField("docs", T.BinaryType()),
]
COUNTS = [
    *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
    T.StructField("groups", T.StringType()),
]


def read_byte_level(path: str) -> list[bytes]:
    """Tokens of a byte-level vocabulary file by id, where ids follow the order of merges; special tokens are left empty."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    table = printable_bytes()
    tokens = [b""] * (1 + max(model["model"]["vocab"].values()))
    for piece, i in model["model"]["vocab"].items():
        if piece not in special:
            tokens[i] = bytes(table[c] for c in piece)
    return tokens


class Pieces:
    """The SentencePiece side: ids of a text, and each piece's bytes."""

    def __init__(self, path: str, keep: int = 500_000):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        self.by_unit = not any(re.search("[^▁]▁", p) for p in names)
        # a last space, which can't be encoded alone: the library adds the space in front to no empty text
        self.last_space = {" ": packed(self.library.encode("a ")[len(self.library.encode("a")) :])}
        self.known, self.changed = dict(self.last_space), set()
        self.keep = keep

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, or None where they don't stand for its bytes."""
        if not self.by_unit:
            found = [np.array(ids, np.int32) for ids in self.library.encode(texts, num_threads=1)]
            return [ids if self.decode(ids) == b" " + t.encode("utf-8", "surrogatepass") else None for ids, t in zip(found, texts)]
        if len(self.known) > self.keep:
            self.known, self.changed = dict(self.last_space), set()
        known = self.known
        split = [UNITS.findall(" " + t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(known))
        tokens = self.tokens
        for u, ids in zip(new, self.library.encode([u[1:] for u in new], num_threads=1)):
            known[u] = packed(ids)
            if b"".join([tokens[i] for i in ids]) != u.encode("utf-8", "surrogatepass"):
                self.changed.add(u)
        found = [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in split]
        if self.changed:
            for n, units in enumerate(split):
                if not self.changed.isdisjoint(units) and self.decode(found[n]) != b" " + texts[n].encode("utf-8", "surrogatepass"):
                    found[n] = None
        for u in new:
            if len(u) > 64:
                del known[u]
                self.changed.discard(u)
        return found


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Aligner:
    """Both vocabularies, and links and groups of a batch of texts laid end to end."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a = Replay(read_byte_level(a_path), pattern, packed)
        self.b = Pieces(b_path)
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        digits = [str(i).encode() for i in range(max(len(self.a.tokens), len(self.b.tokens)))]
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        wide = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in digits), np.uint8).reshape(-1, wide)

    def batch(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links and groups. Of each link: its text's place, and its pair of ids."""
        out = [np.zeros(len(texts), np.int64) for _ in range(4)]
        groups = [""] * len(texts)
        none = np.zeros(0, np.int64)
        wanted = [i for i, t in enumerate(texts) if t]
        a_side = [np.frombuffer(b"".join(words), np.int32) for words in self.a.block([" " + texts[i] for i in wanted])]
        b_side = self.b.encode([texts[i] for i in wanted])
        place, a, b, n_bytes = [], [], [], []
        for i, x, y in zip(wanted, a_side, b_side):
            size = 1 + len(texts[i].encode("utf-8", "surrogatepass"))
            # A's words are pieces of the text in order: of its length, they are all of it
            if y is not None and int(self.size_a[x].sum()) == size:
                place.append(i)
                a.append(x)
                b.append(y)
                n_bytes.append(size)
        if not place:
            return out, groups, none, none
        out[0][place], out[1][place] = [len(x) for x in a], [len(y) for y in b]
        a, b = np.concatenate(a), np.concatenate(b)
        # the texts end to end: at which bytes do tokens end
        ends_a, ends_b = (np.zeros(sum(n_bytes) + 1, bool) for _ in range(2))
        ends_a[np.cumsum(self.size_a[a])] = True
        ends_b[np.cumsum(self.size_b[b])] = True
        ends = np.flatnonzero(ends_a | ends_b)
        is_a, is_b = ends_a[ends], ends_b[ends]
        group = np.cumsum(is_a & is_b)
        per_text = np.diff(np.searchsorted(ends, np.cumsum(n_bytes)), prepend=-1)
        out[3][place] = per_text
        out[2][place] = np.diff(group[np.cumsum(per_text) - 1], prepend=0)
        # each stretch between ends is in one token of A and one of B
        pairs = a.astype(np.int64)[np.cumsum(is_a) - is_a] << 16 | b[np.cumsum(is_b) - is_b]
        group -= is_a & is_b
        # the tokens in order of groups, A's before B's; after each, what follows it in the text form
        in_a, in_b = group[is_a], group[is_b]
        n_groups = int(group[-1]) + 1
        per_a, per_b = np.bincount(in_a, minlength=n_groups), np.bincount(in_b, minlength=n_groups)
        at_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[in_a]
        at_b = np.arange(len(b)) + np.cumsum(per_a)[in_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        follows = np.full(len(ids), ord(","), np.uint8)
        follows[at_a[np.cumsum(per_a) - 1]], follows[at_b[np.cumsum(per_b) - 1]] = ord("|"), ord(";")
        size = self.n_digits[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), size] = follows
        data = rows[rows != 0].tobytes()
        stops = np.append(0, np.cumsum(size + 1))[np.append(0, np.cumsum(out[0][place] + out[1][place]))].tolist()
        for i, start, end in zip(place, stops, stops[1:]):
            groups[i] = data[start : end - 1].decode()
        return out, groups, np.repeat(place, per_text), pairs


@lru_cache(1)
def aligner_at(a_path: str, b_path: str, pattern: str) -> Aligner:
    """One in each Python worker, for all its tasks."""
    return Aligner(a_path, b_path, pattern)


def bitmaps(codes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of sorted pair << 16 | slot: each pair, how many documents it has, whether they are plain bits, and the bitmap."""
    pairs, starts = np.unique(codes >> 16, return_index=True)
    counts = np.diff(np.append(starts, len(codes)))
    low = (codes & 0xFFFF).astype("<u2")
    wide = (slots + 7) // 8
    dense = 2 * counts > wide
    if not dense.any():
        offsets = np.append(2 * starts, 2 * len(low)).astype(np.int32)
        return pairs, counts, dense, pa.Array.from_buffers(pa.binary(), len(pairs), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
    sizes = np.where(dense, wide, 2 * counts)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    data = np.zeros(offsets[-1], np.uint8)
    sparse = np.repeat(~dense, counts)
    data[np.repeat(~dense, sizes)] = low[sparse].view(np.uint8)
    bit = low[~sparse].astype(np.int64)
    np.bitwise_or.at(data, np.repeat(offsets[:-1][dense], counts[dense]) + bit // 8, (1 << bit % 8).astype(np.uint8))
    return pairs, counts, dense, pa.Array.from_buffers(pa.binary(), len(pairs), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def documents_of(docs: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots in all bitmaps, and the row of each: bitmaps() backwards."""
    offsets = np.frombuffer(docs.buffers()[1], np.int32)[docs.offset : docs.offset + len(docs) + 1]
    data = np.frombuffer(docs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    is_bits = np.repeat(dense, sizes)
    rows = np.repeat(np.arange(len(docs)), sizes)
    bits = np.unpackbits(data[is_bits], bitorder="little").astype(bool)
    in_row = (np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes))[is_bits]
    slots = (8 * in_row[:, None] + np.arange(8)).ravel()[bits]
    plain = data[~is_bits].view("<u2").astype(np.int64)
    return np.concatenate([plain, slots]), np.concatenate([rows[~is_bits][::2], np.repeat(rows[is_bits], 8)[bits]])


class Postings:
    """One block: its documents so far, and their links."""

    def __init__(self, block: int):
        self.block, self.slots, self.links = block, 0, 0
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, n: int, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Adds n documents with links; their slots."""
        codes, times = np.unique(pairs << 16 | (at + self.slots), return_counts=True)
        self.codes.append(codes)
        self.times.append(times)
        slots = np.arange(self.slots, self.slots + n, dtype=np.int32)
        self.slots, self.links = self.slots + n, self.links + len(codes)
        return slots

    def rows(self) -> Iterator[dict[str, pa.Array]]:
        """The bitmaps: in plane -1 the documents that hold a pair, in plane k those whose further links have bit k."""
        codes, times = np.concatenate(self.codes), np.concatenate(self.times)
        order = np.argsort(codes)
        codes, more = codes[order], times[order] - 1
        for plane in range(-1, int(more.max(initial=0)).bit_length()):
            chosen = codes if plane < 0 else codes[more >> plane & 1 == 1]
            if len(chosen):
                pairs, counts, dense, docs = bitmaps(chosen, self.slots)
                kinds = {"pair": pairs, "n_docs": counts.astype(np.int32), "dense": dense}
                kinds |= {"block": np.full(len(pairs), self.block), "plane": np.full(len(pairs), plane, np.int32)}
                yield {k: pa.array(v) for k, v in kinds.items()} | {"docs": docs}


def align(documents: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Rows of documents (pair is null) with n_a, n_b, n_groups, n_links, groups, and rows of postings; text is left out.

    Columns of `documents` with names of POSTINGS are replaced.
    """
    ours = {f.name for f in [*POSTINGS, *COUNTS]} | {"n_best", "count_sum"}
    others = [c for c in documents.columns if c.lower() not in ours | {"text"}]
    documents = documents.select(*others, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in documents.drop("text").schema), *COUNTS, *POSTINGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        aligner = aligner_at(a_path, b_path, pattern)
        number = TaskContext.get().partitionId() << 32

        def batch_of(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            whole = [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds]
            return pa.RecordBatch.from_arrays(whole, schema=kinds)

        def closed(block: Postings) -> Iterator[pa.RecordBatch]:
            for columns in block.rows():
                yield batch_of(len(columns["pair"]), columns)

        block = Postings(number)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                counts, groups, at, pairs = aligner.batch(part.column("text").to_pylist())
                slots = block.add(part.num_rows, at, pairs)
                columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, counts)))
                columns |= {"groups": pa.array(groups), "slot": pa.array(slots), "block": pa.array(np.full(len(slots), block.block))}
                yield batch_of(part.num_rows, columns | {c: part.column(c) for c in others})
                if block.links >= LINKS or block.slots >= SLOTS - 512:
                    yield from closed(block)
                    block = Postings(block.block + 1)
        if block.slots:
            yield from closed(block)

    return documents.mapInArrow(run, schema)


def returned(group: pa.Table) -> pa.Table:
    """Of one block's postings with the counts of their pairs: n_best and count_sum by slot."""
    group = group.combine_chunks()
    if not group.num_rows:
        return pa.table({"block": [], "slot": [], "n_best": [], "count_sum": []})
    docs = group.column("docs").chunk(0)
    slots, rows = documents_of(docs, group.column("dense").to_numpy())
    times = 1 << np.maximum(group.column("plane").to_numpy(), 0).astype(np.int64)
    best = np.where(group.column("best").to_numpy(), times, 0)
    most = int(slots.max()) + 1
    n_best, total = np.zeros(most, np.int64), np.zeros(most, np.int64)
    np.add.at(n_best, slots, best[rows])
    np.add.at(total, slots, (times * group.column("n").to_numpy())[rows])
    block = np.full(most, group.column("block")[0].as_py())
    return pa.table({"block": block, "slot": np.arange(most, dtype=np.int32), "n_best": n_best, "count_sum": total})


def scored(documents: DataFrame, a_path: str, b_path: str, pattern: str, groups: Column | None = None) -> DataFrame:
    """`documents` without text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    n_links: pairs of occurrences of A's and B's tokens that overlap; n_best: those whose pair of ids is linked in as
    many documents of the corpus as any with its A id; count_sum: the sum of these numbers over links. `groups` is what to
    keep of the groups, which are long: an expression of the columns groups and n_a. The table of counts is written once.
    """
    inner = [f.name for f in POSTINGS]
    aside = {c: free_name(documents, f"{c}_aside") for c in documents.columns if c.lower() in inner}
    found = align(documents.withColumnsRenamed(aside), a_path, b_path, pattern)
    found = found.withColumn("groups", F.col("groups") if groups is None else groups)
    found = written(found, "alignment")
    postings = found.where("pair is not null").select("block", "pair", "plane", "n_docs", "dense", "docs")
    counts = postings.where("plane < 0").groupBy("pair").agg(F.sum("n_docs").alias("n"))
    counts = written(counts, "pair-counts")
    # as many rows as A has ids
    highest = counts.groupBy(F.shiftright("pair", 16).alias("_a")).agg(F.max("n").alias("highest"))
    counts = counts.join(F.broadcast(highest), F.shiftright("pair", 16) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    if counts.count() <= MOST_COUNTS:
        counts = F.broadcast(counts)
    sums = (
        postings.join(counts, "pair")
        .select("block", "plane", "dense", "docs", "n", "best")
        .groupBy("block")
        .applyInArrow(returned, "block long, slot int, n_best long, count_sum long")
    )
    rows = found.where("pair is null").drop(*(c for c in inner if c not in ("block", "slot")))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return rows.join(sums, ["block", "slot"], "left").withColumns(zero).drop("block", "slot").withColumnsRenamed({v: k for k, v in aside.items()})
