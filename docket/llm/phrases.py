"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are sequences of up to three words of one language, edges four words: each occurrence of a word opens one edge, to
the node that overlaps it by all but its first word. Where the piece ends sooner, the edge is shorter and is the
correction for that end. Edges with equal words are one edge with a weight. A shorter phrase's count is then the flow
through its node: the weights of all edges that begin with it, ends included; nothing but edges is counted in texts.

A word that is rarer than a candidate must be can't be in one; it ends a piece like a stop does, and takes its flow along.

Edges are summed in blocks of text, then dealt out by a hash of their first word, in packed rows of a dictionary and
numbers, and summed again where they meet. Where that word is frequent, the second word is hashed too, and so on: so no
bucket depends on one word or phrase, and the counts of phrases of frequent words alone are partial sums, which Spark adds up. With
more than `bucket_words` words a bucket, rows are dealt out in several rounds, `fan_out` ways each, so that rows grow
with the edges only. A path on which all flow goes one way (one edge, no end) is compacted: its shorter phrases take the count
of the longer one, which holds them, so only the longest is a candidate.

Defined cases: a null or empty text has no words; a null language is `und`; words are compared as UTF-8 bytes with A-Z
lower-cased; repeated rows count each; pieces of any length are taken whole; an empty table gives no rows; of tied cuts, the
one after fewest words counts, and tied phrases are in byte order; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.shared import discarding, written

WORDS = 4
#: Bytes of text that one block holds at least, unless its task has less.
BLOCK = 12 << 20
#: A-Z lower-cased, a tab as a space, and the end of a piece as a byte that UTF-8 doesn't have.
END = 0xFF
TABLE = bytes(END if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
PACKED = "bucket long, packed binary"
#: Columns of what the first pass counts.
COUNTED = ["lang", "word", "slot", "n"], [pa.string(), pa.binary(), pa.int64(), pa.int64()]
#: Slots of hashed words: 2 MB of bits.
SLOTS = 1 << 24


def tokens(text: str) -> list[bytes]:
    """The words of a text, and b"\\xff" where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b"\xff", b" \xff ").split(b" ")


class Edges:
    """Edges as rows of WORDS word numbers, 0 after a piece's end, with weights. Word numbers are places in `words`."""

    def __init__(self, words: list[bytes], rows: np.ndarray, weights: np.ndarray):
        self.words, self.rows, self.weights = words, rows, weights

    def summed(self) -> Edges:
        """Equal rows as one, in order of their numbers."""
        n = len(self.words)
        code = self.rows[:, 0].astype(np.int64)
        for k in range(1, WORDS):
            if n * (int(code.max(initial=0)) + 1) >= 1 << 63:
                code = np.unique(code, return_inverse=True)[1]
            code = code * n + self.rows[:, k]
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
        weights = np.zeros(len(first), np.int64)
        np.add.at(weights, at, self.weights)
        return Edges(self.words, self.rows[first], weights)

    def packed(self, chosen: np.ndarray) -> bytes:
        """Some edges with the words they use, for another task."""
        used, numbers = np.unique(self.rows[chosen], return_inverse=True)
        words = b"\n".join([self.words[i] for i in used if i])
        numbers = numbers.reshape(-1, WORDS).astype(np.int32) + (used[0] != 0)
        parts = [len(words), len(numbers)], numbers.T.ravel(), self.weights[chosen]
        data = b"".join(np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(parts, (np.int64, np.int32, np.int64)))
        return pa.compress(data + words, "zstd", asbytes=True) + (len(data) + len(words)).to_bytes(8, "little")

    @staticmethod
    def merged(parts: list[bytes], at_once: int = 2_000_000) -> Edges:
        """The sum of packed edges, added up whenever `at_once` rows wait."""
        known: dict[bytes, int] = {b"": 0}
        rows, weights, waiting = [np.zeros((0, WORDS), np.int32)], [np.zeros(0, np.int64)], 0
        for part in parts:
            data = pa.decompress(part[:-8], int.from_bytes(part[-8:], "little"), "zstd", asbytes=True)
            size, n = np.frombuffer(data, np.int64, 2).tolist()
            words = data[len(data) - size :].split(b"\n") if size else []
            numbers = np.array([0, *[known.setdefault(w, len(known)) for w in words]], np.int32)
            rows.append(numbers[np.frombuffer(data, np.int32, n * WORDS, 16)].reshape(WORDS, n).T)
            weights.append(np.frombuffer(data, np.int64, n, 16 + 4 * WORDS * n))
            waiting += n
            if waiting >= at_once:
                sums = Edges(list(known), np.concatenate(rows), np.concatenate(weights)).summed()
                rows, weights, waiting = [sums.rows], [sums.weights], 0
        return Edges(list(known), np.concatenate(rows), np.concatenate(weights)).summed()


class Numbers(dict):
    """Numbers of the words of one language in a block. Words that can't be frequent get the number of a piece's end."""

    def __init__(self, lang: str, words: list[bytes], frequent: np.ndarray | None):
        super().__init__({b"": -1, b"\xff": 0})
        self.head = lang.encode("utf-8", "surrogatepass").hex().encode() + b"\t"
        self.words, self.frequent = words, frequent

    def __missing__(self, word: bytes) -> int:
        key = self.head + word
        if self.frequent is not None and not self.frequent[zlib.crc32(key) % SLOTS]:
            number = 0
        else:
            number = len(self.words)
            self.words.append(key)
        self[word] = number
        return number


class Block:
    """The graph of some texts. A word's bytes stand after its language and a tab, so that languages don't meet."""

    def __init__(self, frequent: np.ndarray | None = None):
        self.known: dict[str, Numbers] = {}
        self.frequent = frequent
        self.words: list[bytes] = [b""]
        self.numbers: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str, lang: str | None) -> None:
        lang = "und" if lang is None else lang
        if lang not in self.known:
            self.known[lang] = Numbers(lang, self.words, self.frequent)
        numbers = np.array(list(map(self.known[lang].__getitem__, tokens(text))), np.int32)
        self.numbers += [numbers[numbers >= 0], np.zeros(1, np.int32)]
        self.size += len(text)

    def edges(self) -> Edges:
        line = np.concatenate([*self.numbers, np.zeros(WORDS, np.int32)])
        starts = np.flatnonzero(line[:-WORDS])
        rows = np.stack([line[starts + k] for k in range(WORDS)], axis=1)
        for k in range(1, WORDS):
            rows[rows[:, k - 1] == 0, k] = 0
        return Edges(self.words, rows, np.ones(len(rows), np.int64)).summed()


def blocks(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None = None) -> Iterator[Block]:
    block = Block(frequent)
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang")):
            if text.is_valid:
                block.add(text.as_py(), lang.as_py())
                if block.size >= BLOCK:
                    yield block
                    block = Block(frequent)
    if block.size:
        yield block


def buckets_of(edges: Edges, hot: frozenset[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each edge's bucket, and how many of its words the bucket depends on: up to the first that isn't frequent."""
    hashes = np.array([zlib.crc32(w) for w in edges.words], np.uint64)
    frequent = np.array([w in hot for w in edges.words])
    mixed, depth = np.zeros(len(edges.rows), np.uint64), np.ones(len(edges.rows), np.int8)
    going = np.ones(len(edges.rows), bool)
    for k in range(WORDS):
        if k:
            going &= frequent[edges.rows[:, k - 1]]
            depth += going
        step = (mixed ^ hashes[edges.rows[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = np.where(going, step ^ (step >> np.uint64(29)), mixed)
    return (mixed % np.uint64(buckets)).astype(np.int64), depth


def dealt(edges: Edges, digits: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Packed edges for each digit."""
    order = np.argsort(digits, kind="stable")
    found, starts = np.unique(digits[order], return_index=True)
    for digit, chosen in zip(found.tolist(), np.split(order, starts[1:])):
        if len(chosen):
            yield digit, edges.packed(chosen)


def table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def word_totals(documents: DataFrame, least: int, share: int) -> tuple[DataFrame, int, frozenset[bytes], np.ndarray]:
    """(lang, n) of all words and their sum; words that are very frequent; and, of SLOTS slots of hashed words, which may be frequent.

    The very frequent are fewer than 2 * `share` words: all that are more than one word in `share`, and maybe some that are more than one in
    twice as many, as a block names those of its own. A slot sums all words with its hash, so a word in a slot of less
    than `least` isn't found `least` times. Its bits have a fixed size; the more words there are, the fewer it excludes.
    """

    def run(batches):
        for block in blocks(batches):
            numbers = np.concatenate(block.numbers)
            counts = np.bincount(numbers, minlength=len(block.words))
            counts[0] = 0
            total = int(counts.sum())
            slots = np.array([zlib.crc32(w) % SLOTS for w in block.words], np.int64)
            places, sums = sums_by(slots[1:], counts[1:])
            per_lang = Counter()
            for w, n in zip(block.words[1:], counts[1:].tolist()):
                per_lang[w[: w.index(b"\t")]] += n
            rows = [(bytes.fromhex(x.decode()).decode("utf-8", "surrogatepass"), None, n) for x, n in per_lang.items()]
            rows += [(None, block.words[i], int(counts[i])) for i in np.flatnonzero(counts * 2 * share > total)]
            yield table([(*r[:2], None, r[2]) for r in rows], *COUNTED)
            empty = [pa.nulls(len(places), kind) for kind in COUNTED[1][:2]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(places), pa.array(sums)], COUNTED[0])

    sums = documents.mapInArrow(run, "lang string, word binary, slot long, n long").groupBy("lang", "word", "slot").agg(F.sum("n").alias("n"))
    sums = written(sums, "word-totals")
    langs = written(sums.where("lang is not null").select("lang", "n"), "words")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = sums.where(F.col("word").isNotNull() & (F.col("n").cast("decimal(38,0)") * 2 * share > total)).collect()
    bits = np.zeros(SLOTS, bool)
    slots = sums.where((F.col("slot").isNotNull()) & (F.col("n") >= least)).groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("part"))
    for r in slots.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")).collect():
        part = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        bits[(r.part - 1) * len(part) :][: len(part)] = part
    return discarding((langs, total, frozenset(bytes(r.word) for r in hot), np.packbits(bits)), sums)


def phrase_counts(
    documents: DataFrame, least: int, bucket_words: int = 3_000_000, fan_out: int = 256
) -> tuple[DataFrame, DataFrame]:
    """Counts of phrases of `documents` (text, lang), both as written tables.

    The first has (lang, phrase, k, n, compact) for phrases of k = 1 to WORDS words found `least` times or more; compact: all
    its occurrences go on with one same word. The second has (lang, n): all words.
    """
    documents = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rounds = 1
    words, total, hot, bits = word_totals(documents, least, fan_out)
    while total > bucket_words * fan_out**rounds:
        rounds += 1
    buckets = fan_out**rounds
    if rounds > 1:
        hot = word_totals(documents, least, buckets)[2]

    def cut(batches):
        for block in blocks(batches, np.unpackbits(bits).astype(bool)):
            edges = block.edges()
            places = buckets_of(edges, hot, buckets)[0]
            for digit, packed in dealt(edges, places // fan_out ** (rounds - 1)):
                yield table([(digit, packed)], ["bucket", "packed"], [pa.int64(), pa.binary()])

    def spread(level):
        def run(batches):
            held: dict[int, list[bytes]] = {}
            sizes: Counter = Counter()

            def out(bucket):
                del sizes[bucket]
                edges = Edges.merged(held.pop(bucket))
                for digit, packed in dealt(edges, buckets_of(edges, hot, buckets)[0] // fan_out ** (rounds - 1 - level)):
                    yield table([(digit, packed)], ["bucket", "packed"], [pa.int64(), pa.binary()])

            for batch in batches:
                for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                    held.setdefault(bucket, []).append(packed)
                    sizes[bucket] += len(packed)
                    if sizes.total() >= BLOCK:
                        yield from out(max(sizes, key=sizes.get))
            for bucket in list(held):
                yield from out(bucket)

        return run

    def count(group: pa.Table) -> pa.Table:
        edges = Edges.merged(group.column("packed").to_pylist())
        return flows(edges, buckets_of(edges, hot, buckets)[1], least)

    found = documents.mapInArrow(cut, PACKED)
    for level in range(1, rounds):
        found = found.repartition("bucket").mapInArrow(spread(level), PACKED)
    counted = written(
        found.groupBy("bucket").applyInArrow(count, "lang string, phrase string, k int, n long, compact boolean, partial boolean"),
        "flows",
    )
    whole = counted.where("not partial").select("lang", "phrase", "k", "n", "compact")
    parts = (
        counted.where("partial")
        .groupBy("lang", "phrase", "k")
        .agg(F.sum("n").alias("n"), F.lit(False).alias("compact"))
        .where(F.col("n") >= least)
    )
    return discarding((written(whole.union(parts), "phrases"), words), counted)


def flows(edges: Edges, depth: np.ndarray, least: int) -> pa.Table:
    """Phrases of a bucket and their counts: flows through nodes.

    Counts of phrases of fewer words than the bucket depends on are partial, and given whatever they are.
    """
    names = ["lang", "phrase", "k", "n", "compact", "partial"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
    split = [w.split(b"\t", 1) for w in edges.words]
    words = [w[-1] for w in split]
    out = []
    rows, weights = edges.rows, edges.weights
    lengths = (rows != 0).sum(axis=1)
    langs = {x[0]: bytes.fromhex(x[0].decode()).decode("utf-8", "surrogatepass") for x in split}
    # edges are in order of their words, so those that begin with one phrase stand together
    for k in range(1, WORDS + 1):
        has = np.flatnonzero(lengths >= k)
        if not len(has):
            break
        heads = rows[has, :k]
        first = np.flatnonzero(np.r_[True, (heads[1:] != heads[:-1]).any(axis=1)])
        last = np.r_[first[1:], len(has)] - 1
        n = np.add.reduceat(weights[has], first)
        partial = depth[has[first]] > k
        one_way = np.zeros(len(first), bool)
        if k < WORDS:
            one_way = (rows[has[first], k] == rows[has[last], k]) & (rows[has[first], k] != 0)
        for i in np.flatnonzero(partial | (n >= least)).tolist():
            numbers = heads[first[i]].tolist()
            phrase = b" ".join([words[x] for x in numbers]).decode("utf-8", "surrogatepass")
            out.append((langs[split[numbers[0]][0]], phrase, k, int(n[i]), bool(one_way[i] and not partial[i]), bool(partial[i])))
    return pa.Table.from_batches([table(out, names, kinds)])


def sums_by(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, weights)
    return found, sums


def collocations(documents: DataFrame, least: int = 30, held_percent: int = 80, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the `most` best phrases of 2 to WORDS words of each language.

    A candidate is found `least` times or more, and isn't held by a longer candidate that has `held_percent` of its count.
    The score is the least, over the cuts of the phrase in two, of floor(2000000 * a / (l + r)).
    """
    phrases, words = phrase_counts(documents, least)
    parts = F.split("phrase", " ", -1)

    def some(start, length):
        return F.array_join(F.slice(parts, start, length), " ")

    whole = "decimal(38,0)"
    # inner phrases of longer candidates, with the most that one of those has
    places = F.expr(f"filter(transform(sequence(0, {WORDS * WORDS - 1}), x -> struct(x div {WORDS} + 1 as s, x % {WORDS} as m)), x -> x.m >= 2 and x.m < k and x.s + x.m - 1 <= k)")
    inner = phrases.where("k > 2").select("lang", "n", F.explode(F.transform(places, lambda x: some(x["s"], x["m"]))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("held"))
    left = phrases.where((F.col("k") > 1) & ~(F.col("compact") & (F.col("k") < WORDS))).join(inner, ["lang", "phrase"], "left")
    left = left.where(F.col("held").isNull() | (F.col("held").cast(whole) * 100 < F.col("n").cast(whole) * held_percent))
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), parts.alias("w"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("cut") + 1, WORDS), " ").alias("tail"),
    )
    counts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(counts.withColumnsRenamed({"phrase": "head", "n": "l"}), ["lang", "head"])
    cuts = cuts.join(counts.withColumnsRenamed({"phrase": "tail", "n": "r"}), ["lang", "tail"])
    score = F.expr("(cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(F.broadcast(words), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
