"""Language identification by interpolated Kneser-Ney models over characters.

Spark counts the character 4-grams of every labelled training text: each task sums its batches, and the sums are added up
by language and gram. Lower orders follow from the 4-gram types (continuation counts). The fitted model holds, for
every gram that any language has seen, its log probability in all languages, in arrays sorted by a hash of the gram. A
text gets the language of the lowest cross-entropy per character.

Texts are lower-cased; what is no letter becomes one space a run; three marks stand before the first character.

The score is the share of the best language in a softmax over cross-entropies, sharpened by a factor fitted on about
`calibration_rows` training texts, dealt out by a hash of their ids. `accepted` is false where the cross-entropy is
beyond what 99.9 % of those texts have, or the score below `min_score`. Up to `max_grams` 4-grams are fitted in the
driver and broadcast. More stay in Spark: the same model as tables (`GramTables`), joined with the texts' distinct grams.

Defined cases: a text that is null or without letters gets `und`, score 0 and is not accepted; without training rows all
texts do; of languages with equal cross-entropy the first in sorted order is given; repeated rows count each; an empty
table gives no rows; columns lang_pred, score, cross_entropy and accepted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.shared import with_python_columns, written

ORDER = 4
ADDED = "lang_pred string, score double, cross_entropy double, accepted boolean"
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MARK, SPACE, ASTRAL = 1, 32, 0xFFFF


@cache
def letter_table() -> np.ndarray:
    """The symbol of each code point: itself for letters, one symbol for letters beyond 16 bits, else a space."""
    table = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = min(c, ASTRAL)
    return table


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 4-grams that end at each character of each text, and how many each text has."""
    table = letter_table()
    parts, sizes = [], []
    for t in texts:
        codes = table[np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = codes != SPACE
        if letter.any():
            codes = codes[letter | np.append(False, letter[:-1])]
        else:
            codes = codes[:0]
        parts += [np.full(ORDER - 1, MARK, np.uint16), codes]
        sizes.append(len(codes))
    joined = np.concatenate([*parts, np.zeros(0, np.uint16)]).astype(np.uint64)
    if len(joined) < ORDER:
        return np.zeros(0, np.uint64), np.array(sizes, np.int64)
    n = len(joined) - ORDER + 1
    keys = joined[:n]
    for k in range(1, ORDER):
        keys = (keys << np.uint64(16)) | joined[k : n + k]
    return keys[joined[ORDER - 1 :] != MARK], np.array(sizes, np.int64)


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, gram long, n long) over all rows of `training` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for lang in sorted(set(langs)):
                mine = [t for x, t in zip(langs, texts) if x == lang]
                grams, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for i in range(0, len(mine), 500):
                    g, c = np.unique(symbols(mine[i : i + 500])[0], return_counts=True)
                    both, where = np.unique(np.append(grams, g), return_inverse=True)
                    grams, counts = both, np.bincount(where, np.append(counts, c)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"],
                )

    counted = training.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashArray:
    """Row numbers of keys, in an array sorted by hash; the leading bits of a hash give where to look."""

    def __init__(self, keys: np.ndarray):
        hashes = keys * SPREAD
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0))
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(hashes[self.order] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.longest = int(np.diff(self.start).max(initial=0))
        self.order = np.append(self.order, -1)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        hashes = keys * SPREAD
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((at < end) & (self.hashes[at] == hashes), self.order[at], -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        for step in range(1, self.longest):
            if not len(left):
                break
            place = at[left] + step
            hit = self.hashes[place] == hashes[left]
            out[left[hit]] = self.order[place[hit]]
            left = left[~hit & (place + 1 < end[left])]
        return out


@dataclass
class Level:
    """Of one order: grams and their log probabilities, contexts and their log back-off weights, by language."""

    grams: HashArray
    log_p: np.ndarray
    contexts: HashArray
    log_back: np.ndarray


class KneserNey:
    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        """From the counts of 4-grams: index of the language, key, count."""
        self.langs, self.levels = langs, []
        tables = []
        key, owner, count = gram, lang, n.astype(np.float64)
        for order in range(ORDER, 0, -1):
            tables.append((key, owner, count))
            shorter = key & np.uint64((1 << 16 * (order - 1)) - 1)
            pairs = np.stack([owner.astype(np.uint64), shorter])
            (owner, key), count = np.unique(pairs, axis=1, return_counts=True)
            owner, count = owner.astype(np.int64), count.astype(np.float64)
        size = len(langs)
        seen = max(1, len(np.unique(tables[-1][0])))
        lower = np.full((1, size), 1 / (seen + 1))
        for order, (key, owner, count) in enumerate(reversed(tables), 1):
            grams, g = np.unique(key, return_inverse=True)
            contexts, c = np.unique(key >> np.uint64(16), return_inverse=True)
            c_of = np.searchsorted(contexts, grams >> np.uint64(16))
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, (c, owner), count)
            np.add.at(kinds, (c, owner), 1)
            cut = np.empty(size)
            for x in range(size):
                ones, twos = (float(((count == k) & (owner == x)).sum()) for k in (1, 2))
                cut[x] = ones / (ones + 2 * twos) if ones and twos else 0.5
            with np.errstate(divide="ignore", invalid="ignore"):
                back = np.where(total > 0, cut * kinds / total, 1.0)
            p = np.zeros((len(grams), size))
            p[g, owner] = np.maximum(count - cut[owner], 0) / total[c, owner]
            if order > 1:
                below = self.levels[-1]
                row = below.grams.rows(grams & np.uint64((1 << 16 * (order - 1)) - 1))
                lower = np.exp(below.log_p[row])
            p += back[c_of] * lower
            self.levels.append(
                Level(HashArray(grams), np.log(p).astype(np.float32), HashArray(contexts), np.log(back).astype(np.float32))
            )
        self.floor = np.float32(np.log(1 / (seen + 1)))

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row per key: log probability of its last character after those before, in each language."""
        if not order:
            return np.full((len(keys), len(self.langs)), self.floor)
        level = self.levels[order - 1]
        rows = level.grams.rows(keys)
        out = level.log_p[rows]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            few = keys[missing]
            context = level.contexts.rows(few >> np.uint64(16))
            back = np.where((context >= 0)[:, None], level.log_back[context], np.float32(0))
            shorter = few & np.uint64((1 << 16 * (order - 1)) - 1)
            out[missing] = back + self.log_probabilities(shorter, order - 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by text and language, characters of each text)."""
        keys, sizes = symbols(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if len(keys):
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            total[some] = -np.add.reduceat(self.log_probabilities(keys), starts, axis=0, dtype=np.float64)
        return total / np.maximum(sizes, 1)[:, None], sizes


class GramTables:
    """The model of KneserNey, kept in Spark whatever its size.

    At each order p(gram) = direct(gram) + back(context) p(suffix), by language; direct is 0 and back 1 where a language
    hasn't seen them.
    """

    def __init__(self, counted: DataFrame, langs: list[str]):
        """From `counted` (lang, gram, n), the counts of all 4-grams."""
        self.langs, self.levels = langs, {}
        table = counted
        for order in range(ORDER, 0, -1):
            found = {r["lang"]: r for r in table.groupBy("lang").agg(*(F.count_if(F.col("n") == k).alias(f"of_{k}") for k in (1, 2))).collect()}
            cuts = []
            for x in langs:
                ones, twos = found[x]["of_1"], found[x]["of_2"]
                cuts.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
            cut = F.element_at(F.create_map(*(F.lit(e) for pair in zip(langs, cuts) for e in pair)), F.col("lang"))
            table = table.withColumn("context", F.shiftrightunsigned("gram", 16))
            sums = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
            direct = table.join(sums, ["lang", "context"]).withColumn("value", F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("total"))
            back = sums.withColumn("value", cut * F.col("kinds") / F.col("total"))
            self.levels[order] = (
                written(self.by_language(direct, "gram", 0.0, "direct"), f"grams-{order}"),
                written(self.by_language(back, "context", 1.0, "back"), f"contexts-{order}"),
            )
            if order > 1:
                table = table.groupBy("lang", self.suffix(order - 1).alias("gram")).agg(F.count("*").alias("n"))
                table = written(table, f"counts-{order - 1}")
        self.seen = max(1, self.levels[1][0].count())

    @staticmethod
    def suffix(order: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))

    def by_language(self, values: DataFrame, key: str, default: float, name: str) -> DataFrame:
        """(key, array of `value` in the order of the languages)."""
        grouped = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("of"))
        each = F.transform(F.array(*(F.lit(x) for x in self.langs)), lambda x: F.coalesce(F.col("of")[x], F.lit(default)))
        return grouped.select(key, each.alias(name))

    def probabilities(self, grams: DataFrame, order: int = ORDER) -> DataFrame:
        """(gram, p array) of distinct `grams` of that order."""
        if not order:
            return grams.withColumn("p", F.array(*[F.lit(1 / (self.seen + 1))] * len(self.langs)))
        below = self.probabilities(grams.select(self.suffix(order - 1).alias("gram")).distinct(), order - 1)
        direct, back = self.levels[order]
        wide = (
            grams.withColumns({"suffix": self.suffix(order - 1), "context": F.shiftrightunsigned("gram", 16)})
            .join(below.withColumnRenamed("gram", "suffix"), "suffix")
            .join(direct, "gram", "left")
            .join(back, "context", "left")
        )
        lower = F.when(F.col("back").isNull(), F.col("p")).otherwise(F.zip_with("back", "p", lambda b, p: b * p))
        both = F.when(F.col("direct").isNull(), lower).otherwise(F.zip_with("direct", lower, lambda d, p: d + p))
        return wide.select("gram", both.alias("p"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(key, entropy array, size) for each key of `texts` (key, text) whose text has letters.

        Rows with one key have one text: their sums and sizes grow alike, so the quotient stays.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                    grams, counts = np.unique(symbols([text])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(grams), pa.binary()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))],
                        ["key", "gram", "n"],
                    )

        counted = written(texts.mapInArrow(run, "key binary, gram long, n long"), "text-grams")
        p = written(self.probabilities(counted.select("gram").distinct()), "probabilities")
        sums = [(-F.sum(F.col("n") * F.log(F.col("p")[i])) / F.sum("n")) for i in range(len(self.langs))]
        return counted.join(p, "gram").groupBy("key").agg(F.array(*sums).alias("entropy"), F.sum("n").alias("size"))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


@dataclass
class Identifier:
    model: KneserNey | GramTables | None
    sharpness: float
    most: float
    min_score: float

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        if self.model is None:
            return [("und", 0.0, None, False)] * len(texts)
        return self.decide(*self.model.entropies(texts))

    def decide(self, entropy: np.ndarray, sizes: np.ndarray) -> list[tuple[str, float, float | None, bool]]:
        best = entropy.argmin(axis=1)
        score = shares(entropy, self.sharpness)[np.arange(len(sizes)), best]
        out = []
        for i, b in enumerate(best):
            if not sizes[i]:
                out.append(("und", 0.0, None, False))
                continue
            e, s = float(entropy[i, b]), float(score[i])
            out.append((self.model.langs[b], s, e, e <= self.most and s >= self.min_score))
        return out


def shares(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    z = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def least_count(counted: DataFrame, most: int) -> int:
    """The smallest power of two such that at most `most` grams occur so often; 1 if there are no more in all."""
    by_size = counted.groupBy((F.length(F.bin("n")) - 1).alias("size")).count().collect()
    total, least = 0, 1
    for r in sorted(by_size, key=lambda r: -r["size"]):
        total += r["count"]
        if total > most:
            return 2 ** (r["size"] + 1)
    return least


def fit(
    training: DataFrame, calibration_rows: int = 1000, max_grams: int = 1_000_000, min_score: float = 0.5
) -> Identifier:
    """`training` has text, lang and an id `doc_id` that deals out the calibration rows."""
    known = training.where("lang is not null and text is not null")
    counted = written(count_grams(known), "grams")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return Identifier(None, 1.0, 0.0, min_score)
    place = {x: i for i, x in enumerate(langs)}
    if least_count(counted, max_grams) > 1:
        model = GramTables(counted, langs)
    else:
        got = counted.toArrow()
        model = KneserNey(
            langs,
            np.array([place[x] for x in got.column("lang").to_pylist()], np.int64),
            got.column("gram").to_numpy().astype(np.int64).view(np.uint64),
            got.column("n").to_numpy(),
        )
    share = min(1.0, calibration_rows / max(1, known.count()))
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = known.where(dealt).select("text", "lang")
    if isinstance(model, GramTables):
        keyed = written(with_key(sample), "calibration")
        sample = keyed.join(model.entropies(keyed.select("key", "text")), "key").select("lang", "entropy", "size").collect()
        entropy = np.array([r.entropy for r in sample], np.float64).reshape(-1, len(langs))
        sizes = np.array([r["size"] for r in sample], np.int64)
    else:
        sample = [r for r in sample.collect() if r.lang in place]
        entropy, sizes = model.entropies([r.text for r in sample])
    truth = np.array([place[r.lang] for r in sample], np.int64)
    entropy, truth = entropy[sizes > 0], truth[sizes > 0]
    if not len(truth):
        return Identifier(model, 1.0, float("inf"), min_score)
    own = entropy[np.arange(len(truth)), truth]

    def loss(sharpness: float) -> float:
        p = shares(entropy, sharpness)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(p, 1e-9)).mean())

    sharpness = min((2.0**k for k in range(6)), key=loss)
    return Identifier(model, sharpness, float(np.quantile(own, 0.999) + own.std()), min_score)


def identify(documents: DataFrame, identifier: Identifier) -> DataFrame:
    """`documents` with lang_pred, score, cross_entropy and accepted, from `text` alone."""
    if isinstance(identifier.model, GramTables):
        return identify_by_tables(documents, identifier)
    shared = documents.sparkSession.sparkContext.broadcast(identifier)

    def make():
        predict = shared.value.predict

        def run(part):
            texts, found, first, size = part.column("text").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > 500_000 or i + 1 == len(texts):
                    found += predict(texts[first : i + 1])
                    first, size = i + 1, 0
            return [list(column) for column in zip(*found)]

        return run

    return with_python_columns(documents, make, ADDED, rows=1024)


def identify_by_tables(documents: DataFrame, identifier: Identifier) -> DataFrame:
    """identify() by joins, for a model that stays in Spark."""
    alone = replace(identifier, model=SimpleNamespace(langs=identifier.model.langs))
    kept = documents.drop("lang_pred", "score", "cross_entropy", "accepted")

    def make():
        def run(part):
            entropy = np.array(part.column("entropy").to_pylist(), np.float64)
            return [list(column) for column in zip(*alone.decide(entropy, part.column("size").to_numpy()))]

        return run

    found = with_python_columns(identifier.model.entropies(with_key(kept).select("key", "text")), make, ADDED, rows=1024)
    found = written(found.drop("entropy", "size").withColumnRenamed("key", "_key"), "found")
    keyed = with_key(kept.select("text", F.struct(*kept.columns).alias("row"))).select("row", "key")
    return keyed.join(found, F.col("key") == F.col("_key"), "left").select(
        "row.*",
        F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "cross_entropy",
        F.coalesce("accepted", F.lit(False)).alias("accepted"),
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
