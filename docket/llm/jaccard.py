"""Exact Jaccard join on word shingles, by pivots, Voronoi regions, triangle-inequality windows and recursion.

Jaccard distance is a metric, but documents without common shingles are all at distance 1, where pivots tell nothing.
The space is therefore first cut by elements: all are put in one order, rare ones first, and a document belongs to the
regions of its leading n - ceil(t n) + 1 elements of n. Two linked documents share one of these, and are looked for in the
region of the first, where their places leave enough elements to share. Nearly all documents share none with any other,
or too late, and are done.

Each round takes the regions that still hold several components. In all but small ones, pivots are chosen and the exact
distances of all documents to them measured; links join components, so a group of thousands of near copies is one
component after that, and its pairs are never listed. Large regions then fall into the Voronoi regions of their pivots,
to which boundary documents are replicated by triangle-inequality windows (`regions_within`), and the next round does the
same in these. Small regions list their pairs across components, less those that a window excludes: |d(x, p) - d(y, p)|
beyond the threshold's distance, p a pivot. Neither lists pairs whose sketches differ more than linked sets can
(`differ_too_much`): passages that texts share by chance make pairs that grow with the square of the texts. Each round takes its pivots out of their region, so the recursion ends; no
limit is set.

Documents with equal sets are one class from the start; sets are taken as equal by 128-bit hashes. Elements are 64-bit
hashes of shingles whose leading bits are replaced by the rank of their frequency bucket, which makes the number also the
order. Buckets (131,072, whatever the input) count all documents' shingles.

Defined cases: words are runs of other characters than blanks (space, U+0009 to U+000D), A-Z in lower case; a text of
fewer words than a shingle is one element; a null text or one without words has an empty set and links with nothing;
equal sets are linked; a row with a null doc_id is compared with nothing and has a null component; rows with one doc_id
and different texts are documents of their own; very long texts are compared whole, their sets standing in one row of
8 bytes an element; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.llm.shared import BROADCAST_BYTES, components, discarding, small, with_python_columns, written

BUCKET_BITS = 17
#: Regions of more classes than this get a pivot, those of more than LISTED so many, whose Voronoi regions they fall
#: into. What is left of up to LISTED classes lists its pairs after that: with 16 in its place, 0.51 GB took 2.46 GB of disk.
SMALL_REGION = 3
PIVOTS = 8
STUCK_PIVOTS = 32
LISTED = 512
#: A sketch is the parity of how many elements end in each of so many bits, in words of 64.
SKETCH = [f"sketch_{k}" for k in range(8)]
REST = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as far as the longest slice so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            steps = np.ones(size, np.uint64)
            steps[1:] = np.uint64(BASE)
            cls.up = np.cumprod(steps)
            steps[1:] = np.uint64(pow(BASE, -1, 1 << 64))
            cls.down = np.cumprod(steps)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, in order, and the index of each text's first word (and one past the last)."""
    sizes = np.array([len(e) + 1 for e in texts], np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.flatnonzero(~IS_BLANK[data])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    edge = np.flatnonzero(np.diff(inside) > 1)
    begin = inside[np.concatenate([[0], edge + 1])]
    end = inside[np.append(edge, len(inside) - 1)] + 1
    Powers.to(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte_values()[data] * Powers.up[: len(data)])])
    return mixed((sums[end] - sums[begin]) * Powers.down[begin]), np.searchsorted(begin, bounds)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    word, first = word_hashes([(t or "").encode("utf-8", "replace").lower() for t in texts])
    factors = mixed(np.arange(1001, 1001 + words, dtype=np.uint64))
    n = max(0, len(word) - words + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(words):
        joined += word[k : k + n] * factors[k]
    joined = mixed(joined)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            few = (word[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([few])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(texts: list[str | None], most: int = 300_000) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > most or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def bucket_counts(documents: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall in each bucket: one sum per task and bucket, then one per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                found = np.concatenate(shingle_sets(texts[i:j], words))
                counts += np.bincount((found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    total = documents.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = total.toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def rank_buckets(counts: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def ordered(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set's elements, rare buckets first; as signed numbers that sort alike."""
    top = np.uint64(64 - BUCKET_BITS)
    elements = (ranks[(shingles >> top).astype(np.int64)] << top) | (shingles & REST)
    return (np.sort(elements) ^ np.uint64(1 << 63)).view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def sketches(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns SKETCH of the sets."""
    bits = 64 * len(SKETCH)
    odd = [np.bincount(s & (bits - 1), minlength=bits) & 1 for s in sets]
    packed = np.packbits(np.array(odd, np.uint8).reshape(len(sets), bits), axis=1).view(np.int64)
    return [pa.array(packed[:, k]) for k in range(len(SKETCH))]


def differ_too_much(n: Column, m: Column, one: list[Column], other: list[Column], percent: int) -> Column:
    """Whether sets of n and m elements can't be linked, as their sketches `one` and `other` differ.

    An element that only one of them holds changes one bit, so no more bits differ than there are such elements. Linked
    sets have (n + m) (1 - t) / (1 + t) of these at most.
    """
    bits = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(one, other)), F.lit(0))
    return (100 + percent) * bits > (100 - percent) * (n + m)


def describe(documents: DataFrame, words: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(doc_id, n, class, keys, SKETCH): set size, a hash of the set (null if empty), the elements whose regions it goes to."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                sets = [ordered(s, shared.value) for s in shingle_sets(texts[i:j], words)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([class_of(s) for s in sets], pa.binary()),
                        lists([s[: prefix_size(len(s), percent)] for s in sets]),
                        *sketches(sets),
                    ],
                    ["doc_id", "n", "class", "keys", *SKETCH],
                )

    plain = documents.select(F.col("doc_id").cast("long"), "text")
    marks = "".join(f", {c} long" for c in SKETCH)
    return plain.mapInArrow(run, "doc_id long, n long, class binary, keys array<long>" + marks)


def full_sets(documents: DataFrame, words: int, ranks: np.ndarray) -> DataFrame:
    """(id, elements) of `documents` (id, class, text); rows whose text is not of that class are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, classes = (b.column(c).to_pylist() for c in ("text", "id", "class"))
            for i, j in slices(texts):
                sets = [ordered(s, shared.value) for s in shingle_sets(texts[i:j], words)]
                right = [(k, s) for k, c, s in zip(ids[i:j], classes[i:j], sets) if class_of(s) == c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in right], pa.int64()), lists([s for _, s in right])], ["id", "elements"]
                )

    return documents.select("id", "class", "text").mapInArrow(run, "id long, elements array<long>")


def class_of(elements: np.ndarray) -> bytes | None:
    """128 bits that stand for the set."""
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None


def distinct_classes(described: DataFrame) -> DataFrame:
    """A row per set: (id, class, doc_id, n, keys, SKETCH, again): a number, its smallest doc_id, whether several rows have it."""
    whole = described.where("class is not null and doc_id is not null")
    counted = whole.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    repeated = written(counted.where("copies > 1").select("class", "first"), "repeated")
    single = whole.join(small(repeated), "class", "left_anti").withColumn("again", F.lit(False))
    heads = whole.join(small(repeated), "class").where("doc_id = first").dropDuplicates(["class"])
    both = single.unionByName(heads.drop("first").withColumn("again", F.lit(True)))
    return written(both.withColumn("id", F.monotonically_increasing_id()), "classes")


class Verifier:
    """Exact distances of pairs of classes, by their whole sets, which are made from the texts again, where needed."""

    def __init__(self, documents: DataFrame, classes: DataFrame, words: int, percent: int, ranks: np.ndarray):
        self.documents, self.classes, self.words, self.percent, self.ranks = documents, classes, words, percent, ranks
        self.sets: DataFrame | None = None
        self.parts: list[DataFrame] = []

    def close(self, pairs: DataFrame) -> DataFrame:
        """The `pairs` (a, b) whose leading elements leave room for a link.

        Linked sets of n and m elements share at least o = ceil(t (n + m) / (1 + t)). Of their shared elements, the
        first o + 1 - ceil(t max(n, m)) are among the leading ones of both.
        """
        pairs = written(pairs, "pairs")
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        heads = written(self.classes.join(small(ids), "id").select("id", "n", "keys"), "heads")
        n, m = F.col("n_a"), F.col("n_b")
        overlap = F.ceil(self.percent * (n + m) / (100 + self.percent) - 1e-9)
        need = overlap + 1 - F.ceil(self.percent * F.greatest(n, m) / 100 - 1e-9)
        share = 1 - self.percent / 100
        both = self.joined(pairs, heads, ["n", "keys"], share)
        both = both.where(100 * F.least(n, m) >= self.percent * F.greatest(n, m))
        both = both.where(F.size(F.array_intersect("keys_a", "keys_b")) >= need)
        return discarding(written(both.select("a", "b"), "close"), pairs, ids, heads)

    def load(self, ids: DataFrame) -> None:
        """Makes the sets of those of the classes `ids` (id) that aren't there yet."""
        held = self.sets
        if held is not None:
            ids = ids.join(held.select("id"), "id", "left_anti")
        ids = written(ids, "ids")
        holders = written(self.classes.join(small(ids), "id", "left_semi").select("id", "class", "doc_id"), "holders")
        if not holders.isEmpty():
            texts = self.documents.select(F.col("doc_id").cast("long"), "text").join(small(holders), "doc_id")
            sets = written(full_sets(texts, self.words, self.ranks), "sets")
            if sets.count() > holders.count():  # rows that occur twice, with one id and text
                sets = discarding(written(sets.dropDuplicates(["id"]), "sets"), sets)
            self.parts.append(sets)
            self.sets = sets if held is None else held.unionByName(sets)
        discarding(None, ids, holders)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """`pairs` (a, b) with common (elements), distance and linked."""
        if self.sets is None:  # no pairs at all
            schema = "a long, b long, common long, distance double, linked boolean"
            return written(pairs.sparkSession.createDataFrame([], schema), "distances")
        common = F.size(F.array_intersect("elements_a", "elements_b")).cast("long")
        either = (F.size("elements_a") + F.size("elements_b")).cast("long") - F.col("common")
        counted = self.joined(pairs, self.sets, ["elements"]).withColumn("common", common).withColumn("either", either)
        exact = counted.select(
            "a",
            "b",
            "common",
            (1 - F.col("common") / F.col("either")).alias("distance"),
            (100 * F.col("common") >= self.percent * F.col("either")).alias("linked"),
        )
        return written(exact, "distances")

    def beyond(self, rows: DataFrame) -> DataFrame:
        """`rows` (id, pivot, after, room, ...) with element: the first `room` elements of id's set after `after` that the pivot's lacks."""
        sets = self.joined(rows.withColumnsRenamed({"id": "a", "pivot": "b"}), self.sets, ["elements"])
        later = F.filter("elements_a", lambda e: e > F.col("after"))
        leading = F.slice(F.array_except(later, F.col("elements_b")), F.lit(1), F.col("room").cast("int"))
        kept = [F.col(c) for c in rows.columns if c not in ("id", "pivot")]
        return sets.select(F.col("a").alias("id"), F.col("b").alias("pivot"), *kept, F.explode(leading).alias("element"))

    def joined(self, pairs: DataFrame, table: DataFrame, columns: list[str], share: float = 1.0) -> DataFrame:
        """`pairs` with the columns of `table` (id, ...), a `share` of the sets' elements, for both, as name_a and name_b.

        Sets are many times as wide as pairs, so `pairs`, which must be written, go to the sets of `a` if they are small. The
        sets of `b` are broadcast if their elements, of 8 bytes, take BROADCAST_BYTES or less.
        """
        few = written(pairs.select(F.col("b").alias("id")).distinct(), "partners")
        held = self.classes.join(small(few), "id", "left_semi").agg(F.sum("n")).first()[0] or 0
        for side in ("a", "b"):
            own = table.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
            if side == "b" and 8 * share * held <= BROADCAST_BYTES:
                own = F.broadcast(own.join(F.broadcast(few.withColumnRenamed("id", "b")), "b", "left_semi"))
            pairs = own.join(small(pairs), side) if side == "a" else pairs.join(own, side)
        return pairs


def partner_size(shared: Column, percent: int) -> Column:
    """The size m of the largest set that a set of n elements can link with, if they have no more than `shared` elements in common.

    Linked sets have t (n + m) / (1 + t) in common at least.
    """
    return F.floor(shared * (100 + percent) / percent - F.col("n") + 1e-6)


def unsettled(live: DataFrame) -> DataFrame:
    """(region, size, tested) of the regions of `live` that hold several components; of those with the same classes, one.

    Regions are compared by two sums (exclusive or) of 64-bit hashes of their classes. Of equal ones the first by element
    stays: all its classes hold that element, so no pair has its first common element in another.
    """
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    found = live.groupBy("region").agg(
        F.count("*").alias("size"),
        F.bool_and("tested").alias("tested"),
        F.min("after").alias("after"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        *marks,
    )
    found = found.where("low <> high").groupBy("size", "mark_1", "mark_2")
    return written(found.agg(F.min_by("region", "after").alias("region"), F.bool_or("tested").alias("tested")), "regions")


def possible(n: Column, place: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of n and m elements may link whose first common element stands at `place` and `other`, from 0."""
    common = F.least(n - place, m - other)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * common >= percent * (n + m))


def listed(few: DataFrame, percent: int, reach: float) -> DataFrame:
    """(a, b): pairs across components within small regions, less those that sizes, sketches or the triangle inequality exclude."""
    x, y = few.alias("x"), few.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    window = F.coalesce(F.abs(F.col("x.far") - F.col("y.far")) <= reach, F.lit(True))
    sizes = possible(n, F.col("x.place"), m, F.col("y.place"), percent)
    across = (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))
    one, other = ([F.col(f"{side}.{c}") for c in SKETCH] for side in "xy")
    alike = ~differ_too_much(n, m, one, other, percent)
    pairs = x.join(y, (F.col("x.region") == F.col("y.region")) & across & sizes & window & alike)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The `pairs` (a, b) that their `marks` (id, n, SKETCH) don't exclude.

    Marks are wider than pairs and needed in every round: broadcasts of them would pile up in the executors' memory.
    """
    for side in ("a", "b"):
        own = marks.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *SKETCH)))
        pairs = pairs.join(own, side)
    one, other = ([F.col(f"{c}_{side}") for c in SKETCH] for side in "ab")
    return pairs.where(~differ_too_much(F.col("n_a"), F.col("n_b"), one, other, percent)).select("a", "b")


def with_pivots(many: DataFrame, percent: int) -> DataFrame:
    """A row for each class and pivot of its region; pivots: the most central class, in large regions others by hash too.

    These are of any component alike; every other one is of the smallest sets. Stuck regions get about STUCK_PIVOTS more.
    """
    lows = [F.lit(0).cast("long"), F.shiftleft("n", 32)]
    row = F.struct("id", "n", "place")
    others = [F.min_by(row, F.shiftrightunsigned(F.xxhash64("root", F.lit(k)), 33) + lows[k % 2]) for k in range(1, PIVOTS)]
    central = F.min_by(row, F.col("rank") + F.shiftrightunsigned(F.xxhash64("id"), 33) * 1e-16)
    further = F.col("stuck") & (F.pmod(F.xxhash64("id", "size"), F.col("size")) < STUCK_PIVOTS)
    further = F.collect_list(F.when(further, row))
    all_of = F.array_distinct(F.concat(F.array(central, *others), further))
    chosen = many.groupBy("region").agg(F.when(F.max("size") <= LISTED, F.array(central)).otherwise(all_of).alias("pivots"))
    rows = many.join(small(written(chosen, "pivots")), "region")
    ids = F.transform("pivots", lambda p: p["id"])
    rows = rows.withColumns({"is_pivot": F.array_contains(ids, F.col("id")), "central": F.get("pivots", F.lit(0))["id"]})
    rows = rows.withColumn("of", F.explode("pivots")).withColumn("pivot", F.col("of.id"))
    maybe = possible(F.col("n"), F.col("place"), F.col("of.n"), F.col("of.place"), percent)
    return written(rows.withColumn("maybe", maybe).drop("of").drop("pivots", "root", "far", "tested", "stuck"), "stars")


def regions_within(
    stars: DataFrame, distances: DataFrame, roots: DataFrame | None, verifier: Verifier, reach: float
) -> DataFrame:
    """What is left of the regions of `stars` (as of with_pivots()): (region, after, id, n, place, rank, far, stuck, tested).

    Pivots are done, as they were tested against all. Regions of up to LISTED classes stay as they are, for their pairs to
    be listed. Larger ones fall into Voronoi regions, with `reach` the distance of linked classes:

    A class is at home with its nearest pivot if that is within 2 `reach`, otherwise in the outer region. By the triangle
    inequality, a partner of a class at home with pivot q is within the region's radius and `reach` of q, and at most
    2 `reach` further from q than from its own nearest pivot: classes within this window are replicated to the region.
    A partner of a class at home in the outer region is more than `reach` from all pivots: these are replicated to that.

    Where all are about equally far from all pivots, the windows hold nearly everything: more than half of the pairs. Such
    a region is parted by its medoid among the pivots instead (`parted`).
    """
    known = distances.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "distance", "common")
    carried = ["after", "id", "n", "place", "rank", F.col("distance").alias("far")]
    rest = stars.where(~F.col("is_pivot")).drop("is_pivot")
    listed_next = rest.where((F.col("size") <= LISTED) & (F.col("pivot") == F.col("central")))
    listed_next = listed_next.join(known, ["id", "pivot"], "left").select(
        "region", *carried, F.lit(False).alias("stuck"), F.lit(True).alias("tested")
    )
    large = rest.where(F.col("size") > LISTED).join(known, ["id", "pivot"])
    large = written(large.withColumn("nearest", F.min("distance").over(Window.partitionBy("region", "id"))), "placed")
    if large.isEmpty():
        return discarding(written(listed_next, "within"), large)
    medoid = large.groupBy("region", "pivot").agg(F.sum("distance").alias("total")).groupBy("region")
    medoid = written(medoid.agg(F.min_by("pivot", "total").alias("pivot")), "medoids")
    rows = written(large.join(small(medoid), ["region", "pivot"], "left_semi"), "rows")
    at_home = (F.col("distance") == F.col("nearest")) & (F.col("nearest") <= 2 * reach)
    radius = large.where(at_home).groupBy("region", "pivot").agg(F.max("distance").alias("radius"))
    radius = written(radius, "radius")
    window = F.least(F.col("nearest") + 2 * reach, F.col("radius") + reach)
    inner = large.join(small(radius), ["region", "pivot"]).where(F.col("distance") <= window).drop("radius")
    outer = rows.where(F.col("nearest") > reach)
    cells = inner.withColumn("cell", F.xxhash64("region", "pivot")).unionByName(
        outer.withColumn("cell", F.xxhash64("region", F.lit("outer")))
    )
    held = cells.groupBy("region", "size", "cell").agg(F.count("*").cast("double").alias("held"))
    work = held.groupBy("region", "size").agg(F.sum(F.col("held") * F.col("held")).alias("pairs"))
    apart = written(work.where(F.col("pairs") <= F.col("size") * F.col("size") / 2).select("region"), "apart")
    voronoi = cells.join(small(apart), "region", "left_semi").select(F.col("cell").alias("region"), *carried)
    whole = written(with_roots(rows.join(small(apart), "region", "left_anti"), roots), "whole")
    within = voronoi.withColumn("stuck", F.lit(False)).unionByName(parted(whole, verifier, carried))
    within = within.withColumn("tested", F.lit(False)).unionByName(listed_next)
    return discarding(written(within, "within"), large, medoid, rows, radius, apart, whole)


def parted(whole: DataFrame, verifier: Verifier, carried: list) -> DataFrame:
    """Regions cut by their medoid p (`pivot`), for the pairs whose first common element is `after`, which p holds too.

    Pairs with a common element outside p: both have one of these among the n - ceil(t n) + 1 - place next of their
    elements outside p, and meet in the region of that. The others are linked only if both share with p as much as linked
    sets of their sizes n, m share, t (n + m) / (1 + t) elements: m is at most common (1 + t) / t - n (`most`). These meet
    in the region of the smaller size, to which a class goes if classes of that size, of another component, may link
    with it.

    A region whose outside elements are so common that this leaves more than half of its pairs stays as it is, `stuck`. It
    gets STUCK_PIVOTS pivots a round from then on, each of which is tested against all and then done.
    """
    t = verifier.percent / 100
    room = F.col("n") - F.ceil(verifier.percent * F.col("n") / 100 - 1e-9) + 1 - F.col("place")
    outside = whole.select("region", "size", "root", *carried[:-1], "pivot", "distance", room.alias("room"))
    outside = verifier.beyond(outside).withColumn("cell", F.xxhash64("region", "element")).drop("element", "room", "pivot")
    outside = written(outside, "outside")
    held = outside.groupBy("region", "size", "cell").agg(
        F.count("*").cast("double").alias("held"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    work = held.where("low <> high").groupBy("region", "size").agg(F.sum(F.col("held") * F.col("held")).alias("pairs"))
    stuck = written(work.where(F.col("pairs") > F.col("size") * F.col("size") / 2).select("region"), "stuck")
    left = whole.join(small(stuck), "region", "left_semi").select("region", *carried, F.lit(True).alias("stuck"))
    outside = outside.join(small(stuck), "region", "left_anti").select(F.col("cell").alias("region"), *carried)
    most = partner_size(F.least(F.col("common"), F.col("n") - F.col("place")), verifier.percent)
    sized = whole.join(small(stuck), "region", "left_anti").withColumn("most", most)
    smaller = sized.where("most >= n").groupBy("region", F.col("n").alias("m")).agg(
        F.max("most").alias("top"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    smaller = written(smaller, "sizes")
    fits = (F.col("m") <= F.col("most")) & (F.col("top") >= F.col("n")) & (F.col("m") >= t * F.col("n") - 1e-6)
    others = (F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))
    larger = sized.join(small(smaller), "region").where((F.col("m") < F.col("n")) & fits & others)
    own = sized.where("most >= n").withColumn("m", F.col("n"))
    inside = own.select("m", "region", *carried, "distance").unionByName(larger.select("m", "region", *carried, "distance"))
    inside = inside.select(F.xxhash64("region", F.lit("inside"), "m").alias("region"), *carried)
    return outside.unionByName(inside).withColumn("stuck", F.lit(False)).unionByName(left)


def with_roots(live: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return live.withColumn("root", F.col("id"))
    return live.join(small(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """`roots` (id, root) with new `links` (a, b) between classes: components of the components that they join."""
    if roots is None:
        return written(components(links), "roots")
    for side in ("a", "b"):
        own = roots.select(F.col("id").alias(side), F.col("root").alias("_root"))
        links = links.join(small(own), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
    joined = written(components(links), "joined")
    further = joined.select(F.col("id").alias("root"), F.col("root").alias("_to"))
    moved = roots.join(small(further), "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    fresh = joined.join(small(roots), "id", "left_anti").select("id", "root")
    return discarding(written(moved.unionByName(fresh).distinct(), "roots"), joined)


def class_links(verifier: Verifier) -> DataFrame | None:
    """Component roots (id, root) of classes that link with others; None if there are none."""
    percent = verifier.percent
    reach = 1 - percent / 100 + 1e-9
    rows = verifier.classes.select("id", "n", F.posexplode("keys").alias("place", "region"))
    rows = rows.withColumn("most", partner_size(F.col("n") - F.col("place"), percent))
    shared = rows.groupBy("region").agg(F.count("*").alias("classes"), F.min(F.when(F.col("most") >= F.col("n"), F.col("n"))).alias("least"))
    shared = written(shared.where("classes > 1 and least is not null").select("region", "least"), "shared")
    fresh = {"after": F.col("region"), "far": F.lit(None).cast("double"), "stuck": F.lit(False), "tested": F.lit(False)}
    live = rows.join(small(shared), "region").where("most >= least").withColumns(fresh)
    live = discarding(written(live.select("region", "after", "id", "n", "place", "far", "stuck", "tested"), "live"), shared)
    held = written(live.groupBy("id").agg(F.count("*").alias("held")), "held")
    share = (1 - F.col("held") / F.col("n")).alias("rank")
    ranked = live.join(small(held), "id").select("region", "after", "id", "n", "place", share, "far", "stuck", "tested")
    marks = written(verifier.classes.join(small(held.select("id")), "id", "left_semi").select("id", "n", *SKETCH), "marks")
    live, roots = discarding(written(ranked, "live"), live, held), None
    while True:
        known = with_roots(live, roots)
        regions = unsettled(known)
        if regions.isEmpty():
            return discarding(roots, live, regions, marks)
        ready = (F.col("size") <= SMALL_REGION) | (F.col("tested") & (F.col("size") <= LISTED))
        few = known.join(small(regions.where(ready).select("region")), "region")
        few = few.select("region", "id", "n", "place", "root", "far").join(marks.drop("n"), "id")
        few = written(few, "few")
        pairs = listed(few, percent, reach)
        others = regions.where(~ready).select("region", "size")
        more = not others.isEmpty()
        if more:
            stars = with_pivots(known.join(small(others), "region"), percent)
            star = stars.select(F.col("id").alias("a"), F.col("pivot").alias("b"), "size", "maybe").where("a <> b")
            whole = star.where(F.col("size") > LISTED).select("a", "b").distinct()
            tried = star.where((F.col("size") <= LISTED) & F.col("maybe")).select("a", "b").distinct()
            pairs = pairs.unionByName(alike(tried, marks, percent)).distinct()
        close = verifier.close(pairs)
        tests = written(close.unionByName(whole).distinct() if more else close, "tests")
        verifier.load(tests.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        distances = verifier.distances(tests)
        links = distances.where("linked").select("a", "b")
        if not links.isEmpty():
            roots = merged(roots, links)
        discarding(None, regions, few, close, tests)
        if not more:
            return discarding(roots, live, distances, marks)
        live = discarding(regions_within(stars, distances, roots, verifier, reach), live, stars, distances)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `documents` (doc_id, text)."""
    return grouped(documents, words, percent)[0].select("doc_id", "n_shingles", "component_id")


def grouped(documents: DataFrame, words: int, percent: int) -> tuple[DataFrame, np.ndarray, list[DataFrame]]:
    """near_duplicates() with class and root, a number for each component of several rows; the ranks of the buckets; what it reads."""
    ranks = rank_buckets(bucket_counts(documents, words))
    described = written(describe(documents, words, percent, ranks), "described")
    classes = distinct_classes(described)
    verifier = Verifier(documents, classes, words, percent, ranks)
    roots = class_links(verifier)
    found = with_roots(classes.select("id", "class", "doc_id", "again"), roots)
    if roots is None:
        found = found.where("again")
    else:
        found = found.join(small(roots.select("id")), "id", "left_semi").unionByName(
            found.where("again").join(small(roots.select("id")), "id", "left_anti")
        )
    first = found.groupBy("root").agg(F.min("doc_id").alias("first"))
    several = written(found.select("class", "root").join(first, "root"), "several")
    discarding(None, classes, *verifier.parts)
    out = described.drop("keys", *SKETCH).join(small(several), "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("component_id"),
        "class",
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"),
    )
    return out, ranks, [described, several]


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`documents` without near duplicates: of each component, one row with the smallest id.

    Rows with empty sets or null ids all stay. Rows of one id are judged each by its own text; where several of a
    component have the smallest id, the smallest class stays, and of its rows one with the smallest text.
    """
    found, ranks, read = grouped(documents, words, percent)
    groups = discarding(written(found, "groups"), *read)
    counted = groups.where("doc_id is not null").groupBy("doc_id").count()
    repeated = written(counted.where("count > 1").select("doc_id"), "repeated")
    dropped = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    if repeated.isEmpty():
        discarding(None, groups, repeated)
        return documents.join(small(dropped), "doc_id", "left_anti").select(*documents.columns)
    once = documents.join(small(repeated), "doc_id", "left_anti").join(small(dropped), "doc_id", "left_anti")
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def make():
        def run(part: pa.RecordBatch) -> list[list]:
            sets = shingle_sets(part.column("text").to_pylist(), words)
            return [[class_of(ordered(s, shared.value)) for s in sets]]

        return run

    held = documents.join(small(repeated), "doc_id", "left_semi")
    held = held.select("text", F.col("doc_id").cast("long").alias("id"), F.struct(*documents.columns).alias("row"))
    again = written(with_python_columns(held, make, "class binary"), "again")
    alone = F.when(F.col("root").isNull(), F.col("class"))
    first = groups.where("class is not null and doc_id = component_id").groupBy("root", alone.alias("alone"))
    first = first.agg(F.min(F.struct(F.col("doc_id").alias("id"), "class")).alias("kept")).select("kept.*")
    kept = again.join(first.join(small(repeated.withColumnRenamed("doc_id", "id")), "id", "left_semi"), ["id", "class"], "left_semi")
    one = kept.groupBy("id", "class").agg(F.min_by("row", "text").alias("row")).select("row.*")
    empty = again.where("class is null").select("row.*")
    return once.select(*documents.columns).unionByName(one).unionByName(empty)
