"""String similarity: 200 * LCS / (n + m), and a lossless join on it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions.indel import Cell, budget
from docket.functions.lineage import written


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one machine word (of any size) a row."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & places.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * LCS / (n + m). Null with a null; 100 for two empty strings."""
    return pd.Series(
        [
            None if x is None or y is None else 200 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0
            for x, y in zip(a, b)
        ],
        dtype="float64",
    )


#: Characters are counted in 32 groups (by code); a count is as many set bits of sixteen, four counts to a long.
COUNTS, PER_LONG, BITS = [f"_c{i}" for i in range(8)], 4, 16


def letter_counts(text: Column) -> Column:
    """A struct of COUNTS: how often each group of characters stands in `text`, at most BITS each.

    An indel changes one count by one, so the sum of differences of two texts' counts is at most their indel distance.
    As counts are runs of set bits, that sum is the number of bits in which they differ.
    """
    plain = F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "~")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.ascii(c).bitwiseAND(len(COUNTS) * PER_LONG - 1))

    def add(counts: Column, code: Column) -> Column:
        shift = (code % PER_LONG) * BITS

        def one(i: int) -> Column:
            run = F.call_function("shiftright", counts[COUNTS[i]], shift).bitwiseAND((1 << BITS) - 1)
            longer = (run * 2 + 1).bitwiseAND((1 << BITS) - 1)
            more = counts[COUNTS[i]].bitwiseOR(F.call_function("shiftleft", longer, shift))
            return F.when(F.floor(code / PER_LONG) == i, more).otherwise(counts[COUNTS[i]])

        return F.struct(*(one(i).alias(c) for i, c in enumerate(COUNTS)))

    return F.aggregate(codes, F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS)), add)


def count_distance(a: str, b: str) -> Column:
    """The sum of differences of packed counts, in columns of COUNTS with prefixes `a` and `b`."""
    return F.expr(" + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in COUNTS))


#: Pairs that a task should look at, and bytes of strings that it holds at most; slices of the strings where bytes ask for no more.
PAIRS_A_TASK, BYTES_A_TASK, SLICES = 400_000_000, 16 << 20, 20
#: Pairs that are looked at in the time of one key, and the longest strings that keys are made of.
PAIRS_A_KEY, KEYED = 1_000, 64


def least_common(n: int, m: int, percent: float) -> int:
    """The shortest common subsequence that gives strings of n and m characters a ratio of `percent`."""
    return (n + m - int(budget(n, m, percent)) + 1) // 2


class Strings:
    """The distinct strings of `left` (a) and `right` (b), written once, and how many there are. Null and empty ones are left out."""

    def __init__(self, left: DataFrame, right: DataFrame, percent: float):
        both = left.select(F.col("a").alias("x"), F.lit(1).alias("side")).union(right.select("b", F.lit(2)))
        found = both.where("x <> ''").groupBy("x").agg(F.bit_or("side").alias("side"))
        self.rows, self.percent = written(found, "strings"), percent
        sizes = self.rows.groupBy("side", F.least(F.length("x"), F.lit(KEYED + 1)).alias("n"))
        sizes = sizes.agg(F.count("*").alias("rows"), F.sum(F.octet_length("x")).alias("bytes")).collect()  # 3 (KEYED + 1) rows at most
        count = {s: sum(r["rows"] for r in sizes if r["side"] == s) for s in (1, 2, 3)}
        self.bytes = sum(r["bytes"] for r in sizes)
        self.pairs = count[3] ** 2 // 2 + count[1] * (count[2] + count[3]) + count[3] * count[2]
        self.lengths = {r["n"]: sum(x["rows"] for x in sizes if x["n"] == r["n"]) for r in sizes}

    def same(self) -> DataFrame:
        return self.rows.where("side = 3").select(F.col("x").alias("a"), F.col("x").alias("b"))

    def key_lengths(self) -> dict[int, list[int]] | None:
        """For each length, those of the subsequences that strings of it share with similar strings; None if these are too many to list."""
        if max(self.lengths, default=0) > KEYED:
            return None
        found: dict[int, set[int]] = {n: set() for n in self.lengths}
        for n in self.lengths:
            for m in self.lengths:
                if (least := least_common(n, m, self.percent)) <= min(n, m):
                    found[n].add(least)
        keys = sum(rows * sum(math.comb(n, k) for k in found[n]) for n, rows in self.lengths.items())
        return {n: sorted(ks) for n, ks in found.items()} if keys * PAIRS_A_KEY <= self.pairs else None

    def meeting_by_key(self, lengths: dict[int, list[int]]) -> DataFrame:
        """Pairs (a, b) of different strings with a common subsequence of the least length: all that are similar."""

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                    found = [list({"".join(c) for n in lengths[len(x)] for c in combinations(x, n)}) for x in part.column(0).to_pylist()]
                    rows = pa.array([i for i, ks in enumerate(found) for _ in ks], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([k for ks in found for k in ks], pa.string()), *(c.take(rows) for c in part.columns)], ["key", "x", "side"])

        keyed = self.rows.select("x", "side").mapInArrow(keys, "key string, x string, side int")
        one = keyed.where("side in (1, 3)").select("key", F.col("x").alias("a"))
        two = keyed.where("side in (2, 3)").select("key", F.col("x").alias("b"))
        total = F.length("a") + F.length("b")
        most = F.floor((1 - self.percent / 100) * total + 1e-6)
        meet = (F.col("a") != F.col("b")) & (F.floor((total - most + 1) / 2) == F.length("key"))
        return one.join(two, "key").where(meet).select("a", "b").distinct()

    def meeting_in_cells(self, verified: bool) -> DataFrame:
        """Pairs (a, b, ratio) of different similar strings, or of all that bounds don't exclude, with a null for ratio.

        Strings are dealt to slices by hash. Each two slices, and each with itself, are a cell, which one task works through.
        """
        slices = max(min(SLICES, math.ceil(math.sqrt(2 * self.pairs / PAIRS_A_TASK))), math.ceil(2 * self.bytes / BYTES_A_TASK), 1)
        own = self.rows.select("x", "side", F.pmod(F.xxhash64("x"), F.lit(slices)).alias("s"))
        met = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("t"))
        low = F.least("s", "t")
        number = (low * (2 * slices + 1 - low) / 2 + F.greatest("s", "t") - low).cast("int")
        met = met.select("x", "side", (F.col("s") > F.col("t")).alias("second"), number.alias("cell"))
        percent = self.percent

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells: dict[int, list[pa.Table]] = {}
            for batch in batches:  # a task has one cell
                held = pa.Table.from_batches([batch])
                for k in held.column("cell").unique().to_pylist():
                    cells.setdefault(k, []).append(held.filter(pc.equal(held.column("cell"), k)))
            for parts in cells.values():
                rows = pa.concat_tables(parts)
                texts = rows.column("x").combine_chunks()
                side, second = (rows.column(c).combine_chunks().cast(pa.int64()).to_numpy() for c in ("side", "second"))
                cell = Cell(texts.to_pylist(), side, second, percent)
                for i, j in cell.candidates():
                    i, j, ratio = cell.verified(i, j) if verified else (i, j, np.zeros(len(i)))
                    if len(i):
                        one, two, ratio = cell.named(i, j, ratio)
                        yield pa.RecordBatch.from_arrays([texts.take(pa.array(one)), texts.take(pa.array(two)), pa.array(ratio)], ["a", "b", "ratio"])

        return met.repartitionById(slices * (slices + 1) // 2, "cell").mapInArrow(pairs, "a string, b string, ratio double")


def candidate_pairs(left: DataFrame, right: DataFrame, percent: float) -> DataFrame:
    """Pairs (a, b, most) of strings of `left` (a) and `right` (b) that may have a ratio of `percent`; none with one is lacking.

    A ratio of t means an indel distance of (1 - t)(n + m) at most: `most`. The strings' lengths and the bits of their letter
    counts differ by no more. Each pair meets once. Null and empty strings are in no pair.
    """
    strings = Strings(left, right, percent)
    most = F.floor((1 - percent / 100) * (F.length("a") + F.length("b")) + 1e-6).cast("int")
    return strings.same().union(strings.meeting_in_cells(False).select("a", "b")).select("a", "b", most.alias("most"))


def similar_strings(left: DataFrame, right: DataFrame, percent: float) -> DataFrame:
    """Pairs (a, b, ratio) of distinct strings of `left` (a) and `right` (b) with a ratio of at least `percent`.

    Where few subsequences are left by the most deletions that similar strings differ by (plates), strings meet through
    these, and work grows with the strings and the result. Otherwise all pairs are looked at that the bounds on blocks of
    strings leave, which grows with the square of the strings: at ratios this low no key is both selective and lossless. A
    look at a pair takes some nanoseconds, see docket.functions.indel.
    """
    strings = Strings(left, right, percent)
    keys = strings.key_lengths()
    if keys is None:
        found = strings.meeting_in_cells(True)
    else:
        found = strings.meeting_by_key(keys).withColumn("ratio", indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= percent)
    return found.union(strings.same().select("a", "b", F.lit(100.0)))


def register(spark: SparkSession) -> None:
    """Makes the ratio available in SQL as indel_ratio(a, b)."""
    spark.udf.register("indel_ratio", indel_ratio)
