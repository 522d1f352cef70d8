
from __future__ import annotations

import math
import os
import random
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions import similarity
from docket.operators import dedup, persist
from docket.operators import schema as S
from tools_oracle import session


def words(rng: random.Random, n: int) -> list[str]:
    syllables = [a + b for a in "bdfghklmnprstvz" for b in "aeiou"]
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def strings(spark: SparkSession, n: int, parts: int, pool: int) -> DataFrame:
    """n distinct strings of so many words from a pool; one in 50 is a copy with a letter less."""
    rng = random.Random(1)
    known = words(rng, pool)
    found: set[str] = set()
    while len(found) < n:
        text = " ".join(rng.choice(known) for _ in range(parts))
        found.add(text)
        if len(found) % 50 == 0:
            found.add(text[:3] + text[4:])
    return spark.createDataFrame([(x,) for x in found], "a string").repartition(8)


def joined(spark: SparkSession, name: str, n: int, parts: int, pool: int, percent: float) -> None:
    texts = strings(spark, n, parts, pool)
    t = percent / 100
    base = math.log((2 - t) / t) + 1e-9
    classes = {r[0]: r[1] for r in texts.groupBy(F.floor(F.log(F.length("a")) / base)).count().collect()}
    alike = sum(m * classes.get(c + k, 0) for c, m in classes.items() for k in (-1, 0, 1))
    began = time.time()
    candidates = similarity.candidate_pairs(texts, texts.withColumnRenamed("a", "b"), percent).count()
    half = time.time()
    found = similarity.similar_strings(texts, texts.withColumnRenamed("a", "b"), percent).count()
    print(f"{name}: {n} strings, {alike} pairs of like length, {candidates} candidates ({100 * candidates / alike:.3f} %), {found} similar; {half - began:.0f} s for candidates, {time.time() - half:.0f} s for the join", flush=True)


def settled(spark: SparkSession) -> None:
    chain = spark.range(1, 100_000).select(F.col("id").alias("earlier"), (F.col("id") + 1).alias("later"))
    groups = spark.range(10_000).select((F.col("id") * 10 + 1_000_000).alias("first"))
    small = groups.select(F.col("first").alias("earlier"), F.explode(F.sequence(F.col("first") + 1, F.col("first") + 4)).alias("later"))
    rows = spark.range(1, 100_001).union(groups.select(F.explode(F.sequence(F.col("first"), F.col("first") + 4))))
    began = time.time()
    kept = dedup.settle_in_order(chain.union(small), rows).where("kept").count()
    print(f"settling: a chain of 100,000 and 10,000 groups of 5: {kept} kept, {time.time() - began:.0f} s", flush=True)


def equal_texts(spark: SparkSession) -> None:
    lists = {f.name for f in S.RECORD.fields if f.dataType.typeName() == "array"}
    made = {"fir_number": F.concat(F.lit("E"), "id"), "description": F.lit("the same standard sentence about a stolen bicycle, as a form has it")}
    batch = spark.range(100_000).select(
        F.col("id").alias("row_id"),
        *(made.get(f.name, F.array() if f.name in lists else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RECORD.fields),
    )
    assert isinstance(batch.schema["location"].dataType, T.StructType)
    began = time.time()
    gone = dedup.check_batch(batch, persist.case_columns()).where("is_duplicate").count()
    print(f"a batch of 100,000 reports with one description: {gone} duplicates, {time.time() - began:.0f} s", flush=True)


PARTS = {
    "names": lambda spark: joined(spark, "names", int(os.environ.get("ROWS", 200_000)), 2, 3_000, 80.0),
    "descriptions": lambda spark: joined(spark, "descriptions", int(os.environ.get("ROWS", 20_000)), 30, 3_000, 85.0),
    "settling": settled,
    "equal": equal_texts,
}

if __name__ == "__main__":
    spark = session()
    for name in sys.argv[1:] or PARTS:
        PARTS[name](spark)
