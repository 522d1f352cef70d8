"""A corpus pipeline over `documents`: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last return the columns of
`docs`. Documents go that fail the quality rules or stand on a rejected host, that are near duplicates (five-word
shingles, similarity of 0.8 or more) of a document with a smaller id, or that hold a benchmark item. Secrets are
replaced by a mark. The last stage adds token ids.

Defined cases: null and empty texts fail the quality rules; very long texts are processed whole; of near duplicates, the
one with the smallest id stays, of rows that are equal in id and shingles one; an empty table stays empty. Further columns
are kept as they are, whatever their names: operators see them under other names. Where a document has a column named as
those that the last stage adds (ids, n_tokens, round_trip), it is given back with an underscore before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import decontaminate, jaccard, quality, secrets, sentencepiece_bpe
from docket.llm.queries import table, tokenizer_file
from docket.llm.shared import discarding, free_name, written


def shielded(docs: DataFrame, *needed: str) -> DataFrame:
    """`docs` with only the `needed` columns under their names; the others are numbered."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(others)))


def unshielded(docs: DataFrame, *needed: str) -> list[Column]:
    """The columns of `docs`, out of what an operator made of shielded()."""
    others = iter(range(len(docs.columns)))
    return [F.col(c) if c in needed else F.col(f"own_{next(others)}").alias(c) for c in docs.columns]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("text", "source")
    return quality.judge(shielded(docs, *own)).where("kept").select(*unshielded(docs, *own))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("doc_id", "text")
    return jaccard.keep_one(shielded(docs, *own), words=5, percent=80).select(*unshielded(docs, *own))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(shielded(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*unshielded(docs, "text"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ("text", "n_chars") if "n_chars" in docs.columns else ("text",)
    changed = secrets.scan(shielded(docs, *own))
    changed = changed.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*unshielded(docs, *own))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_bpe.encode(shielded(docs, "text"), tokenizer_file("piece_bpe_32k.model"))
    tokens = {"ids": F.col("ids"), "n_tokens": F.col("n_tokens"), "round_trip": F.col("decoded").eqNullSafe(F.col("text"))}
    kept = [c.alias(free_name(docs, name) if name in tokens else name) for c, name in zip(unshielded(docs, "text"), docs.columns)]
    return encoded.select(*kept, *(c.alias(name) for name, c in tokens.items()))


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("secret scan", without_secrets),
    ("tokens", tokenised),
]

#: SQL can express neither the exact near-duplicate components nor the alignment nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables between stages, only the one that it reads stays."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = discarding(written(stage(spark, docs, sf_dir), name.replace(" ", "-")), *done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
