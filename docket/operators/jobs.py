"""Job status, batch summaries, and the relational parts of user access."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def job_rows(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """`jobs` (job_id, source_type) with the outcome in `results` (job_id, success, error_message, inserted).

    Jobs without a result are still running. OCR counts as done for page formats whenever the job succeeded.
    """
    joined = jobs.join(results, "job_id", "left")
    success = F.col("success")
    return joined.select(
        "job_id",
        F.when(success.isNull(), "Running").when(success, "Completed").otherwise("Failed").alias("processing_status"),
        F.coalesce(success & F.col("source_type").isin("PDF", "IMAGE"), F.lit(False)).alias("ocr_completed"),
        F.coalesce(success, F.lit(False)).alias("extraction_completed"),
        F.coalesce(success & F.col("inserted"), F.lit(False)).alias("database_insertion_completed"),
        F.when(~success, F.col("error_message")).alias("error_message"),
        F.when(success, as_of).alias("completed_at"),
    )


def batch_summary(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of `outcome` by batch: duplicates count as processed; a batch with something processed is a success."""
    processed = F.count_if(F.col("outcome").isin("Inserted", "Duplicate"))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"),
        processed.alias("processed"),
        F.count_if(F.col("outcome") == "Duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "Invalid").alias("invalid"),
        (processed > 0).alias("success"),
    )


def counted(outcomes: DataFrame, rules: list[str], *found: str) -> tuple[DataFrame, Observation]:
    """`outcomes`, and counts that the next job which reads all of it makes on the way: one pass for writing and summary.

    total, each outcome, valid rows, and for each rule the rows in which one of the lists `found` (of structs with a rule) has it.
    """
    seen = Observation(f"outcomes-{uuid.uuid4().hex}")
    counts = [F.count(F.lit(1)).alias("total")]
    if "outcome" in outcomes.columns:
        counts += [F.count_if(F.col("outcome") == x).alias(x.lower()) for x in ("Inserted", "Duplicate", "Invalid")]
    for rule in rules:
        has = [F.exists(c, lambda e: e["rule"] == rule) for c in found]
        counts.append(F.count_if(reduce(Column.__or__, has)).alias(rule))
    return outcomes.observe(seen, *counts), seen


def authorised(users: DataFrame, roles: DataFrame, role: str | None = None) -> DataFrame:
    """Active users with the name of their role; with `role`, only those who have it."""
    joined = users.where("is_active").join(roles, "role_id", "left")
    return joined if role is None else joined.where(F.col("role_name") == role)


def new_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, email) with `accepted`: the address isn't stored and no earlier request has it."""
    first = requests.groupBy("email").agg(F.min("request_id").alias("_first"))
    stored = users.select("email").distinct().withColumn("_stored", F.lit(True))
    joined = requests.join(first, "email", "left").join(stored, "email", "left")
    accepted = F.col("_stored").isNull() & (F.col("_first") == F.col("request_id"))
    return joined.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("_first", "_stored")
