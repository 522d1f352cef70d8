"""The whole chain: records are validated, enriched, checked for duplicates, and the accepted ones become table rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.lineage import written
from docket.functions.text import strip
from docket.operators import dedup, geocode, jobs, persist
from docket.operators.store import Snapshot, Store
from docket.operators.validate import bounds, enums, ranges, validate
from docket.sources import documents, tabular


@dataclass
class Ingest:
    """What the chain needs. `readers` turn (spark, path) into records; formats without one fail with a clear error."""

    as_of: Column
    gazetteer: DataFrame | None = None
    config: dedup.DedupConfig = field(default_factory=dedup.DedupConfig)
    window_days: int | None = None
    readers: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)

    def read(self, spark: SparkSession, source: str, source_type: str) -> DataFrame:
        kind = source_type.strip().upper()
        if kind in self.readers:
            return self.readers[kind](spark, source)
        if kind in ("CSV", "EXCEL"):
            rows, _ = tabular.extract_rows(tabular.read_table(spark, source))
            return tabular.rows_to_records(rows, source, kind)
        raise ValueError(f"no reader for source type '{source_type}'")

    def outcomes(self, records: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
        """`records` (row_id and a record) with errors, warnings, is_duplicate, matched_id, and `outcome`.

        Invalid records are never compared. The others are compared with the stored cases, and those that match none with
        the earlier ones of the batch that were accepted; there, matched_row is the earlier record's row_id.
        """
        checked = validate(records.drop("is_duplicate", "duplicate_reason"), self.as_of)
        if self.gazetteer is not None:
            checked = geocode.enrich(checked, self.gazetteer)
        checked = written(checked, "checked")
        valid = checked.where("is_valid")
        people = stored["people"] if "people" in stored else dedup.people_of_cases(stored["case_persons"], stored["persons"])
        found = dedup.check_duplicates(
            valid, stored["cases"], stored["locations"], people, stored["vehicles"], self.config, self.window_days, stored.get("numbers")
        )
        found = written(found.withColumn("matched_row", F.lit(None).cast("long")), "duplicates")
        fresh = written(valid.join(found.where("not is_duplicate").select("row_id"), "row_id", "left_semi"), "fresh")
        later = dedup.check_batch(fresh, persist.case_columns(), self.config, self.window_days).where("is_duplicate")
        later = written(later.withColumnRenamed("matched_id", "matched_row").withColumn("matched_id", F.lit(None).cast("long")), "later")
        found = found.join(later.select("row_id"), "row_id", "left_anti").unionByName(later)
        joined = checked.join(found.withColumnRenamed("reason", "duplicate_reason"), "row_id", "left")
        duplicate = F.coalesce("is_duplicate", F.lit(False))
        outcome = F.when(~F.col("is_valid"), "Invalid").when(duplicate, "Duplicate").otherwise("Inserted")
        return joined.withColumns({"is_duplicate": duplicate, "outcome": outcome})

    def tables(self, outcomes: DataFrame, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return persist.persist(written(outcomes.where("outcome = 'Inserted'"), "accepted"), stored)

    def store(self, records: DataFrame, store: Store, batch: str, base: dict[str, DataFrame]) -> int:
        """Judges `records` against what `store` holds, beside `base`, and commits the accepted ones; the version.

        If another writer commits the same keys meanwhile, all is judged anew against its rows. A table "outcomes" has
        each record's outcome, and "summaries" the counts of outcomes and rules, made in the pass that writes them. `base` has all tables that outcomes() and tables() read, also while the store is empty.
        """

        def make(seen: Snapshot) -> dict[str, DataFrame]:
            held = {name: rows for name in TABLES if (rows := seen.read(name)) is not None}
            stored = {n: both_of(base.get(n), held.get(n)) for n in {*base, *held}}
            if "people" in base:
                linked = held.get("case_persons")
                named = None if linked is None else dedup.people_of_cases(linked, held["persons"])
                stored["people"] = both_of(base["people"], named)
            if "case_numbers" in store.indexes:
                asked = records.select(F.explode(F.array("fir_number", "case_number")).alias("key"))
                known = seen.lookup("case_numbers", asked)
                known = None if known is None else known.select("case_id", F.col("key").alias("case_number"))
                stored["numbers"] = both_of(base["cases"].select("case_id", "case_number"), known)
            judged, counts = jobs.counted(self.outcomes(records, stored), RULES, "errors", "warnings")
            judged = written(judged, "outcomes")
            summary = judged.sparkSession.createDataFrame([(batch, counts.get)], "batch string, counts map<string,long>")
            said = judged.select("row_id", "outcome", "matched_id", "matched_row", "duplicate_reason", "validation_errors")
            return self.tables(judged, stored) | {"outcomes": said, "summaries": summary}

        return store.transact(batch, make)


RULES = [f"V{i}" for i in range(1, 20)]
#: The stored tables that records are judged by.
TABLES = ("cases", "locations", "persons", "case_persons", "vehicles", "crime_types")


def both_of(base: DataFrame | None, added: DataFrame | None) -> DataFrame:
    if base is None or added is None:
        return base if added is None else added
    common = [c for c in base.columns if c in added.columns]
    return base.select(common).unionByName(added.select(common))


def reply_records(replies: DataFrame) -> DataFrame:
    """`replies` (row_id, reply) as records, with `error` for replies that aren't records. Null lists become empty.

    A value that is none of its enumeration, or out of its bounds, makes the whole reply no record, as a wrong type does.
    """
    parsed = replies.withColumn("_parsed", documents.parse_reply(F.col("reply")))
    fields = documents.S.RECORD.fields
    columns = []
    for f in fields:
        value = F.col(f"_parsed.record.{f.name}")
        if f.dataType.typeName() == "array":
            value = F.coalesce(value, F.array().cast(f.dataType))
        columns.append(value.alias(f.name))
    rows = parsed.select("row_id", F.col("_parsed.error").alias("error"), *columns)
    score = ranges(F.col("location.latitude"), F.col("location.longitude"), F.col("confidence_score"))
    wrong = F.size(F.concat(enums(), bounds(), score)) > 0
    rows = rows.withColumn("error", F.when(F.col("error").isNull() & wrong, "schema").otherwise(F.col("error")))
    good = F.col("error").isNull()
    lists = {f.name: F.array().cast(f.dataType) for f in fields if f.dataType.typeName() == "array"}
    return rows.select(
        "row_id", "error", *(F.when(good, F.col(f.name)).otherwise(lists.get(f.name, F.lit(None))).alias(f.name) for f in fields)
    )


def page_records(pages: DataFrame, reply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`pages` (row_id, url, html) as records, by way of their text: `reply` turns (row_id, text) into (row_id, reply).

    source_type, source_url and extracted_text say where a record is from; pages without text or a reply have an error.
    """
    texts = written(documents.extract_pages(pages).select("row_id", "url", "text", F.col("error").alias("page_error")), "texts")
    asked = reply(texts.where("page_error is null").select("row_id", "text")).select("row_id", "reply")
    return sourced(reply_records(asked), texts, "URL")


def text_records(texts: DataFrame, reply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`texts` (row_id, text) as records, as page_records() does for pages."""
    given = texts.select("row_id", F.lit(None).cast("string").alias("url"), "text")
    given = given.withColumn("page_error", F.when(F.coalesce(strip(F.col("text")), F.lit("")) == "", "no text"))
    asked = reply(given.where("page_error is null").select("row_id", "text")).select("row_id", "reply")
    return sourced(reply_records(asked), given, "TEXT")


def sourced(records: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    own = ("source_type", "source_url", "extracted_text")
    joined = texts.join(records.drop(*own), "row_id", "left")
    values = {"source_type": F.lit(kind), "source_url": F.col("url"), "extracted_text": F.col("text")}
    lists = {f.name for f in documents.S.RECORD.fields if f.dataType.typeName() == "array"}
    columns = [
        values.get(f.name, F.coalesce(f.name, F.array().cast(f.dataType)) if f.name in lists else F.col(f.name)).alias(f.name)
        for f in documents.S.RECORD.fields
    ]
    return joined.select("row_id", F.coalesce("page_error", "error").alias("error"), *columns)
