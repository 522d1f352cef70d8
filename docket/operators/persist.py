"""Accepted records as rows of the stored tables, with surrogate keys that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docket.functions.lineage import written
from docket.functions.text import blank_to_null, first_filled, strip
from docket.operators.dedup import join_known
from docket.operators.store import Index, Store

ROLE_OF = {"victims": "Victim", "suspects": "Suspect", "witnesses": "Witness", "officers": "Officer"}


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """`df` with `name`: start + 1, 2, ... in the order of the columns `order`, which have to be unique.

    Rows are dealt out by range and written, as a range's bounds come from a sample that could differ in a second run.
    Each range's count is added up on the driver (a number per partition), and the numbers go out from there. No
    partition holds all rows.
    """
    ranged = df.repartitionByRange(*(F.col(c) for c in order))
    placed = written(ranged.withColumn("_part", F.spark_partition_id()), "numbered")
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    offsets, total = [], start
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    offset = F.get(F.array(*map(F.lit, offsets)), F.col("_part")) if offsets else F.lit(start)
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, (offset + within).cast("long")).drop("_part")


def case_title(crime_type: Column, fir: Column) -> Column:
    lead = F.concat(first_filled(crime_type, F.lit("Incident")), F.lit(" report"))
    return F.concat(lead, F.when(blank_to_null(fir).isNotNull(), F.concat(F.lit(" (FIR "), fir, F.lit(")"))).otherwise(""))


def incident_time(day: Column, time: Column) -> Column:
    moment = F.concat(day.cast("string"), F.lit(" "), F.coalesce(time, F.lit("00:00:00")))
    return F.when(day.isNotNull(), F.try_to_timestamp(moment))


def case_columns() -> dict[str, Column]:
    """Columns of a stored case, from those of a record."""
    return {
        "case_number": first_filled(F.col("case_number"), F.col("fir_number")),
        "title": case_title(F.col("crime_type"), F.col("fir_number")),
        "description": F.col("description"),
        "incident_time": incident_time(F.col("incident_date"), F.col("incident_time")),
        "reported_time": F.col("report_date"),
        "confidence_score": F.col("confidence_score").cast("decimal(5,2)"),
        "status": first_filled(F.col("status"), F.lit("Open")),
        "source": first_filled(F.col("source_type"), F.lit("TEXT")),
    }


def get_or_create(names: DataFrame, dimension: DataFrame, key: str = "crime_type_id", name: str = "crime_name") -> DataFrame:
    """New rows of a dimension for `names` (row_id, value): one per name in lower case, under its first spelling, trimmed."""
    tidy = names.select("row_id", strip(F.col("value")).alias("value")).where("value <> ''")
    first = tidy.groupBy(F.lower("value").alias("_key")).agg(F.min_by("value", "row_id").alias(name), F.min("row_id").alias("_row"))
    known = dimension.select(F.lower(name).alias("_key")).distinct()
    new = first.join(known, "_key", "left_anti")
    start = dimension.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    made = number_rows(new, ["_row"], key, start)
    return made.select(key, name, F.lit(2).alias("severity"), F.concat(F.lit("Auto-generated crime type: "), name).alias("description"))


def stack_people(records: DataFrame, id_column: str) -> DataFrame:
    """(id, role, pos, person): all people of the four lists, in the order in which they are stored."""
    tagged = [F.transform(c, _with_role(role, n)) for n, (c, role) in enumerate(ROLE_OF.items())]
    return records.select(id_column, F.explode(F.concat(*tagged)).alias("e")).select(id_column, "e.role", "e.list", "e.pos", "e.person")


def _with_role(role: str, n: int):
    return lambda p, i: F.struct(F.lit(role).alias("role"), F.lit(n).alias("list"), i.alias("pos"), p.alias("person"))


def upsert_people(people: DataFrame, stored: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new persons, links) of `people` (order columns, case_id, role, name, ..., identification_number, remarks).

    An identification mark that is stored, or stood before in the batch, means that person, whose attributes stay. People
    without a mark are always new.
    """
    mark = blank_to_null(F.col("identification_number"))
    marked = people.withColumn("_mark", mark)
    known = stored.where("identification_mark <> ''").groupBy(F.col("identification_mark").alias("_mark")).agg(F.min("person_id").alias("_stored"))
    found = join_known(marked, known, "_mark")
    first = found.where("_mark is not null").groupBy("_mark").agg(F.min(F.struct(*order)).alias("_first"))
    found = join_known(found, first, "_mark")
    is_new = F.col("_stored").isNull() & (F.col("_mark").isNull() | (F.struct(*order) == F.col("_first")))
    start = stored.agg(F.coalesce(F.max("person_id"), F.lit(0))).first()[0]
    new = number_rows(found.where(is_new), order, "person_id", start)
    persons = new.select(
        "person_id", F.col("name").alias("full_name"), "gender", "age", "phone", "address", F.col("_mark").alias("identification_mark")
    )
    by_mark = new.where("_mark is not null").select("_mark", F.col("person_id").alias("_new"))
    by_row = new.where("_mark is null").select(*order, F.col("person_id").alias("_own"))
    links = join_known(found, by_mark, "_mark").join(by_row, order, "left")
    links = links.select("case_id", F.coalesce("_stored", "_new", "_own").alias("person_id"), "role", "remarks")
    return persons, links


def child_rows(records: DataFrame, items: str, id_column: str = "case_id") -> DataFrame:
    """(case_id, pos, fields of the item): a row per element of a list, repeats kept."""
    return records.select(id_column, F.posexplode(items).alias("pos", "item")).select(id_column, "pos", "item.*")


def evidence_rows(records: DataFrame) -> DataFrame:
    """File name from case and type (a missing type prints as None); path and description are the item's description."""
    rows = child_rows(records, "evidence")
    kind = F.coalesce("evidence_type", F.lit("None"))
    return rows.select(
        "case_id",
        "pos",
        "evidence_type",
        F.concat(F.lit("Evidence_"), F.col("case_id").cast("string"), F.lit("_"), kind).alias("file_name"),
        F.col("description").alias("file_path"),
        "description",
    )


def repeated_case_numbers(cases: DataFrame) -> DataFrame:
    """(case_number, n) of numbers that break the uniqueness of case_number."""
    return cases.where("case_number is not null").groupBy("case_number").agg(F.count("*").alias("n")).where("n > 1")


def persist(accepted: DataFrame, stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New rows of all tables for `accepted` records (row_id and a record). `stored`: crime_types, persons, cases, locations."""
    types = get_or_create(accepted.select("row_id", F.col("crime_type").alias("value")), stored["crime_types"])
    every = stored["crime_types"].select("crime_type_id", "crime_name").unionByName(types.select("crime_type_id", "crime_name"))
    every = every.groupBy(F.lower("crime_name").alias("_type")).agg(F.min("crime_type_id").alias("crime_type_id"))
    start = {n: stored[n].agg(F.coalesce(F.max(k), F.lit(0))).first()[0] for n, k in (("cases", "case_id"), ("locations", "location_id"))}
    rows = number_rows(accepted, ["row_id"], "case_id", start["cases"])
    placed = number_rows(rows.where("location is not null").select("row_id", "location"), ["row_id"], "location_id", start["locations"])
    rows = rows.join(placed.select("row_id", "location_id"), "row_id", "left")
    rows = rows.withColumn("_type", F.lower(strip(F.col("crime_type")))).join(every, "_type", "left")
    people = stack_people(rows, "case_id").withColumn("person", F.col("person").dropFields("role"))
    people = people.select("case_id", "role", "list", "pos", "person.*")
    persons, links = upsert_people(people, stored["persons"], ["case_id", "list", "pos"])
    where = F.col("location")
    return {
        "crime_types": types,
        "locations": placed.select(
            "location_id", where["address"].alias("address"), where["landmark"].alias("landmark"),
            first_filled(where["locality"], where["area"]).alias("city"), where["state"].alias("state"), where["postal_code"].alias("postal_code"),
            where["latitude"].cast("decimal(10,8)").alias("latitude"), where["longitude"].cast("decimal(11,8)").alias("longitude"),
        ),
        "cases": rows.select("case_id", "crime_type_id", "location_id", *(c.alias(n) for n, c in case_columns().items())),
        "persons": persons,
        "case_persons": links,
        "vehicles": child_rows(rows, "vehicles").drop("pos"),
        "weapons": child_rows(rows, "weapons").drop("pos"),
        "evidence": evidence_rows(rows).drop("pos"),
        "media": child_rows(rows, "media").select("case_id", "media_type", "file_name", "file_path", "mime_type"),
    }


#: What must be unique in the stored tables.
KEYS = {
    "cases": ["case_id", "case_number"],
    "locations": ["location_id"],
    "persons": ["person_id", "nullif(identification_mark, '')"],
    "crime_types": ["crime_type_id", "lower(crime_name)"],
}


#: What is looked up by key when a batch is judged.
INDEXES = {"case_numbers": Index("cases", "nullif(case_number, '')", ("case_id",))}


def commit(tables: dict[str, DataFrame], folder: str, batch: str) -> int:
    """Commits every table's rows as one version of the store in `folder`. Raises Conflict if other writers came first with the same keys.

    Rows that depend on what is stored are better made anew in that case: Ingest.store().
    """
    spark = next(iter(tables.values())).sparkSession
    return Store(spark, folder, KEYS, INDEXES).transact(batch, lambda _: tables, attempts=1)


def read_committed(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    return Store(spark, folder, KEYS, INDEXES).snapshot().read(name)
