"""Validation of records: errors and warnings in a fixed order, as arrays of (rule, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.functions.text import strip
from docket.operators import schema as S

FOUND = "array<struct<rule:string,message:string>>"


def rule(code: str, failed: Column, *message: Column | str) -> Column:
    """(code, message) where `failed` holds, else null."""
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.when(failed, F.struct(F.lit(code).alias("rule"), F.concat(*parts).alias("message")))


def listed(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull()).cast(FOUND)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def required(fir: Column, case: Column, crime_type: Column, incident: Column) -> Column:
    return listed(
        rule("V1", blank(fir) & blank(case), "Invalid Record: Both 'fir_number' and 'case_number' are missing."),
        rule("V2", blank(crime_type), "Invalid Record: Missing 'crime_type'."),
        rule("V3", incident.isNull(), "Invalid Record: Missing 'incident_date'."),
    )


def temporal(incident: Column, report: Column, as_of: Column) -> Column:
    """`as_of`: the timestamp that stands for now."""
    happened = "Temporal Exception: 'incident_date' ("
    reported = "Temporal Exception: 'report_date' ("
    return listed(
        rule("V4", incident > as_of.cast("date"), happened, incident, ") is in the future."),
        rule("V5", F.year(incident) < 1900, happened, incident, ") is chronologically too old (pre-1900)."),
        rule("V6", report > as_of, reported, report, ") is in the future."),
        rule(
            "V7",
            report < incident.cast("timestamp"),
            reported,
            report,
            ") cannot occur before 'incident_date' (",
            incident,
            ").",
        ),
    )


def ranges(latitude: Column, longitude: Column, score: Column) -> Column:
    place = "Coordinates Exception: "
    return listed(
        rule("V8", ~latitude.between(-90, 90), place, "Latitude (", latitude, ") falls outside coordinate bounds [-90, 90]."),
        rule("V9", ~longitude.between(-180, 180), place, "Longitude (", longitude, ") falls outside coordinate bounds [-180, 180]."),
        rule("V10", ~score.between(0, 1), "Validation Exception: Extraction confidence_score (", score, ") falls outside scale [0.0, 1.0]."),
    )


def repeats(code: str, items: Column, key, message) -> Column:
    """A (rule, message) for each item of a list whose key stood before; `message(item, key, index)`. Blank keys don't count."""

    def again(sorted_keys: Column) -> Column:
        """Places of all but the first of equal keys, which stand side by side."""
        same = lambda k, j: (j > 0) & (k["key"] != "") & (F.get(sorted_keys, j - 1)["key"] == k["key"])
        return F.array_sort(F.transform(F.filter(sorted_keys, same), lambda k: k["i"]))

    def said(i: Column) -> Column:
        item = F.get(items, i)
        return F.struct(F.lit(code).alias("rule"), F.concat(*message(item, key(item), i.cast("string"))).alias("message"))

    keys = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("i"))))
    # as an element of an array, the sorted list is worked out once and not for each item
    places = F.element_at(F.transform(F.array(keys), again), 1)
    return F.coalesce(F.transform(places, said), F.array()).cast(FOUND)


def repeated_people(people: Column, name: str) -> Column:
    def text(what: str, value: Column, i: Column) -> list[Column]:
        lead, tail = F.lit(f"Compliance warning: Duplicate {what} '"), F.lit("' found for person at index ")
        return [lead, value, tail, i, F.lit(f" in {name} list.")]

    ids = repeats("V12", people, lambda p: F.upper(strip(p["identification_number"])), lambda p, k, i: text("identification number", k, i))
    names = repeats("V13", people, lambda p: F.lower(strip(p["name"])), lambda p, k, i: text("name", p["name"], i))
    return F.concat(ids, names)


def repeated_vehicles(vehicles: Column) -> Column:
    return repeats(
        "V14",
        vehicles,
        lambda v: F.upper(strip(v["registration_number"])),
        lambda v, k, i: [
            F.lit("Compliance warning: Duplicate vehicle registration '"), v["registration_number"],
            F.lit("' found at index "), i, F.lit(" in vehicles list."),
        ],
    )


def enumerated(code: str, value: Column, allowed: tuple[str, ...], *message: Column | str) -> Column:
    """Null and empty values pass."""
    return rule(code, (value != "") & ~value.isin(*allowed), *message)


def enumerated_items(code: str, items: Column, field: str, allowed: tuple[str, ...], message) -> Column:
    found = F.transform(items, lambda x, i: enumerated(code, x[field], allowed, *message(x[field], i.cast("string"))))
    return F.coalesce(F.filter(found, lambda r: r.isNotNull()), F.array()).cast(FOUND)


def enums() -> Column:
    """V15 to V18 on the columns of a record."""
    lead = "Enum constraint exception: "
    parts = [
        listed(
            enumerated("V15", F.col("status"), S.STATUSES, lead, "Current status '", F.col("status"), "' is not a valid CrimeStatus."),
            enumerated("V16", F.col("source_type"), S.SOURCE_TYPES, lead, "Current source_type '", F.col("source_type"), "' is not a valid SourceType."),
        )
    ]
    for people in S.PEOPLE:
        for field, allowed, kind in (("gender", S.GENDERS, "Gender"), ("role", S.ROLES, "PersonRole")):
            def message(v, i, people=people, kind=kind, field=field):  # noqa: E306
                return lead, f"{field.capitalize()} '", v, f"' for '{people}[", i, f"]' is not a valid {kind}."

            parts.append(enumerated_items("V17", F.col(people), field, allowed, message))
    for items, field, allowed, name, kind in (
        ("vehicles", "vehicle_type", S.VEHICLE_TYPES, "Vehicle", "VehicleType"),
        ("weapons", "weapon_type", S.WEAPON_TYPES, "Weapon", "WeaponType"),
        ("media", "media_type", S.MEDIA_TYPES, "Media", "MediaType"),
    ):
        def message(v, i, name=name, kind=kind):  # noqa: E306
            return lead, f"{name} type '", v, "' at indices ", i, f" is not a valid {kind}."

        parts.append(enumerated_items("V18", F.col(items), field, allowed, message))
    return F.concat(*parts)


def bounds() -> Column:
    """V19: ages outside 0 to 150 in any list of people."""
    parts = []
    for people in S.PEOPLE:
        found = F.transform(people, lambda p, i: rule("V19", ~p["age"].between(0, 150), "Age (", p["age"], ") falls outside [0, 150]."))
        parts.append(F.coalesce(F.filter(found, lambda r: r.isNotNull()), F.array()).cast(FOUND))
    return F.concat(*parts)


def trimmed_record(records: DataFrame) -> DataFrame:
    """Every string of the record and of its nested records trimmed; strings in lists of strings and in maps stay."""

    def trim_struct(value: Column, fields) -> Column:
        return F.struct(*((strip(value[f.name]) if f.dataType.typeName() == "string" else value[f.name]).alias(f.name) for f in fields))

    def trimmer(fields):
        return lambda x: trim_struct(x, fields)

    out = {}
    for f in records.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            out[f.name] = strip(F.col(f.name))
        elif kind == "struct":
            out[f.name] = F.when(F.col(f.name).isNotNull(), trim_struct(F.col(f.name), f.dataType.fields))
        elif kind == "array" and f.dataType.elementType.typeName() == "struct":
            out[f.name] = F.transform(f.name, trimmer(f.dataType.elementType.fields))
    return records.withColumns(out)


def validate(records: DataFrame, as_of: Column) -> DataFrame:
    """Records, trimmed, with errors and warnings (rule, message), validation_errors and is_valid."""
    records = trimmed_record(records)
    errors = F.concat(
        required(F.col("fir_number"), F.col("case_number"), F.col("crime_type"), F.col("incident_date")),
        temporal(F.col("incident_date"), F.col("report_date"), as_of),
        ranges(F.col("location.latitude"), F.col("location.longitude"), F.col("confidence_score")),
        enums(),
        bounds(),
    )
    description = listed(rule("V11", blank(strip(F.col("description"))), "Compliance warning: 'description' narrative is empty."))
    warnings = F.concat(description, *(repeated_people(F.col(p), p) for p in S.PEOPLE), repeated_vehicles(F.col("vehicles")))
    return (
        records.withColumns({"errors": errors, "warnings": warnings})
        .withColumn("validation_errors", F.transform("errors", lambda e: e["message"]))
        .withColumn("is_valid", F.size("errors") == 0)
    )
