from datetime import date, datetime

from pyspark.sql import functions as F

from docket.operators import schema as S
from docket.operators import validate

AS_OF = datetime(2024, 6, 1, 12)


def record(**values):
    lists = {f.name: [] for f in S.RECORD.fields if f.dataType.typeName() == "array"}
    base = {f.name: None for f in S.RECORD.fields} | lists
    base |= {"fir_number": "F1", "crime_type": "Theft", "incident_date": date(2024, 5, 1), "description": "x"}
    return tuple((base | values)[f.name] for f in S.RECORD.fields)


def person(**values):
    names = [x.split(":")[0] for x in S.PERSON[7:-1].split(",")]
    return tuple(values.get(n) for n in names)


def place(lat, lon):
    names = [x.split(":")[0] for x in S.LOCATION[7:-1].split(",")]
    return tuple({"latitude": lat, "longitude": lon}.get(n) for n in names)


def run(spark, records):
    frame = spark.createDataFrame(records, S.RECORD).withColumn("row_id", F.monotonically_increasing_id())
    out = validate.validate(frame, F.lit(AS_OF)).orderBy("row_id").collect()
    return [([e.rule for e in r.errors], [w.rule for w in r.warnings], r) for r in out]


def test_rules_in_order(spark):
    cases = [
        (record(), [], []),
        (record(fir_number=" ", crime_type=None, incident_date=None), ["V1", "V2", "V3"], []),
        (record(incident_date=date(1899, 12, 31)), ["V5"], []),
        (record(incident_date=date(1900, 1, 1)), [], []),
        (record(incident_date=date(2024, 6, 1)), [], []),
        (record(incident_date=date(2024, 6, 2)), ["V4"], []),
        (record(report_date=datetime(2024, 4, 30, 23, 59, 59)), ["V7"], []),
        (record(report_date=datetime(2024, 5, 1)), [], []),
        (record(report_date=datetime(2024, 6, 1, 12, 0, 1)), ["V6"], []),
        (record(location=place(90.5, -181.0)), ["V8", "V9"], []),
        (record(location=place(90.0, 180.0), confidence_score=1.1), ["V10"], []),
        (record(description="  "), [], ["V11"]),
        (record(status="Shut", source_type="FAX"), ["V15", "V16"], []),
        (record(status="Open", source_type="CSV"), [], []),
        (record(victims=[person(gender="Male", role="Boss", age=151), person(age=150), person(age=0)]), ["V17", "V19"], []),
        (record(vehicles=[("a", "Bike", None, None, None, None, None)], weapons=[("Gun", None, None, None)], media=[("Film", None, None, None, None, None)]), ["V18"] * 3, []),
        (record(crime_type=None, victims=[person(name="Al"), person(name=" al "), person(name="B"), person(name="AL")]), ["V2"], ["V13", "V13"]),
        (record(officers=[person(identification_number="x1"), person(identification_number=" X1")]), [], ["V12"]),
        (record(vehicles=[("a1",) + (None,) * 6, (None,) * 7, (" A1 ",) + (None,) * 6]), [], ["V14"]),
    ]
    for (errors, warnings, row), (_, want_errors, want_warnings) in zip(run(spark, [c[0] for c in cases]), cases):
        assert (errors, warnings) == (want_errors, want_warnings)
        assert row.is_valid == (not want_errors) and len(row.validation_errors) == len(want_errors)


def test_messages_and_trimming(spark):
    _, _, row = run(spark, [record(victims=[person(name=" Al "), person(name="al")], keywords=[" k "], fir_number=" F ")])[0]
    assert row.warnings[0].message == "Compliance warning: Duplicate name 'al' found for person at index 1 in victims list."
    assert row.victims[0].name == "Al" and row.keywords == [" k "] and row.fir_number == "F"
