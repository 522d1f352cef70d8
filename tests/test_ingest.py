import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docket.functions.graph import components
from docket.functions.similarity import common_subsequence
from docket.operators import dedup, geocode, jobs, persist
from docket.operators import schema as S
from docket.plans.ingest import Ingest, page_records, reply_records, text_records
from tests.test_validate import person, place, record

CASES = "case_id long, case_number string, description string, location_id long, incident_time timestamp"


def tables(spark):
    t = datetime(2024, 1, 1)
    return {
        "cases": spark.createDataFrame([(1, "C-1", "a man stole the red bicycle from the yard", 10, t), (2, "C-2", None, 11, t), (3, "C-3", "zzz", None, t)], CASES),
        "locations": spark.createDataFrame([(10, "12 Long Street", 10.0, 20.0), (11, "Mill", 50.0, None)], "location_id long, address string, latitude double, longitude double"),
        "people": spark.createDataFrame([(2, "Ann Smith"), (2, "Bob")], "case_id long, full_name string"),
        "vehicles": spark.createDataFrame([(3, "MH 12 AB 1234")], "case_id long, registration_number string"),
        "crime_types": spark.createDataFrame([(5, "THEFT")], "crime_type_id long, crime_name string"),
        "persons": spark.createDataFrame([(7, "X1")], "person_id long, identification_mark string"),
    }


def plate(x):
    return [(x, None, None, None, None, None, None)]


RECORDS = [
    record(fir_number="C-2", case_number="C-1"),
    record(fir_number="N-1", location=place(10.0009, 20.0009)),
    record(fir_number="N-2", location=place(10.0011, 20.0011)),
    record(fir_number="N-3", description="a man stole the red bicycle from the yard"),
    record(fir_number="N-4", suspects=[person(name=" ANN smith")]),
    record(fir_number="N-5", vehicles=plate("mh 12 ab 1234")),
    record(fir_number="N-6", victims=[person(name="New", identification_number="X1"), person(name="Own")], crime_type=" theft "),
    record(fir_number="N-6", victims=[person(name="Own")]),
    record(fir_number=None, case_number=""),
    record(fir_number="N-7", location=place(50.0, 20.0), crime_type="Fraud", victims=[person(name="Q", identification_number="Y1")], incident_date=date(2024, 2, 3), incident_time="10:00:00"),
    record(fir_number="N-8", crime_type="FRAUD", victims=[person(name="Q2", identification_number="Y1")]),
]


def apart(records):
    """Records with narratives that don't resemble each other, where they would have the usual one."""
    at, usual, rng = S.RECORD.fieldNames().index("description"), record()[S.RECORD.fieldNames().index("description")], random.Random(2)
    other = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))
    return [(*r[:at], other() if r[at] == usual else r[at], *r[at + 1 :]) for r in records]


RECORDS = apart(RECORDS)


def outcomes(spark):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(RECORDS, 1)], S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields]))
    chain = Ingest(as_of=F.lit(datetime(2024, 6, 1)))
    stored = tables(spark)
    return chain, stored, chain.outcomes(frame, stored)


def test_outcomes_and_tables(spark, tmp_path):
    chain, stored, found = outcomes(spark)
    rows = {r.row_id: r for r in found.collect()}
    assert [rows[i].outcome for i in range(1, 12)] == [
        "Duplicate", "Duplicate", "Inserted", "Duplicate", "Duplicate", "Inserted", "Inserted", "Duplicate", "Invalid", "Inserted", "Inserted",
    ]
    assert (rows[1].matched_id, rows[1].confidence, rows[1].duplicate_reason) == (2, 1.0, dedup.EXACT_REASON)
    assert (rows[2].confidence, rows[2].duplicate_reason) == (0.85, "incident spatial proximity")
    assert (rows[4].confidence, rows[4].matched_id) == (0.8, 1)
    assert (rows[5].confidence, rows[5].duplicate_reason) == (0.75, "people profiles (similarity 100.0%)")
    assert (rows[6].confidence, rows[6].matched_id, rows[6].duplicate_reason) == (0.7, 3, None)
    made = chain.tables(found, stored)
    persist.commit(made, str(tmp_path), "b1")
    read = {n: persist.read_committed(spark, str(tmp_path), n).collect() for n in made}
    assert [(r.crime_type_id, r.crime_name) for r in read["crime_types"]] == [(6, "Fraud")]
    cases = sorted(read["cases"], key=lambda r: r.case_id)
    assert [(r.case_id, r.case_number, r.crime_type_id, r.title) for r in cases] == [
        (4, "N-2", 5, "Theft report (FIR N-2)"), (5, "N-5", 5, "Theft report (FIR N-5)"), (6, "N-6", 5, "theft report (FIR N-6)"),
        (7, "N-7", 6, "Fraud report (FIR N-7)"), (8, "N-8", 6, "FRAUD report (FIR N-8)"),
    ]
    assert cases[3].incident_time == datetime(2024, 2, 3, 10) and cases[0].status == "Open" and cases[0].source == "TEXT"
    assert sorted((r.person_id, r.full_name) for r in read["persons"]) == [(8, "Own"), (9, "Q")]
    assert sorted((r.case_id, r.person_id) for r in read["case_persons"]) == [(6, 7), (6, 8), (7, 9), (8, 9)]
    assert [r.registration_number for r in read["vehicles"]] == ["mh 12 ab 1234"]
    assert sorted(r.location_id for r in read["locations"]) == [12, 13]


def test_window_is_optional(spark):
    stored = tables(spark)
    frame = spark.createDataFrame([(1, *RECORDS[1])], S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields]))
    near = dedup.check_duplicates(frame, *(stored[k] for k in ("cases", "locations", "people", "vehicles")), window_days=15)
    assert not near.first().is_duplicate


def test_settling_in_order(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (5, 7), (6, 7)], "earlier long, later long")
    got = {r.id: r.kept for r in dedup.settle_in_order(pairs, spark.range(1, 9)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: True}


def test_geocoding(spark):
    rows = spark.createDataFrame([(1, place(None, None)), (2, place(1.0, 2.0))], f"i long, location {S.LOCATION}")
    rows = rows.withColumn("location", F.col("location").withField("address", F.lit("A")).withField("state", F.lit("S")))
    address = "struct<postcode:string,district:string,county:string,state:string,country:string>"
    gazetteer = spark.createDataFrame([("A, S", 5.0, 6.0, ("9", "", "Co", "T", "In"))], f"query string, lat double, lon double, address {address}")
    got = {r.i: r.location for r in geocode.enrich(rows, gazetteer).collect()}
    assert (got[1].latitude, got[1].longitude, got[1].postal_code, got[1].district, got[1].state, got[1].country) == (5.0, 6.0, "9", "Co", "S", "In")
    assert (got[2].latitude, got[2].postal_code) == (1.0, None)
    assert [r.query for r in geocode.lookups(rows).collect()] == ["A, S"]
    points = spark.createDataFrame([(1, 5.1, 6.1), (2, 9.0, 9.0)], "point_id long, lat double, lon double")
    assert [(r.point_id, r.address.postcode) for r in geocode.nearest(points, gazetteer).orderBy("point_id").collect()] == [(1, "9"), (2, "9")]


def test_nearest_place_over_the_globe(spark):
    rng = random.Random(9)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(0.0, 179.9), (89.9, 10.0), (-90.0, 0.0)]
    places += [(50 + rng.random() / 1e3, 8 + rng.random() / 1e3) for _ in range(400)] + [(10.0, 10.0), (10.0, 10.0), (None, 1.0)]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(0.0, -179.9), (88.0, -170.0), (50.0005, 8.0005)]
    points += [(10.0, 10.0), (10.0, 10.0), (None, 1.0), (50.0, 7.0), (-50.0, -172.0), (90.0, 0.0), (-90.0, 180.0)]

    def metres(a, b):
        u, v = ([math.cos(math.radians(y)) * f(math.radians(x)) for f in (math.cos, math.sin)] + [math.sin(math.radians(y))] for y, x in (a, b))
        return 2 * geocode.EARTH_RADIUS * math.asin(min(1, math.dist(u, v) / 2))

    gazetteer = spark.createDataFrame([(f"q{i}", *p, i) for i, p in enumerate(places)], "query string, lat double, lon double, address int")
    asked = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id long, lat double, lon double")
    for level in (3, 14):
        got = {r.point_id: r for r in geocode.nearest(asked, gazetteer, level).collect()}
        assert len(got) == len(points)
        for i, p in enumerate(points):
            if p[0] is None:
                assert got[i].query is None and got[i].metres is None
                continue
            least = min((metres(p, q), f"q{k}", k) for k, q in enumerate(places) if q[0] is not None)
            assert abs(got[i].metres - least[0]) < 0.5, (p, got[i], least)
            assert (got[i].query, got[i].address) == least[1:]
    none = geocode.nearest(asked, gazetteer.limit(0)).collect()
    assert len(none) == len(points) and all(r.query is None for r in none)


def test_replies_become_records(spark):
    frame = spark.createDataFrame([(1, '{"fir_number": "F", "victims": null}'), (2, "x")], "row_id long, reply string")
    got = {r.row_id: r for r in reply_records(frame).collect()}
    assert got[1].victims == [] and got[1].error is None and got[2].error == "json"


def test_jobs(spark):
    made = spark.createDataFrame([(1, "PDF"), (2, "CSV"), (3, "URL")], "job_id long, source_type string")
    results = spark.createDataFrame([(1, True, None, True), (2, False, "bad", False)], "job_id long, success boolean, error_message string, inserted boolean")
    got = {r.job_id: r for r in jobs.job_rows(made, results, F.lit(datetime(2024, 1, 1))).collect()}
    assert [got[i].processing_status for i in (1, 2, 3)] == ["Completed", "Failed", "Running"]
    assert got[1].ocr_completed and not got[2].ocr_completed and got[2].error_message == "bad"


def test_stream(spark, tmp_path):
    from docket.streaming.ingest import ingest_stream

    kind = S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields])
    spark.createDataFrame([(i, *RECORDS[i]) for i in (2, 8)], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    stored = tables(spark)
    run = ingest_stream(stream, Ingest(as_of=F.lit(datetime(2024, 6, 1))), stored, str(tmp_path / "out"), str(tmp_path / "cp"))
    run.awaitTermination(120)
    assert sorted(r.outcome for r in persist.read_committed(spark, str(tmp_path / "out"), "outcomes").collect()) == ["Inserted", "Invalid"]
    assert persist.read_committed(spark, str(tmp_path / "out"), "cases").count() == 1


def greedy(rows, pairs):
    earlier, kept, numbers, out = {}, set(), set(), {}
    for a, b in pairs:
        earlier.setdefault(b, set()).add(a)
    for i, number, seeks in sorted(rows):
        out[i] = not (set(seeks) & numbers) and not (earlier.get(i, set()) & kept)
        if out[i]:
            kept.add(i)
            numbers.add(number)
    return out


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_settling_long_chains_and_tags(spark, monkeypatch, rounds):
    monkeypatch.setattr(dedup, "ROUNDS", rounds)
    chain = [(i, i + 1) for i in range(1, 151)]
    got = {r.id: r.kept for r in dedup.settle_in_order(spark.createDataFrame(chain, "earlier long, later long"), spark.range(1, 152)).collect()}
    assert got == {i: i % 2 == 1 for i in range(1, 152)}
    rng = random.Random(rounds)
    rows = [(i, rng.choice([None, "a", "b", f"n{i}"]), rng.sample(["a", "b", "c", f"n{i - 1}"], rng.randrange(3))) for i in range(40)]
    pairs = [tuple(sorted(rng.sample(range(40), 2))) for _ in range(25)]
    seeks = [(i, x) for i, _, wanted in rows for x in wanted] + [(b, f"row{a}") for a, b in pairs]
    carries = [(i, n) for i, n, _ in rows if n] + [(a, f"row{a}") for a, _ in pairs]
    links = {(c, c) for _, c in carries}
    frames = [spark.createDataFrame(x, ddl) for x, ddl in ((seeks, "id long, s string"), (sorted(set(carries)), "id long, c string"), (sorted(links), "s string, c string"))]
    got = {r.id: r.kept for r in dedup.settle(spark.range(40), *frames).collect()}
    assert got == {i: v for i, v in greedy([(i, n or object(), s) for i, n, s in rows], pairs).items()}


def test_components(spark):
    rng = random.Random(7)
    edges = [tuple(rng.sample(range(300), 2)) for _ in range(170)] + [(500, 500)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_many_equal_values_are_one_value(spark):
    """3,000 reports with one description, address and place, and people of one name, without pairs of them."""
    said = "the same standard sentence about a stolen bicycle, as a form has it"
    one = record(description=said, location=place(1.0, 2.0), suspects=[person(name="Unknown Man")], fir_number="E")
    kind = S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields])
    frame = spark.createDataFrame([(1, *one)], kind).drop("row_id", "fir_number")
    frame = spark.range(1, 3001).select(F.col("id").alias("row_id"), F.concat(F.lit("E"), "id").alias("fir_number")).crossJoin(frame)
    got = dedup.check_batch(frame.select(*[f.name for f in kind]), persist.case_columns()).collect()
    assert [r.row_id for r in got if not r.is_duplicate] == [1] and {r.matched_id for r in got if r.is_duplicate} == {1}
    assert {r.reason for r in got if r.is_duplicate} == {
        "incident spatial proximity | narrative description (similar key similarity 100.0%) | people profiles (similarity 100.0%)"
    }


def test_best_of_facets_against_all_pairs(spark):
    """The cascade gives what comparing every record with every case over all facets gives; later facets see fewer rows."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    said, names, plates = [word(40) for _ in range(6)], [word(9) for _ in range(8)], [word(8).upper() for _ in range(6)]
    near = lambda x: x[:3] + rng.choice("xyz") + x[4:] if rng.random() < 0.5 else x

    def some():
        return {
            "description": near(rng.choice(said)) if rng.random() < 0.6 else None,
            "lat": rng.randrange(40) * 0.0008, "lon": 1.0, "address": near(word(12)) if rng.random() < 0.2 else None,
            "names": [near(rng.choice(names)) for _ in range(rng.randrange(3))], "plates": [rng.choice(plates) for _ in range(rng.randrange(2))],
        }

    records, cases = [(i, some()) for i in range(60)], [(i, some()) for i in range(100, 150)]
    t = datetime(2024, 1, 1)
    frames = (
        spark.createDataFrame([(i, f"S{i}", c["description"], i, t) for i, c in cases], CASES),
        spark.createDataFrame([(i, c["address"], c["lat"], c["lon"]) for i, c in cases], "location_id long, address string, latitude double, longitude double"),
        spark.createDataFrame([(i, n) for i, c in cases for n in c["names"]], "case_id long, full_name string"),
        spark.createDataFrame([(i, n) for i, c in cases for n in c["plates"]], "case_id long, registration_number string"),
    )
    kind = S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields])
    made = []
    for i, r in records:
        row = list(place(r["lat"], r["lon"]))
        made.append((i, *record(fir_number=f"R{i}", description=r["description"], location=tuple(row), suspects=[person(name=n) for n in r["names"]], vehicles=[plate(p)[0] for p in r["plates"]])))
    frame = spark.createDataFrame(made, kind)
    got = {r.row_id: r for r in dedup.check_duplicates(frame, *frames).collect()}
    ratio = lambda a, b: 200 * common_subsequence(a.lower(), b.lower()) / (len(a) + len(b))
    for i, r in records:
        best = (0.0, 0)
        for j, c in cases:
            score = 0.85 if abs(r["lat"] - c["lat"]) < 0.001 else 0.0
            if r["description"] and c["description"] and ratio(r["description"], c["description"]) >= 85:
                score = max(score, 0.8 * (ratio(r["description"], c["description"]) / 100))
            hits = [max((ratio(n, m) for m in c["names"]), default=0) for n in r["names"]]
            hits = [h for h in hits if h >= 80]
            score = max(score, 0.75 * (sum(hits) / len(hits) / 100) if hits else 0)
            driven = [p for p in r["plates"] if any(ratio(p, q) >= 90 for q in c["plates"])]
            if driven and 100 * len(driven) / len(r["plates"]) >= 90:
                score = max(score, 0.7)
            best = max(best, (round(score, 9), -j))
        assert (got[i].confidence, got[i].matched_id) == ((round(best[0], 4), -best[1]) if best[0] else (0.0, None)), i
    places = frames[0].select("case_id", "location_id").join(frames[1], "location_id")
    facets = dedup.facets_of(dedup.sought_values(frame, False), dedup.stored_values(frames[0], places, *frames[2:], False), dedup.DedupConfig())
    looked = dict(dedup.best_of_facets(facets, dedup.DedupConfig(), None)[1])
    assert looked["description"] < looked["spot"] and looked["vehicles"] < len([1 for _, r in records if r["plates"]]) + 1


def test_similar_records_of_one_batch(spark):
    told = "a man in a blue coat took the silver watch from the shop window at noon"
    batch = [
        record(fir_number="B-1", case_number="X-1", description=told),
        record(fir_number="B-2", description=told.replace("noon", "moon")),
        record(fir_number="B-3", case_number="B-2"),
        record(fir_number="X-1"),
        record(fir_number="B-5", location=place(33.0, 44.0)),
        record(fir_number="B-6", location=place(33.0009, 44.0)),
        record(fir_number="B-7", location=place(33.0018, 44.0)),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(apart(batch), 1)], S.T.StructType([S.T.StructField("row_id", S.T.LongType()), *S.RECORD.fields]))
    stored = tables(spark)
    del stored["people"]
    stored["case_persons"] = spark.createDataFrame([(1, 7)], "case_id long, person_id long")
    stored["persons"] = spark.createDataFrame([(7, "X1", "Zed")], "person_id long, identification_mark string, full_name string")
    rows = {r.row_id: r for r in Ingest(as_of=F.lit(datetime(2024, 6, 1))).outcomes(frame, stored).collect()}
    assert [rows[i].outcome for i in range(1, 8)] == ["Inserted", "Duplicate", "Inserted", "Duplicate", "Inserted", "Duplicate", "Inserted"]
    assert (rows[2].matched_row, rows[2].matched_id) == (1, None) and rows[2].confidence > 0.75
    assert rows[2].duplicate_reason.startswith("narrative description")
    assert (rows[4].matched_row, rows[4].confidence, rows[4].duplicate_reason) == (1, 1.0, dedup.EXACT_REASON)
    assert (rows[6].matched_row, rows[6].confidence) == (5, 0.85)


def test_replies_with_wrong_values_at_any_depth(spark):
    good = '{"fir_number": "F", "victims": [{"name": "A", "age": 3, "gender": "Male", "role": "Victim"}]}'
    bad = ['"age": "x"', '"age": 151', '"age": -1', '"gender": "M"', '"role": "Hero"']
    replies = [good, *(good.replace('"age": 3', b, 1) if "age" in b else good.replace('"gender": "Male"', b) if "gender" in b else good.replace('"role": "Victim"', b) for b in bad)]
    replies += ['{"confidence_score": 1.5}', '{"location": {"latitude": "north"}}', '{"location": {"latitude": 91}}', '{"incident_date": "soon"}', '{"weapons": [{"recovered": "perhaps"}]}']
    frame = spark.createDataFrame(list(enumerate(replies)), "row_id long, reply string")
    got = {r.row_id: r for r in reply_records(frame).collect()}
    assert got[0].error is None and got[0].victims[0].age == 3
    assert [got[i].error for i in range(1, len(replies))] == ["schema"] * (len(replies) - 1)
    assert all(r.victims == [] and r.fir_number is None for i, r in got.items() if i)


def test_pages_and_texts_become_records(spark):
    def reply(texts):
        return texts.select("row_id", F.when(F.length("text") > 3, F.to_json(F.struct(F.col("text").alias("fir_number")))).otherwise("{").alias("reply"))

    pages = spark.createDataFrame([(1, "http://a/b", "<article><p>Report 9</p></article>"), (2, "x", "<p>t</p>"), (3, "http://a/c", "")], "row_id long, url string, html string")
    got = {r.row_id: r for r in page_records(pages, reply).collect()}
    assert (got[1].error, got[1].fir_number, got[1].source_type, got[1].source_url, got[1].extracted_text) == (None, "Report 9", "URL", "http://a/b", "Report 9")
    assert got[2].error == "no scheme or host" and got[3].error == "no text could be extracted" and got[3].victims == []
    texts = spark.createDataFrame([(1, "Report"), (2, "abc"), (3, " ")], "row_id long, text string")
    assert {r.row_id: (r.error, r.fir_number, r.source_type) for r in text_records(texts, reply).collect()} == {1: (None, "Report", "TEXT"), 2: ("json", None, "TEXT"), 3: ("no text", None, "TEXT")}
