"""Duplicates of stored cases and within a batch: exact keys first, then weighted facets of similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docket.functions.graph import components
from docket.functions.lineage import written
from docket.functions.similarity import common_subsequence, indel_ratio, similar_strings
from docket.functions.text import blank_to_null, strip


@dataclass(frozen=True)
class DedupConfig:
    """Thresholds in percent; weights; the least confidence of a duplicate; the tolerance of coordinates in degrees."""

    description: float = 85.0
    people: float = 80.0
    vehicles: float = 90.0
    address: float = 80.0
    least: float = 0.75
    degrees: float = 0.001
    weights: tuple[float, float, float, float] = (0.85, 0.80, 0.75, 0.70)


EXACT_REASON = "Exact match on case number / FIR identifier."


def exact_matches(records: DataFrame, cases: DataFrame) -> DataFrame:
    """`records` (fir_number, case_number, ...) with `matched_id`: the case stored under the FIR number, else the case number."""
    stored = cases.where("case_number <> ''").groupBy("case_number").agg(F.min("case_id").alias("_id"))
    found = join_known(records, stored.withColumnsRenamed({"case_number": "fir_number", "_id": "_by_fir"}), "fir_number")
    found = join_known(found, stored.withColumnRenamed("_id", "_by_case"), "case_number")
    return found.withColumn("matched_id", F.coalesce("_by_fir", "_by_case")).drop("_by_fir", "_by_case")


def coordinate_pairs(left: DataFrame, right: DataFrame, degrees: float) -> DataFrame:
    """(a_id, b_id) whose coordinates differ by less than `degrees` on both axes. Inputs have id, lat, lon.

    Cells are twice the tolerance, so that rounding can't skip a neighbour.
    """
    size = 2 * degrees

    def around(c: str) -> Column:
        return F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(c) / size) + k))

    a = left.where("lat is not null and lon is not null").select(F.col("id").alias("a_id"), "lat", "lon")
    a = a.withColumn("x", around("lat")).withColumn("y", around("lon"))
    b = right.where("lat is not null and lon is not null")
    b = b.select(
        F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
        F.floor(F.col("lat") / size).alias("x"), F.floor(F.col("lon") / size).alias("y"),
    )
    near = (F.abs(F.col("lat") - F.col("b_lat")) < degrees) & (F.abs(F.col("lon") - F.col("b_lon")) < degrees)
    return a.join(b, ["x", "y"]).where(near).select("a_id", "b_id")


def people_scores(incoming: DataFrame, stored: DataFrame, percent: float) -> DataFrame:
    """(a_id, b_id, score): mean, over names of `incoming` (id, name) with a match, of the best ratio to names of `stored`.

    Names repeat in `incoming` as often as they stand there; `stored` is a set for each case.
    """
    a = incoming.select(F.col("id").alias("a_id"), F.lower(strip(F.col("name"))).alias("a"))
    a = a.groupBy("a_id", "a").agg(F.count("*").alias("times"))
    b = stored.select(F.col("id").alias("b_id"), F.lower(strip(F.col("name"))).alias("b")).distinct()
    similar = similar_strings(a, b, percent)
    best = a.join(similar, "a").join(b, "b").groupBy("a_id", "b_id", "a").agg(F.max("ratio").alias("best"), F.first("times").alias("times"))
    return best.groupBy("a_id", "b_id").agg((F.sum(F.col("best") * F.col("times")) / F.sum("times")).alias("score"))


def vehicle_scores(incoming: DataFrame, stored: DataFrame, percent: float) -> DataFrame:
    """(a_id, b_id, score): percentage of plates of `incoming` (id, plate), repeats counted, that `stored` has or resembles."""
    a = incoming.where("plate <> ''").select(F.col("id").alias("a_id"), F.upper(strip(F.col("plate"))).alias("a"))
    a = a.groupBy("a_id", "a").agg(F.count("*").alias("times"))
    total = a.groupBy("a_id").agg(F.sum("times").alias("total"))
    b = stored.where("plate <> ''").select(F.col("id").alias("b_id"), F.upper(strip(F.col("plate"))).alias("b")).distinct()
    hit = a.join(similar_strings(a, b, percent), "a").join(b, "b").select("a_id", "b_id", "a", "times").distinct()
    counted = hit.groupBy("a_id", "b_id").agg(F.sum("times").alias("hits")).join(total, "a_id")
    return counted.select("a_id", "b_id", (F.col("hits") / F.col("total") * 100.0).alias("score"))


def confidence(scores: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """Pairs (a_id, b_id, near boolean, description, people, vehicles) with `confidence` and `reason`.

    A facet below its threshold counts for nothing; the best facet counts alone.
    """
    w = config.weights
    facets = [F.when(F.col("near"), F.lit(w[0]))]
    said = [F.when(F.col("near"), F.lit("incident spatial proximity"))]
    for weight, name, least, text in (
        (w[1], "description", config.description, "narrative description (similar key similarity %.1f%%)"),
        (w[2], "people", config.people, "people profiles (similarity %.1f%%)"),
        (w[3], "vehicles", config.vehicles, "vehicle listing (similarity %.1f%%)"),
    ):
        enough = F.col(name) >= least
        facets.append(F.when(enough, weight * (F.col(name) / 100.0)))
        said.append(F.when(enough, F.format_string(text, F.col(name).cast("double"))))
    return scores.withColumn("confidence", F.coalesce(F.greatest(*facets), F.lit(0.0))).withColumn(
        "reason", F.concat_ws(" | ", *said)
    )


def best_matches(pairs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """(a_id, is_duplicate, confidence, matched_id, reason): the best pair of each record, on ties the smallest case."""
    best = (
        pairs.where("confidence > 0")
        .groupBy("a_id")
        .agg(F.max_by(F.struct("confidence", "b_id", "reason"), F.struct(F.col("confidence"), -F.col("b_id"))).alias("best"))
    )
    duplicate = F.col("best.confidence") >= config.least
    return best.select(
        "a_id",
        duplicate.alias("is_duplicate"),
        F.round("best.confidence", 4).alias("confidence"),
        F.col("best.b_id").alias("matched_id"),
        F.when(duplicate, F.col("best.reason")).alias("reason"),
    )


def people_of_cases(case_persons: DataFrame, persons: DataFrame) -> DataFrame:
    """(case_id, full_name): the people that are linked to each case."""
    return case_persons.join(persons.select("person_id", "full_name"), "person_id").select("case_id", "full_name")


#: Facets, with the place of their weight in DedupConfig.weights.
FACETS = {"spot": 0, "address": 0, "description": 1, "people": 2, "vehicles": 3}


def point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def lowered(text: Column) -> Column:
    return F.when(text != "", F.lower(text))


def filled(items: Column) -> Column:
    """A list in order, or null if nothing is in it."""
    found = F.array_sort(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(found) > 0, found)


def sought_values(records: DataFrame, dated: bool) -> DataFrame:
    """(id, day, and a column for each facet) of `records` (row_id and a record): a point, a lower-cased text, or a sorted list."""
    where = F.col("location")
    names = F.transform(F.concat("victims", "suspects"), lambda p: F.lower(strip(blank_to_null(p["name"]))))
    plates = F.transform(F.filter("vehicles", lambda v: v["registration_number"] != ""), lambda v: F.upper(strip(v["registration_number"])))
    return records.select(
        F.col("row_id").alias("id"), day_of(F.col("incident_date"), dated), point(where["latitude"], where["longitude"]).alias("spot"),
        lowered(where["address"]).alias("address"), lowered(F.col("description")).alias("description"),
        filled(names).alias("people"), plates_of(plates).alias("vehicles"),
    )


def plates_of(plates: Column) -> Column:
    return F.when(F.size(plates) > 0, F.array_sort(plates))


def day_of(day: Column, dated: bool) -> Column:
    return (day if dated else F.lit(None).cast("date")).alias("day")


def batch_values(records: DataFrame, columns: dict[str, Column], dated: bool) -> DataFrame:
    """sought_values() as the same records would carry them if they were stored."""
    where = F.col("location")
    everyone = F.transform(F.concat("victims", "suspects", "witnesses", "officers"), lambda p: p["name"])
    everyone = F.array_distinct(F.transform(F.filter(everyone, lambda n: n != ""), lambda n: F.lower(strip(n))))
    plates = F.transform(F.filter("vehicles", lambda v: v["registration_number"] != ""), lambda v: F.upper(strip(v["registration_number"])))
    return records.select(
        F.col("row_id").alias("id"), day_of(F.to_date(columns["incident_time"]), dated),
        point(where["latitude"].cast("decimal(10,8)"), where["longitude"].cast("decimal(11,8)")).alias("spot"),
        lowered(where["address"]).alias("address"), lowered(columns["description"]).alias("description"),
        plates_of(everyone).alias("people"), plates_of(F.array_distinct(plates)).alias("vehicles"),
    )


def stored_values(cases: DataFrame, places: DataFrame, people: DataFrame, vehicles: DataFrame, dated: bool) -> dict[str, DataFrame]:
    """What stored cases carry, for each facet (id, day, value). `places` has (case_id, address, latitude, longitude)."""

    def of(df: DataFrame, value: Column) -> DataFrame:
        return df.select(F.col("case_id").alias("id"), value.alias("value")).where("value is not null")

    def listed(df: DataFrame, value: Column) -> DataFrame:
        return of(df, value).groupBy("id").agg(F.array_sort(F.collect_set("value")).alias("value"))

    name, number = F.col("full_name"), F.col("registration_number")
    found = {
        "spot": of(places, point(F.col("latitude"), F.col("longitude"))),
        "address": of(places, lowered(F.col("address"))),
        "description": of(cases, lowered(F.col("description"))),
        "people": listed(people, F.when(name != "", F.lower(strip(name)))),
        "vehicles": listed(vehicles, F.when(number != "", F.upper(strip(number)))),
    }
    if not dated:
        return {k: df.select("id", day_of(F.lit(None), False), "value") for k, df in found.items()}
    days = cases.select(F.col("case_id").alias("id"), F.to_date("incident_time").alias("day"))
    return {k: df.join(days, "id").select("id", "day", "value") for k, df in found.items()}


def facets_of(sought: DataFrame, carried: DataFrame | dict[str, DataFrame], config: DedupConfig) -> list[Facet]:
    """The facets that some record seeks, by falling weight."""
    some = sought.agg(*(F.count(name).alias(name) for name in FACETS)).first()

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", "day", F.col(name).alias("value")).where("value is not null")

    found = [
        Facet(name, config.weights[i], side(sought, name), carried[name] if isinstance(carried, dict) else side(carried, name))
        for name, i in FACETS.items()
        if some[name]
    ]
    return sorted(found, key=lambda f: -f.weight)


@dataclass
class Facet:
    """One way of being similar: values that records seek and cases carry (id, day, value), and the confidence of a full match."""

    name: str
    weight: float
    sought: DataFrame
    carried: DataFrame

    def links(self, config: DedupConfig, window_days: int | None, sought: DataFrame | None = None) -> DataFrame:
        """(s, c, confidence) of similar keys, which are (value, day) as structs.

        Values are compared once each, however many records seek or cases carry them. Days differ by at most `window_days`;
        without it, values have no day (`dated` is false) and are keys by themselves.
        """
        sides = (self.sought if sought is None else sought, self.carried)
        a, b = (df.select(F.col("value").alias(c)).distinct() for df, c in zip(sides, "ab"))
        full = F.lit(self.weight)
        if self.name == "spot":
            points = [v.select(F.col(c).alias("id"), F.col(f"{c}.lat").alias("lat"), F.col(f"{c}.lon").alias("lon")) for v, c in ((a, "a"), (b, "b"))]
            similar = coordinate_pairs(*points, config.degrees).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), full.alias("confidence"))
        elif self.name == "address":
            similar = similar_strings(a, b, config.address).where(F.col("ratio") > config.address).select("a", "b", full.alias("confidence"))
        elif self.name == "description":
            similar = similar_strings(a, b, config.description).select("a", "b", (full * (F.col("ratio") / 100.0)).alias("confidence"))
        else:
            item = {"people": "name", "vehicles": "plate"}[self.name]
            lists = [v.select(F.col(c).alias("id"), F.explode(c).alias(item)) for v, c in ((a, "a"), (b, "b"))]
            least = getattr(config, self.name)
            scores = {"people": people_scores, "vehicles": vehicle_scores}[self.name](*lists, least).where(F.col("score") >= least)
            similar = scores.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (full * (F.col("score") / 100.0)).alias("confidence"))
        if window_days is None:
            key = lambda c: F.struct(F.col(c).alias("value"), F.lit(None).cast("date").alias("day"))
            return similar.select(key("a").alias("s"), key("b").alias("c"), "confidence")
        one, two = (df.select(F.struct("value", "day").alias("k")).distinct().select("k", "k.value") for df in sides)
        found = one.select(F.col("k").alias("s"), F.col("value").alias("a")).join(similar, "a")
        found = found.join(two.select(F.col("k").alias("c"), F.col("value").alias("b")), "b").select("s", "c", "confidence")
        apart = F.abs(F.datediff("s.day", "c.day"))
        return found.where(apart.isNull() | (apart <= window_days))


def best_of_facets(facets: list[Facet], config: DedupConfig, window_days: int | None) -> tuple[DataFrame | None, list[tuple[str, int]]]:
    """(id, confidence, matched_id): each record's best case over all facets, the smallest on ties; and rows that each facet looked at.

    None if there is nothing to compare.

    Facets are taken by falling weight, which is the most that a facet can give. A record leaves as soon as its best is
    more than the next weight; one that equals it stays, as a case with a smaller id may give as much. Of the cases
    that carry a value, only the smallest matters; so what is joined are values, never pairs of records and cases.
    """
    best, looked = None, []
    for f in facets:
        sought = f.sought if best is None else f.sought.join(best.where(F.col("confidence") > f.weight).select("id"), "id", "left_anti")
        sought = written(sought.select("id", F.struct("value", "day").alias("s")), f"{f.name}-open")
        looked.append((f.name, sought.count()))
        if not looked[-1][1] or f.carried.isEmpty():
            continue
        links = f.links(config, window_days, sought.select("s.value", "s.day"))
        first = f.carried.groupBy(F.struct("value", "day").alias("c")).agg(F.min("id").alias("matched_id"))
        top = links.join(first, "c").groupBy("s").agg(highest("confidence", "matched_id").alias("top"))
        found = sought.join(top, "s").select("id", "top.confidence", "top.matched_id")
        both = found if best is None else best.union(found)
        best = written(both.groupBy("id").agg(highest("confidence", "matched_id").alias("top")).select("id", "top.*"), "best")
    return best, looked


def highest(confidence: str, matched: str) -> Column:
    return F.max_by(F.struct(confidence, matched), F.struct(F.col(confidence), -F.col(matched)))


def side_by_side(carried: dict[str, DataFrame]) -> DataFrame:
    """stored_values() as one table: a row for each case and facet (id, day, and a column for each facet, null but for its own)."""
    kinds = {name: df.schema["value"].dataType for name, df in carried.items()}
    parts = [
        df.select("id", "day", *(F.col("value").alias(c) if c == name else F.lit(None).cast(kinds[c]).alias(c) for c in FACETS))
        for name, df in carried.items()
    ]
    return reduce(DataFrame.union, parts)


def explained(matches: DataFrame, sought: DataFrame, carried: DataFrame, config: DedupConfig) -> DataFrame:
    """`matches` (id, matched_id) with confidence and reason, which names all facets that are similar: a pair for each record.

    `carried` has one or more rows for each case, with a column for each facet.
    """
    pairs = matches.join(sought.select("id", *(F.col(c).alias(f"a_{c}") for c in FACETS)), "id")
    pairs = pairs.join(carried.select(F.col("id").alias("matched_id"), *(F.col(c).alias(f"b_{c}") for c in FACETS)), "matched_id")
    a, b = ({c: F.col(f"{side}_{c}") for c in FACETS} for side in "ab")
    spot = (F.abs(a["spot"]["lat"] - b["spot"]["lat"]) < config.degrees) & (F.abs(a["spot"]["lon"] - b["spot"]["lon"]) < config.degrees)
    near = F.coalesce(spot, F.lit(False)) | F.coalesce(indel_ratio(a["address"], b["address"]) > config.address, F.lit(False))
    scored = pairs.select(
        F.col("id").alias("a_id"), F.col("matched_id").alias("b_id"), near.alias("near"), indel_ratio(a["description"], b["description"]).alias("description"),
        people_score(a["people"], b["people"], F.lit(config.people)).alias("people"), plate_score(a["vehicles"], b["vehicles"], F.lit(config.vehicles)).alias("vehicles"),
    )
    scored = scored.groupBy("a_id", "b_id").agg(*(F.max(c).alias(c) for c in ("near", "description", "people", "vehicles")))
    return confidence(scored, config).select(F.col("a_id").alias("id"), F.col("b_id").alias("matched_id"), "confidence", "reason")


def best_ratio(x: str, others: list[str]) -> float:
    return max((200 * common_subsequence(x, y) / (len(x) + len(y)) for y in others if x and y), default=0.0)


@F.pandas_udf(T.DoubleType())
def people_score(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """people_scores() of one record's and one case's names."""
    out = []
    for x, y, least in zip(a, b, percent):
        best = [r for r in (best_ratio(n, y) for n in x) if r >= least] if x is not None and y is not None else []
        out.append(sum(best) / len(best) if best else None)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def plate_score(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """vehicle_scores() of one record's and one case's plates."""
    out = []
    for x, y, least in zip(a, b, percent):
        hits = sum(best_ratio(p, y) >= least for p in x) if x is not None and y is not None else 0
        out.append(hits / len(x) * 100.0 if hits else None)
    return pd.Series(out, dtype="float64")


def check_duplicates(
    records: DataFrame, cases: DataFrame, locations: DataFrame, people: DataFrame, vehicles: DataFrame,
    config: DedupConfig = DedupConfig(), window_days: int | None = None, numbers: DataFrame | None = None,
) -> DataFrame:
    """(row_id, is_duplicate, confidence, matched_id, reason) of `records` (row_id and a record) against stored tables.

    `people` has (case_id, full_name), `vehicles` (case_id, registration_number). Exact keys decide first; only the
    others are compared. `window_days` keeps pairs whose incidents are that near in time. `numbers` (case_id, case_number) may
    be the part of the cases that an index gives for the records' keys.
    """
    keyed = exact_matches(records, cases if numbers is None else numbers)
    exact = keyed.where("matched_id is not null").select(
        "row_id", F.lit(True).alias("is_duplicate"), F.lit(1.0).alias("confidence"), "matched_id", F.lit(EXACT_REASON).alias("reason")
    )
    rest = keyed.where("matched_id is null").drop("matched_id")
    places = cases.select("case_id", "location_id").join(locations, "location_id")
    sought = written(sought_values(rest, window_days is not None), "sought")
    carried = written(side_by_side(stored_values(cases, places, people, vehicles, window_days is not None)), "carried")
    best, _ = best_of_facets(facets_of(sought, carried, config), config, window_days)
    found = exact
    if best is not None:
        said = explained(best.select("id", "matched_id"), sought, carried, config)
        fuzzy = best_matches(said.select(F.col("id").alias("a_id"), F.col("matched_id").alias("b_id"), "confidence", "reason"), config)
        found = exact.unionByName(fuzzy.withColumnRenamed("a_id", "row_id"))
    return records.select("row_id").join(found, "row_id", "left").select(
        "row_id",
        F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "matched_id",
        "reason",
    )


def check_batch(records: DataFrame, columns: dict[str, Column], config: DedupConfig = DedupConfig(), window_days: int | None = None) -> DataFrame:
    """(row_id, is_duplicate, confidence, matched_id, reason) of `records` taken one after the other, by row_id.

    Each is compared with the earlier ones that were no duplicates, as if these were stored: `columns` give a stored case's
    case_number, description and incident_time from a record. matched_id is the row_id of an earlier record. Records meet
    through the values they have in common or similar ones, so equal values of very many records are one value.
    """
    dated = window_days is not None
    sought, carried = sought_values(records, dated), batch_values(records, columns, dated)
    facets = facets_of(sought, carried, config)
    # values as tags: what rows seek, what they carry, and which of the two go together
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), F.sha2(F.to_json(F.struct(F.col(c).alias("k"))), 256))
    seeks, carries, links = [], [], []
    for f in facets:
        if f.weight < config.least:
            continue
        enough = f.links(config, window_days).where(F.col("confidence") >= config.least)
        links.append(enough.select(tag(f.name, "s").alias("s"), tag(f.name, "c").alias("c"), "confidence"))
        for df, out, name in ((f.sought, seeks, "s"), (f.carried, carries, "c")):
            key = F.struct("value", "day")
            out.append(df.select("id", key.alias("k")).select("id", tag(f.name, "k").alias(name)))
    number = blank_to_null(columns["case_number"])
    numbers = F.explode(F.filter(F.array_distinct(F.array("fir_number", "case_number")), lambda x: x.isNotNull() & (x != "")))
    own = records.select(F.col("row_id").alias("id"), number.alias("c")).where("c is not null").withColumn("c", F.concat(F.lit("number:"), "c"))
    asked = records.select(F.col("row_id").alias("id"), numbers.alias("s")).withColumn("s", F.concat(F.lit("number:"), "s"))
    same = asked.select("s", F.col("s").alias("c"), F.lit(1.0).alias("confidence")).distinct().join(own.select("c").distinct(), "c", "left_semi")
    links = written(reduce(DataFrame.union, links, same.select("s", "c", "confidence")), "links")
    linked = links.select("s").distinct(), links.select("c").distinct()
    seeks = written(reduce(DataFrame.union, seeks, asked).distinct().join(linked[0], "s", "left_semi"), "seeks")
    carries = written(reduce(DataFrame.union, carries, own).distinct().join(linked[1], "c", "left_semi"), "carries")
    kept = written(settle(records.select(F.col("row_id").alias("id")), seeks, carries, links.select("s", "c")), "kept")
    gone = kept.where("not kept").select("id")
    first = carries.join(kept.where("kept").select("id"), "id", "left_semi").groupBy("c").agg(F.min("id").alias("matched_id"))
    reached = links.join(first, "c").select("s", "confidence", "matched_id")
    best = seeks.join(gone, "id", "left_semi").join(reached, "s").where("matched_id < id").groupBy("id").agg(highest("confidence", "matched_id").alias("top"))
    best = written(best.select("id", "top.*"), "best")
    exact = best.join(asked, "id").join(first.withColumnRenamed("c", "s"), ["s", "matched_id"]).groupBy("id").agg(F.min("matched_id").alias("matched_id"))
    exact = exact.select("id", F.lit(1.0).alias("confidence"), "matched_id", F.lit(EXACT_REASON).alias("reason"))
    told = explained(best.select("id", "matched_id").join(exact.select("id"), "id", "left_anti"), sought, carried, config)
    found = exact.unionByName(told.withColumn("confidence", F.round("confidence", 4)))
    return kept.select("id", "kept").join(found, "id", "left").select(
        F.col("id").alias("row_id"),
        (~F.col("kept")).alias("is_duplicate"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "matched_id",
        "reason",
    )


def join_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join of `rows` with `known` on `key`. Rows without a key stay out of the shuffle, where they'd all meet."""
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema.fields if f.name != key]
    return rows.where(F.col(key).isNotNull()).join(known, key, "left").unionByName(rows.where(F.col(key).isNull()).select("*", *added))


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """`rows` with `matched_id`: the smallest `order` of an earlier row with the same key, or null. Null keys never match.

    Keys are hashed and summed up before rows meet, so that a key with very many rows is one row of the sums.
    """
    keyed = rows.withColumn("_key", F.sha2(key.cast("binary"), 256))
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").drop("_n")
    return join_known(keyed, first, "_key").withColumn("matched_id", F.when(F.col("_first") < F.col(order), F.col("_first"))).drop("_key", "_first")


#: Rounds in which whole groups are settled together, before what is left goes by connected component.
ROUNDS = 2


def settle(rows: DataFrame, seeks: DataFrame, carries: DataFrame, links: DataFrame) -> DataFrame:
    """(id, kept): the outcome of taking `rows` (id) in order, and dropping each that seeks what an earlier kept one carries.

    Rows seek (id, s) and carry (id, c); `links` (s, c) tell what goes together. A row's own tags don't count against it.

    First, in ROUNDS rounds: rows that nothing open and earlier can drop are kept, and rows that these drop go. That
    settles groups of any size around one row. What is left are chains; they are cut into connected components, each
    of which one task reads in order of id, holding no more than the tags of its kept rows. The number of Spark rounds grows
    with the logarithm of the longest chain. Components need time in proportion to their rows; rows of others don't wait.
    """
    left, settled = written(rows.select("id").distinct(), "open"), []

    def dropped(by: DataFrame, open_rows: DataFrame) -> DataFrame:
        first = carries.join(by, "id", "left_semi").groupBy("c").agg(F.min("id").alias("first"))
        reach = links.join(first, "c").groupBy("s").agg(F.min("first").alias("first"))
        return seeks.join(open_rows, "id", "left_semi").join(reach, "s").where("first < id").select("id").distinct()

    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        free = written(left.join(dropped(left, left), "id", "left_anti"), "free")
        gone = dropped(free, left)
        settled.append(written(free.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False))), "settled"))
        left = written(left.join(settled[-1], "id", "left_anti"), "open")
    if not left.isEmpty():
        settled.append(in_components(left, seeks, carries, links))
    empty = rows.sparkSession.createDataFrame([], "id long, kept boolean")
    return reduce(DataFrame.union, settled, empty)


def in_components(rows: DataFrame, seeks: DataFrame, carries: DataFrame, links: DataFrame) -> DataFrame:
    """settle(), each connected component of rows and tags in one task."""
    sought = written(seeks.join(rows, "id", "left_semi").join(links, "s").select("id", "c").distinct(), "sought")
    carried = written(carries.join(rows, "id", "left_semi").select("id", "c").distinct(), "carried")
    hubs = carried.groupBy("c").agg(F.min("id").alias("hub"))
    edges = sought.join(hubs, "c").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    edges = edges.union(carried.join(hubs, "c").select(F.col("id").alias("a"), F.col("hub").alias("b")))
    roots = components(edges)
    one = sought.groupBy("id").agg(F.collect_list("c").alias("seeks"))
    two = carried.groupBy("id").agg(F.collect_list("c").alias("carries"))
    line = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).join(one, "id", "left").join(two, "id", "left")
    line = line.repartition("root").sortWithinPartitions("root", "id").select("root", "id", "seeks", "carries")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = None, set()
        for batch in batches:
            stays = []
            for root, own, wanted, has in zip(*(c.to_pylist() for c in batch.columns)):
                if root != current:
                    current, kept = root, set()
                stays.append(kept.isdisjoint(wanted or ()))
                if stays[-1]:
                    kept.update(has or ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(stays, pa.bool_())], ["id", "kept"])

    return line.mapInArrow(take, "id long, kept boolean")


def settle_in_order(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, kept): settle() of rows (id) of which `pairs` (earlier, later) are similar."""
    near = pairs.where("earlier < later").select("earlier", "later").distinct()
    seeks = near.select(F.col("later").alias("id"), F.col("earlier").cast("string").alias("s"))
    carries = near.select(F.col("earlier").alias("id"), F.col("earlier").cast("string").alias("c")).distinct()
    tags = carries.select(F.col("c").alias("s"), "c").distinct()
    return settle(rows, written(seeks, "seeks"), written(carries, "carries"), written(tags, "links"))
