"""Enrichment of locations from a gazetteer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.functions.text import blank_to_null, first_filled
from docket.operators.dedup import join_known

PARTS = ("address", "locality", "area", "district", "state", "country")
#: Metres.
EARTH_RADIUS = 6_371_008.8
FILLED = ("postal_code", "district", "state", "country")


def geocode_query(location: Column) -> Column:
    return F.concat_ws(", ", *(blank_to_null(location[p]) for p in PARTS))


def lookups(records: DataFrame, location: str = "location") -> DataFrame:
    """Distinct queries of locations without coordinates: what a live geocoder would be asked, once each."""
    place = F.col(location)
    missing = place["latitude"].isNull() | place["longitude"].isNull()
    return records.where(missing).select(geocode_query(place).alias("query")).where("query <> ''").distinct()


def enrich(records: DataFrame, gazetteer: DataFrame, location: str = "location") -> DataFrame:
    """Locations without coordinates get those of `gazetteer` (query, lat, lon, address), and what else is blank.

    A gazetteer with several rows for a query counts by its smallest coordinates.
    """
    place = F.col(location)
    known = gazetteer.groupBy("query").agg(F.min(F.struct("lat", "lon", "address")).alias("_geo"))
    asked = records.withColumn(
        "_query",
        F.when(place["latitude"].isNull() | place["longitude"].isNull(), blank_to_null(geocode_query(place))),
    )
    found = join_known(asked, known.withColumnRenamed("query", "_query"), "_query")
    address = F.col("_geo.address")
    values = {
        "postal_code": address["postcode"],
        "district": first_filled(address["district"], address["county"]),
        "state": address["state"],
        "country": address["country"],
    }
    new = place
    for field in FILLED:
        new = new.withField(field, first_filled(place[field], F.coalesce(values[field], place[field])))
    new = new.withField("latitude", F.coalesce(F.col("_geo.lat"), place["latitude"]))
    new = new.withField("longitude", F.coalesce(F.col("_geo.lon"), place["longitude"]))
    return found.withColumn(location, F.when(F.col("_geo").isNull(), place).otherwise(new)).drop("_geo", "_query")


def on_sphere(lat: str, lon: str) -> dict[str, Column]:
    """Coordinates in degrees as a point of the unit sphere, where 180 degrees west and east are the same."""
    a, b = F.radians(lat), F.radians(lon)
    return {"px": F.cos(a) * F.cos(b), "py": F.cos(a) * F.sin(b), "pz": F.sin(a)}


def cells(level: int) -> list[Column]:
    """The cube of side 2 / 2 ** level that holds (px, py, pz)."""
    return [F.floor((F.col(c) + 1) * (2**level / 2)).alias(f"c{c[1]}") for c in ("px", "py", "pz")]


def nearest(points: DataFrame, gazetteer: DataFrame, level: int = 14) -> DataFrame:
    """Reverse lookup: for each of `points` (point_id, lat, lon) the nearest place of `gazetteer` (query, lat, lon, address).

    Returns (point_id, query, address, metres). Distances are great-circle ones, so every point has an answer, also
    across 180 degrees and the poles. Places are held in cubes within cubes, each cube with one of its places. Each
    distinct pair of coordinates goes down the levels, two at a time, with those cubes only that may hold a place no
    farther than the nearest seen so far; a cube's at most 64 parts are one row, so a crowded spot costs a point no more
    than any other. In the smallest cubes (780 m at level 14), distinct coordinates are compared.

    Ties go to the smaller query. Points without coordinates, or with an empty gazetteer, have null answers; places
    without coordinates are never found; repeated rows of points are each answered.
    """
    level += level % 2
    xyz, cube = ["px", "py", "pz"], ["cx", "cy", "cz"]
    known = gazetteer.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    known = known.groupBy("lat", "lon").agg(F.min("query").alias("query"), F.min_by("address", "query").alias("address"))
    known = known.select("query", "address", *(c.alias(n) for n, c in on_sphere("lat", "lon").items()))
    asked = points.select("lat", "lon").where("not isnan(lat) and not isnan(lon)").distinct()
    asked = asked.select("lat", "lon", *(c.alias(n) for n, c in on_sphere("lat", "lon").items()))
    one = F.min(F.struct(*xyz)).alias("one")
    # The sphere meets at most 125 cubes of level 2: the table of them has a fixed bound.
    first = known.groupBy(*cells(2)).agg(one).agg(F.collect_list(F.struct(*cube, "one")).alias("parts"))
    front = closer(asked.join(F.broadcast(first)).select("lat", "lon", *xyz, F.inline("parts")), 2)
    for finer in range(4, level + 1, 2):
        parts = known.groupBy(*cells(finer)).agg(one)
        parts = parts.groupBy(*(F.shiftright(c, 2).alias(f"of_{c}") for c in cube)).agg(
            F.collect_list(F.struct(*cube, "one")).alias("parts")
        )
        inside = front.join(parts, [front[c] == parts[f"of_{c}"] for c in cube])
        front = closer(inside.select("lat", "lon", *xyz, F.inline("parts")), finer)
    places = known.select(*cells(level), F.struct(*xyz).alias("one"), "query", "address")
    away = F.struct(chord("one"), "query")
    found = front.join(places, cube).groupBy("lat", "lon").agg(
        F.min_by(F.struct("query", "address"), away).alias("_place"), F.min(chord("one")).alias("_chord")
    )
    metres = 2 * EARTH_RADIUS * F.asin(F.when(F.col("_chord") < 4, F.sqrt("_chord") / 2).when(F.col("_chord") >= 4, 1.0))
    joined = points.join(found.withColumnsRenamed({"lat": "_lat", "lon": "_lon"}), (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
    return joined.select("point_id", "_place.query", "_place.address", metres.alias("metres"))


def chord(place: str) -> Column:
    """The squared straight distance of a place from (px, py, pz)."""
    return sum((F.pow(F.col(f"{place}.{c}") - F.col(c), 2) for c in ("px", "py", "pz")), F.lit(0.0))


def closer(pairs: DataFrame, level: int) -> DataFrame:
    """Those cubes of `pairs` that may hold a place no farther than the nearest of the places that are known of a point."""
    side = 2.0 / 2**level
    gaps = (
        F.greatest(F.col(f"c{c}") * side - 1 - F.col(f"p{c}"), F.col(f"p{c}") - (F.col(f"c{c}") + 1) * side + 1, F.lit(0.0))
        for c in "xyz"
    )
    least = sum((F.pow(g, 2) for g in gaps), F.lit(0.0))
    best = F.min(chord("one")).over(Window.partitionBy("lat", "lon"))
    kept = pairs.withColumns({"_least": least, "_best": best}).where(F.col("_least") <= F.col("_best") + 1e-12)
    return kept.select("lat", "lon", "px", "py", "pz", "cx", "cy", "cz")
