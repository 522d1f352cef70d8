"""Tabular reports: reading files as strings, header and cell normalisation, rows as records."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.text import blank_to_null, clean_cell
from docket.operators import schema as S

#: Canonical columns, and the headers (lower case, single spaces) that mean them.
HEADERS = {
    "fir_number": ("fir no", "fir number", "fir no.", "fir_no", "first information report number"),
    "case_number": ("case no", "case number", "case no.", "case_no"),
    "crime_type": ("crime type", "crime_type", "type of crime", "offence type", "offense type", "nature of crime"),
    "crime_category": ("crime category", "crime_category", "category"),
    "ipc_sections": ("ipc section", "ipc sections", "ipc_section", "section"),
    "bns_sections": ("bns section", "bns sections", "bns_section"),
    "status": ("status", "case status", "investigation status"),
    "incident_date": (
        "date",
        "incident date",
        "incident_date",
        "date of incident",
        "date of occurrence",
        "occurrence date",
        "date of crime",
    ),
    "incident_time": ("time", "incident time", "incident_time", "time of incident"),
    "report_date": ("report date", "report_date", "date reported", "date of report", "date of filing"),
    "address": ("address", "location", "place of occurrence", "place of incident"),
    "locality": ("locality",),
    "area": ("area",),
    "police_station": ("police station", "police_station", "ps", "thana"),
    "district": ("district", "dist"),
    "state": ("state",),
    "country": ("country",),
    "postal_code": ("pin", "pincode", "postal code", "zip"),
    "zone": ("zone",),
    "landmark": ("landmark",),
    "victim_name": ("victim name", "victim_name", "name of victim"),
    "victim_age": ("victim age", "victim_age"),
    "victim_gender": ("victim gender", "victim_gender"),
    "victim_address": ("victim address", "victim_address"),
    "victim_phone": ("victim phone", "victim_phone"),
    "suspect_name": ("suspect name", "suspect_name", "accused name", "accused_name", "name of accused"),
    "suspect_age": ("suspect age", "suspect_age"),
    "suspect_gender": ("suspect gender", "suspect_gender"),
    "suspect_address": ("suspect address", "suspect_address"),
    "officer_name": ("officer name", "officer_name", "investigating officer", "io name"),
    "officer_rank": ("officer rank", "officer_rank"),
    "officer_badge": ("badge number", "badge no"),
    "description": ("description", "details", "incident details", "crime details"),
    "modus_operandi": ("modus operandi", "modus_operandi", "mo"),
    "motive": ("motive",),
    "remarks": ("remarks", "notes", "comments"),
    "weapon_type": ("weapon", "weapon type", "weapon_type", "weapon used", "arms used"),
    "vehicle_registration": ("vehicle", "vehicle number", "vehicle no", "registration number"),
    "vehicle_type": ("vehicle type", "vehicle_type"),
}
REQUIRED = ("fir_number", "crime_type", "incident_date")
#: Encodings in the order they are tried, and file extensions.
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252", "ascii")
EXTENSIONS = (".csv", ".xlsx", ".xls")
#: What Spark calls encodings. It knows no cp1252, which is never reached, as latin-1 decodes any bytes.
CHARSETS = {"utf-8-sig": "utf-8", "latin-1": "iso-8859-1", "ascii": "us-ascii"}
ALIASES = {alias: name for name, listed in HEADERS.items() for alias in listed}


def canonical(header: str, aliases: dict[str, str] = ALIASES) -> str:
    """A header's canonical name, or its own in snake case."""
    tidy = " ".join(header.split())
    return aliases.get(tidy.lower()) or re.sub(r"[^a-zA-Z0-9]+", "_", tidy).strip("_").lower()


def normalise_headers(df: DataFrame, aliases: dict[str, str] = ALIASES) -> tuple[DataFrame, list[str]]:
    """Columns under canonical names, and warnings. Of several headers with one name, the first filled cell counts."""
    places: dict[str, list[str]] = {}
    for i, c in enumerate(df.columns):
        places.setdefault(canonical(c, aliases) or f"column_{i}", []).append(f"_{i}")
    numbered = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    merged = [F.coalesce(*(blank_to_null(F.col(x)) for x in own)) if own[1:] else F.col(own[0]) for own in places.values()]
    warnings = [f"{len(own)} columns are named '{name}'" for name, own in places.items() if own[1:]]
    return numbered.select(*(c.alias(name) for c, name in zip(merged, places))), warnings


def missing_columns(df: DataFrame, needed: Iterable[str] = REQUIRED) -> list[str]:
    return sorted(set(needed) - set(df.columns))


def clean_cells(df: DataFrame) -> DataFrame:
    """Every string cell trimmed, its white space collapsed, and stand-ins for missing values as null."""
    return df.select(*(clean_cell(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def file_traits(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, multi_line) of each file with content: the first of ENCODINGS that decodes all of it.

    Files are read in ranges, by many tasks. A line end is no part of another UTF-8 character and starts afresh, so a
    file is UTF-8 if each of its lines is, whichever task has it; any other file is latin-1, as that decodes all bytes. multi_line: some line
    has an odd number of quotes, so a quoted cell goes on in the next one.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    quotes = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    found = lines.groupBy("path").agg(F.bool_and(F.call_function("is_valid_utf8", F.col("value"))).alias("utf8"), F.bool_or(quotes).alias("multi_line"))
    return found.select("path", F.when(F.col("utf8"), ENCODINGS[0]).otherwise(ENCODINGS[2]).alias("encoding"), "multi_line")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A file or folder of CSV with a header, all columns as strings. Malformed rows fail the read.

    Files are read by encoding; the columns of the first encoding's files count, by name. Files without a quoted line
    end are read in ranges, others by a task each.
    """
    if encoding is not None:
        return csv_of(spark, [path], encoding, True)
    kinds: dict[tuple[str, bool], list[str]] = {}
    for r in file_traits(spark, path).orderBy("path").collect():
        kinds.setdefault((r.encoding, r.multi_line), []).append(unquote(r.path))
    parts = [csv_of(spark, files, *kind) for kind, files in kinds.items()] or [csv_of(spark, [path], "utf-8", False)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def csv_of(spark: SparkSession, paths: list[str], encoding: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return reader.option("mode", "FAILFAST").option("encoding", CHARSETS.get(encoding, encoding)).csv(paths)


def first_sheet(z: zipfile.ZipFile) -> str:
    """The part that holds the sheet which stands first in the workbook's own order."""
    if "xl/workbook.xml" in z.namelist() and "xl/_rels/workbook.xml.rels" in z.namelist():
        sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]
        parts = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter()}
        named = [v for e in sheets[:1] for k, v in e.attrib.items() if k.endswith("}id")]
        if named and parts.get(named[0]):
            target = parts[named[0]]
            return target[1:] if target.startswith("/") else f"xl/{target}"
    return sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of an .xlsx file's first sheet, as strings."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", space):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{space['m']}}}t")))
        first = first_sheet(z)
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{space['m']}}}row"):
            cells: dict[int, str | None] = {}
            for i, cell in enumerate(row.findall("m:c", space)):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                at = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else i
                value = cell.find("m:v", space)
                text = value.text if value is not None else None
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{{{space['m']}}}t"))
                cells[at] = text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of one workbook, all columns as strings. The workbook is read by one task, as it is one archive."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def header(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = sheet_rows(content)
                yield type(b).from_pydict({"names": [[x or "" for x in rows[0]] if rows else []]})

    got = files.mapInArrow(header, "names array<string>").first()
    names = got.names if got else []

    def body(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = [r for r in sheet_rows(content)[1:] if any(r)]
                cells = [[(r + [None] * len(names))[: len(names)] for r in rows]]
                yield type(b).from_pydict({"row": cells[0]})

    values = files.mapInArrow(body, "row array<string>")
    return values.select(*(F.get("row", i).alias(n or f"column_{i}") for i, n in enumerate(names)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .csv or .xlsx. The old .xls format needs a reader that isn't installed."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in EXTENSIONS:
        raise ValueError(f"'{extension}' is not one of {', '.join(EXTENSIONS)}")
    if extension == ".xls":
        raise NotImplementedError(".xls files have to be saved as .xlsx or .csv first")
    return read_csv(spark, path) if extension == ".csv" else read_xlsx(spark, path)


def extract_rows(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Headers, required columns (a warning), cells."""
    named, warnings = normalise_headers(df)
    lacking = missing_columns(named)
    if lacking:
        warnings.append("missing required columns: " + ", ".join(lacking))
    return clean_cells(named), warnings


def rows_to_records(rows: DataFrame, source_name: str, source_type: str = "CSV") -> DataFrame:
    """Canonical string columns as records. Columns that the rows lack are null."""

    def cell(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def struct(ddl: str, **values: Column) -> Column:
        names = [x.split(":")[0] for x in ddl[7:-1].split(",")]
        return F.struct(*(values.get(n, F.lit(None)).alias(n) for n in names)).cast(ddl)

    def people(prefix: str, role: str) -> Column:
        one = struct(
            S.PERSON,
            name=cell(f"{prefix}_name"),
            age=F.try_to_number(cell(f"{prefix}_age"), F.lit("999")).cast("short"),
            gender=F.initcap(cell(f"{prefix}_gender")),
            role=F.lit(role),
            address=cell(f"{prefix}_address"),
            phone=cell(f"{prefix}_phone"),
            identification_number=cell(f"{prefix}_badge"),
            remarks=cell(f"{prefix}_rank"),
        )
        return F.when(cell(f"{prefix}_name").isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{S.PERSON}>"))

    def date_of(c: Column) -> Column:
        return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")))

    place = ("address", "locality", "area", "police_station", "district", "state", "country", "postal_code", "zone", "landmark")
    kind = F.upper(F.lit(source_type))
    empty = F.array()
    made = {
        **{n: cell(n) for n in ("case_number", "fir_number", "crime_type", "crime_category", "status", "incident_time")},
        **{n: cell(n) for n in ("description", "modus_operandi", "motive")},
        **{n: F.coalesce(F.split(cell(n), r"\s*[,;]\s*"), empty) for n in ("ipc_sections", "bns_sections")},
        "incident_date": date_of(cell("incident_date")),
        "report_date": F.coalesce(F.try_to_timestamp(cell("report_date")), date_of(cell("report_date")).cast("timestamp")),
        "location": struct(S.LOCATION, **{n: cell(n) for n in place}),
        "victims": people("victim", "Victim"),
        "suspects": people("suspect", "Suspect"),
        "witnesses": empty,
        "officers": people("officer", "Officer"),
        "weapons": F.when(cell("weapon_type").isNotNull(), F.array(struct(S.WEAPON, weapon_name=cell("weapon_type")))).otherwise(empty),
        "vehicles": F.when(
            cell("vehicle_registration").isNotNull(),
            F.array(struct(S.VEHICLE, registration_number=cell("vehicle_registration"), vehicle_type=cell("vehicle_type"))),
        ).otherwise(empty),
        "source_type": F.when(kind == "CSV", "CSV").otherwise("EXCEL"),
        "source_name": F.lit(source_name),
    }
    lists = {f.name for f in S.RECORD.fields if f.dataType.typeName() == "array"}
    return rows.select(
        *(
            made.get(f.name, empty if f.name in lists else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.RECORD.fields
        ),
        *(["row_id"] if "row_id" in rows.columns else []),
    )
