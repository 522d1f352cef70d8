"""The typed record, its enumerations, and the tables that records are stored in."""

from __future__ import annotations

from pyspark.sql import types as T

#: Allowed values of enumerated fields.
ROLES = ("Victim", "Suspect", "Witness", "Officer", "Unknown")
SOURCE_TYPES = ("PDF", "IMAGE", "CSV", "EXCEL", "URL", "TEXT")
GENDERS = ("Male", "Female", "Other", "Unknown")
STATUSES = ("Open", "Closed", "Under Investigation", "Resolved", "Unknown")
MEDIA_TYPES = ("Image", "Video", "Document", "Audio", "Other")
VEHICLE_TYPES = ("Two Wheeler", "Four Wheeler", "Commercial", "Other", "Unknown")
WEAPON_TYPES = ("Firearm", "Bladed", "Blunt Object", "Explosive", "Other", "Unknown")

PERSON = (
    "struct<person_id:string,name:string,age:short,gender:string,role:string,address:string,phone:string,"
    "identification_number:string,injuries:string,remarks:string>"
)
LOCATION = (
    "struct<address:string,locality:string,area:string,police_station:string,district:string,state:string,"
    "country:string,postal_code:string,latitude:double,longitude:double,zone:string,landmark:string>"
)
VEHICLE = (
    "struct<registration_number:string,vehicle_type:string,brand:string,model:string,color:string,owner:string,remarks:string>"
)
WEAPON = "struct<weapon_type:string,weapon_name:string,recovered:boolean,description:string>"
EVIDENCE = (
    "struct<evidence_type:string,description:string,collected:boolean,collected_by:string,collection_date:timestamp>"
)
MEDIA = (
    "struct<media_type:string,file_name:string,file_path:string,mime_type:string,uploaded_by:string,uploaded_at:timestamp>"
)
PEOPLE = ("victims", "suspects", "witnesses", "officers")

SIMPLE = {
    "string": T.StringType(), "short": T.ShortType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}


def struct_of(ddl: str) -> T.StructType:
    """The type that a struct<name:simple type,...> text stands for."""
    pairs = (x.split(":") for x in ddl[len("struct<") : -1].split(","))
    return T.StructType([T.StructField(name, SIMPLE[kind]) for name, kind in pairs])


def fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


STRINGS = T.ArrayType(T.StringType())
RECORD = T.StructType(
    [
        *fields(T.StringType(), "case_number fir_number crime_type crime_category"),
        *fields(STRINGS, "ipc_sections bns_sections"),
        *fields(T.StringType(), "status"),
        *fields(T.DateType(), "incident_date"),
        *fields(T.StringType(), "incident_time"),
        *fields(T.TimestampType(), "report_date"),
        *fields(struct_of(LOCATION), "location"),
        *fields(T.ArrayType(struct_of(PERSON)), " ".join(PEOPLE)),
        *fields(T.StringType(), "description modus_operandi motive"),
        *fields(T.ArrayType(struct_of(WEAPON)), "weapons"),
        *fields(T.ArrayType(struct_of(VEHICLE)), "vehicles"),
        *fields(T.ArrayType(struct_of(EVIDENCE)), "evidence"),
        *fields(T.ArrayType(struct_of(MEDIA)), "media"),
        *fields(T.StringType(), "source_type source_name source_url language extracted_text"),
        *fields(T.DoubleType(), "confidence_score"),
        *fields(T.StringType(), "extraction_model"),
        *fields(T.TimestampType(), "preprocessing_timestamp"),
        *fields(T.BooleanType(), "is_duplicate is_valid"),
        *fields(STRINGS, "validation_errors"),
        *fields(T.StringType(), "duplicate_reason"),
        *fields(STRINGS, "keywords"),
        *fields(T.MapType(T.StringType(), T.StringType()), "entities"),
        *fields(T.StringType(), "summary"),
    ]
)
