"""The registered queries of the engine's own operators, each with the same computation in DuckDB's SQL.

`dirt` expressions put deterministic blemishes into clean tables; they are SQL that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.functions.lineage import written
from docket.functions.similarity import similar_strings
from docket.functions.text import clean_cell, clean_text
from docket.operators import dedup, geocode, jobs, persist, validate
from docket.operators import schema as S
from docket.plans.ingest import Ingest
from docket.sources import documents, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "1998-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda e: e["rule"]), ",")


#: White space and unprintable characters in RE2's terms.
BLANKS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
NO_PRINT = r"[\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\p{Cf}\p{Co}\x00-\x08\x0B-\x1F\x7F-\x9F]"


@query(
    """
    with d as (select doc_id, min(doc_id) over (partition by text) as first_id from documents)
    select doc_id, case when first_id < doc_id then 'Duplicate' else 'Inserted' end as outcome,
      case when first_id < doc_id then first_id end as matched_id,
      case when first_id < doc_id then 1.0 else 0.0 end::double as confidence
    from d
    """
)
def dedup_exact_documents(spark, sf_dir):
    found = dedup.first_wins(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "doc_id")
    again = F.col("matched_id").isNotNull()
    return found.select(
        "doc_id",
        F.when(again, "Duplicate").otherwise("Inserted").alias("outcome"),
        "matched_id",
        F.when(again, 1.0).otherwise(0.0).alias("confidence"),
    )


TEXT_DIRT = (
    "(case when doc_id % 3 = 0 then chr(9) || '  ' else '' end || replace(text, ' the ', '  the' || chr(9))"
    " || case when doc_id % 4 = 0 then chr(13) || chr(10) || '|' || chr(10) || chr(10) || chr(10) || chr(10) || '..' || chr(10) || 'end' else '' end"
    " || case when doc_id % 5 = 0 then '​  x ' else '' end)"
)


def text_sql(ocr: bool) -> str:
    step = r"regexp_replace(regexp_replace(dirty, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    if ocr:
        step = rf"regexp_replace({step}, '(?m)^[^a-zA-Z0-9ऀ-ॿ\n]{{1,2}}$', '', 'g')"
    return rf"""
    with d as (select doc_id, {TEXT_DIRT} as dirty from documents)
    select doc_id, md5(clean) as clean_md5, length(clean)::bigint as clean_chars from (
      select doc_id, regexp_replace(regexp_replace(regexp_replace({step}, '\n{{3,}}', chr(10) || chr(10), 'g'),
        '{NO_PRINT}', '', 'g'), '^[ \n\t]+|[ \n\t]+$', '', 'g') as clean from d)
    """


def cleaned(spark, sf_dir, ocr):
    clean = clean_text(F.expr(TEXT_DIRT), ocr)
    docs = table(spark, sf_dir, "documents").select("doc_id", clean.alias("clean"))
    return docs.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("clean_chars"))


@query(text_sql(False))
def clean_text_digital(spark, sf_dir):
    return cleaned(spark, sf_dir, False)


@query(text_sql(True))
def clean_text_ocr(spark, sf_dir):
    return cleaned(spark, sf_dir, True)


CELL_DIRT = (
    "case when c_custkey % 11 = 0 then ' N/A ' when c_custkey % 7 = 0 then '  ' || c_name || chr(9) || '  x '"
    " when c_custkey % 5 = 0 then 'Not  Available' when c_custkey % 13 = 0 then '-' when c_custkey % 17 = 0 then ' nan' else c_name end"
)
MISSING_SQL = "('', 'n/a', 'na', 'none', 'null', '-', '--', 'nil', 'not available', 'not applicable', 'unknown')"


@query(
    rf"""
    with d as (select c_custkey, regexp_replace(regexp_replace({CELL_DIRT}, '^{BLANKS}+|{BLANKS}+$', '', 'g'), '{BLANKS}+', ' ', 'g') as cell
      from customer)
    select c_custkey, case when lower(cell) in {MISSING_SQL} then null else cell end as cell from d
    """
)
def clean_cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", clean_cell(F.expr(CELL_DIRT)).alias("cell"))


@query(
    """
    select 'FIR-' || p_partkey as fir_number, p_type as crime_type,
      coalesce(nullif(p_brand, 'Brand#13'), p_name) as address, p_size::varchar as size_in_mm, 'incident_date' as missing
    from part
    """
)
def header_normalise(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    raw = part.select(
        F.concat(F.lit("FIR-"), F.col("p_partkey")).alias("  FIR   No. "),
        F.col("p_type").alias("Type of Crime"),
        F.when(F.col("p_brand") != "Brand#13", F.col("p_brand")).alias("Location"),
        F.col("p_name").alias("Place of  Occurrence"),
        F.col("p_size").cast("string").alias("Size (in mm)"),
    )
    named, _ = tabular.normalise_headers(raw)
    return named.withColumn("missing", F.lit(",".join(tabular.missing_columns(named))))


REQUIRED_DIRT = {
    "fir": "case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then '' else 'F' || o_orderkey end",
    "num": "case when o_orderkey % 2 = 0 then null else 'C' || o_custkey end",
    "kind": "case when o_orderkey % 7 = 0 then '' else o_orderpriority end",
    "day": "case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end",
}
REQUIRED_SQL = """
  case when coalesce(fir, '') = '' and coalesce(num, '') = '' then 'V1' end,
  case when coalesce(kind, '') = '' then 'V2' end, case when day is null then 'V3' end
"""


def dirty_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", *(F.expr(v).alias(k) for k, v in REQUIRED_DIRT.items()))


DIRTY_ORDERS = "(select o_orderkey, o_orderpriority, " + ", ".join(f"{v} as {k}" for k, v in REQUIRED_DIRT.items()) + " from orders)"


@query(f"select o_orderkey, concat_ws(',', {REQUIRED_SQL}) as errors, concat_ws(',', {REQUIRED_SQL}) = '' as is_valid from {DIRTY_ORDERS}")
def validate_required(spark, sf_dir):
    errors = validate.required(F.col("fir"), F.col("num"), F.col("kind"), F.col("day"))
    return dirty_orders(spark, sf_dir).select("o_orderkey", rules(errors).alias("errors"), (F.size(errors) == 0).alias("is_valid"))


@query(
    f"""
    with d as (select l_orderkey, l_linenumber, case when l_orderkey % 97 = 0 then date '1899-12-31' else o_orderdate::date end as i,
      l_shipdate as r from lineitem join orders on l_orderkey = o_orderkey)
    select l_orderkey, l_linenumber, concat_ws(',', case when i > date '1998-01-01' then 'V4' end, case when year(i) < 1900 then 'V5' end,
      case when r > timestamp '{AS_OF}' then 'V6' end, case when r < i::timestamp then 'V7' end) as errors,
      case when r < i::timestamp then 'Temporal Exception: ''report_date'' (' || r::varchar || ') cannot occur before ''incident_date'' ('
        || i::varchar || ').' end as v7
    from d
    """
)
def validate_temporal(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.when(F.col("l_orderkey") % 97 == 0, F.lit("1899-12-31").cast("date")).otherwise(F.col("o_orderdate").cast("date"))
    found = joined.select("l_orderkey", "l_linenumber", validate.temporal(day, F.col("l_shipdate"), F.lit(AS_OF).cast("timestamp")).alias("e"))
    v7 = F.get(F.filter("e", lambda e: e["rule"] == "V7"), F.lit(0))["message"]
    return found.select("l_orderkey", "l_linenumber", rules(F.col("e")).alias("errors"), v7.alias("v7"))


@query(
    """
    with d as (select c_custkey as id, 'customer' as kind, c_acctbal / 100 as lat, c_acctbal / 50 as lon, c_acctbal / 9000 as score from customer
      union all select s_suppkey, 'supplier', s_acctbal / 100, s_acctbal / 50, case when s_suppkey % 4 = 0 then null else s_acctbal / 9000 end from supplier)
    select id, kind, concat_ws(',', case when lat < -90 or lat > 90 then 'V8' end, case when lon < -180 or lon > 180 then 'V9' end,
      case when score < 0 or score > 1 then 'V10' end) as errors from d
    """
)
def validate_ranges(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("x"), F.lit(True).alias("scored"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.lit("supplier"), F.col("s_acctbal"), F.col("s_suppkey") % 4 != 0)
    x = F.col("x")
    return a.union(b).select("id", "kind", rules(validate.ranges(x / 100, x / 50, F.when(F.col("scored"), x / 9000))).alias("errors"))


@query(
    """
    select event_id, concat_ws(',', case when event_type not in ('click', 'view', 'purchase', 'signup') then 'V15' end,
      case when event_id % 9 = 0 then 'V16' end) as errors from events
    """
)
def validate_enums(spark, sf_dir):
    kind = F.when(F.col("event_id") % 9 == 0, "FAX").when(F.col("event_id") % 9 == 1, "").otherwise("CSV")
    errors = validate.listed(
        validate.enumerated("V15", F.col("event_type"), ("click", "view", "purchase", "signup"), "bad type"),
        validate.enumerated("V16", kind, S.SOURCE_TYPES, "bad source"),
    )
    return table(spark, sf_dir, "events").select("event_id", rules(errors).alias("errors"))


PLATE = "case when l_linenumber % 5 = 0 then '' else ' ' || lower(l_returnflag) || l_linestatus || (l_partkey % 3) || ' ' end"


@query(
    f"""
    with d as (select l_orderkey, l_linenumber, {PLATE} as raw, upper(trim({PLATE})) as k,
        row_number() over (partition by l_orderkey order by l_linenumber, {PLATE}) - 1 as idx from lineitem),
    r as (select *, row_number() over (partition by l_orderkey, k order by idx) as nth from d)
    select l_orderkey, coalesce(string_agg('Compliance warning: Duplicate vehicle registration ''' || raw || ''' found at index ' || idx
      || ' in vehicles list.', ';' order by idx) filter (where nth > 1 and k <> ''), '') as warnings
    from r group by l_orderkey
    """
)
def validate_list_repeats(spark, sf_dir):
    one = F.struct("l_linenumber", F.expr(PLATE).alias("registration_number"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("vehicles"))
    warnings = F.transform(validate.repeated_vehicles(F.col("vehicles")), lambda w: w["message"])
    return lists.select("l_orderkey", F.array_join(warnings, ";").alias("warnings"))


@query(
    f"""
    select o_orderpriority, count(*) as records, count(*) filter (where coalesce(fir, '') = '' and coalesce(num, '') = '') as v1,
      count(*) filter (where kind = '') as v2, count(*) filter (where day is null) as v3,
      count(*) filter (where concat_ws(',', {REQUIRED_SQL}) = '') as valid
    from {DIRTY_ORDERS} group by o_orderpriority
    """
)
def validation_summary(spark, sf_dir):
    e = validate.required(F.col("fir"), F.col("num"), F.col("kind"), F.col("day"))
    rows = dirty_orders(spark, sf_dir).select("o_orderpriority", F.transform(e, lambda x: x["rule"]).alias("r"))
    count = [F.count_if(F.array_contains("r", c)).alias(c.lower()) for c in ("V1", "V2", "V3")]
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("records"), *count, F.count_if(F.size("r") == 0).alias("valid"))


@query(
    """
    select l_orderkey, l_linenumber, l_returnflag as top, l_linestatus as inner_text, l_shipdate::date::varchar as item,
      ' ' || l_returnflag as in_list from lineitem
    """
)
def recursive_trim(spark, sf_dir):
    pad = lambda c: F.concat(F.lit("  "), c, F.lit("\t "))
    nested = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        pad(F.col("l_returnflag")).alias("top"),
        F.struct(pad(F.col("l_linestatus")).alias("x"), F.col("l_tax")).alias("s"),
        F.array(F.struct(pad(F.col("l_shipdate").cast("date").cast("string")).alias("y"))).alias("items"),
        F.array(F.concat(F.lit(" "), "l_returnflag")).alias("strings"),
    )
    t = validate.trimmed_record(nested)
    return t.select("l_orderkey", "l_linenumber", "top", F.col("s.x").alias("inner_text"), F.col("items")[0]["y"].alias("item"), F.col("strings")[0].alias("in_list"))


#: A person and a weapon of each line.
MADE = {
    "name": "case when l_linenumber % 2 = 0 then ' N' else ' n' end || (l_suppkey % 3)",
    "mark": "case when l_linenumber % 3 = 0 then '' when l_linenumber % 3 = 1 then 'id' || (l_partkey % 4) else 'ID' || (l_partkey % 4) || ' ' end",
    "gender": "case when l_returnflag = 'N' then 'Male' when l_returnflag = 'A' then '' else 'M' end",
    "role": "case when l_linestatus = 'O' then 'Victim' else 'Hero' end",
    "age": "cast(l_quantity * 4 - 10 as smallint)",
    "weapon": "case when l_partkey % 3 = 0 then 'Laser' when l_partkey % 3 = 1 then null else 'Blunt Object' end",
}


@query(
    f"""
    with d as (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in MADE.items())} from lineitem),
    k as (select *, lower(trim(name)) as n, upper(trim(mark)) as m from d),
    r as (select *, row_number() over (partition by l_orderkey, n order by l_linenumber) as nth_name,
      row_number() over (partition by l_orderkey, m order by l_linenumber) as nth_mark from k)
    select l_orderkey, count(*) filter (where nth_mark > 1 and m <> '')::int as v12, count(*) filter (where nth_name > 1 and n <> '')::int as v13,
      (count(*) filter (where gender = 'M') + count(*) filter (where role = 'Hero'))::int as v17, count(*) filter (where weapon = 'Laser')::int as v18,
      count(*) filter (where not age between 0 and 150)::int as v19, (l_orderkey % 3 = 0)::int as v11
    from r group by l_orderkey
    """
)
def validate_record_lists(spark, sf_dir):
    """Rules on lists of people and weapons, and on the narrative, by the validator of whole records."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in MADE.items()))
    both = F.struct("l_linenumber", "name", "mark", "gender", "role", "age", "weapon")
    lists = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(both)).alias("x"))
    names = [x.split(":")[0] for x in S.PERSON[7:-1].split(",")]
    own = {"name": "name", "identification_number": "mark", "gender": "gender", "role": "role", "age": "age"}
    people = F.transform("x", lambda p: F.struct(*((p[own[n]] if n in own else F.lit(None)).alias(n) for n in names)))
    arms = F.transform("x", lambda p: F.struct(p["weapon"].alias("weapon_type"), *(F.lit(None).alias(n) for n in ("weapon_name", "recovered", "description"))))
    made = {"victims": people, "weapons": arms, "description": F.when(F.col("l_orderkey") % 3 != 0, "told")}
    arrays = {f.name for f in S.RECORD.fields if f.dataType.typeName() == "array"}
    records = lists.select(
        F.col("l_orderkey").alias("row_id"),
        *(made.get(f.name, F.array() if f.name in arrays else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RECORD.fields),
    )
    checked = validate.validate(records, F.lit(AS_OF).cast("timestamp"))
    count = lambda c, rule: F.size(F.filter(c, lambda e: e["rule"] == rule)).alias(rule.lower())
    return checked.select(F.col("row_id").alias("l_orderkey"), *(count("errors", r) for r in ("V17", "V18", "V19")), *(count("warnings", r) for r in ("V11", "V12", "V13")))


KEYS = (
    "case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 'K' || (o_orderkey % 500) else 'none' end as fir_number",
    "'K' || (o_custkey % 300) as case_number",
)


@query(
    f"""
    with r as (select o_orderkey as row_id, {', '.join(KEYS)} from orders),
    c as (select 'K' || (s_suppkey * 3) as n, min(s_suppkey) as id from supplier group by 1)
    select row_id, coalesce(a.id, b.id) as matched_id from r left join c a on fir_number = a.n left join c b on case_number = b.n
    """
)
def exact_key_two_step(spark, sf_dir):
    records = table(spark, sf_dir, "orders").selectExpr("o_orderkey as row_id", *KEYS)
    cases = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as case_id", "'K' || (s_suppkey * 3) as case_number")
    return dedup.exact_matches(records, cases).select("row_id", "matched_id")


@query(
    """
    with a as (select c_custkey as id, (c_custkey % 977) * 0.0007 as lat, (c_custkey % 89) * 0.0006 as lon from customer),
    b as (select s_suppkey as id, (s_suppkey % 991) * 0.0007 as lat, (s_suppkey % 83) * 0.0006 as lon from supplier)
    select a.id as a_id, b.id as b_id from a, b where abs(a.lat::double - b.lat::double) < 0.001 and abs(a.lon::double - b.lon::double) < 0.001
    """
)
def location_box_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast((c_custkey % 977) * 0.0007 as double) as lat", "cast((c_custkey % 89) * 0.0006 as double) as lon")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "cast((s_suppkey % 991) * 0.0007 as double) as lat", "cast((s_suppkey % 83) * 0.0006 as double) as lon")
    return dedup.coordinate_pairs(a, b, 0.001)


LCS_SQL = """list_extract(list_reduce(list_transform(string_split({a}, ''), lambda c: [c]),
  lambda p, c: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j::varchar]),
    lambda q, j: list_append(q, (case when substring({b}, j[1]::int, 1) = c[1] then p[j[1]::int]::int + 1
      else greatest(p[j[1]::int + 1]::int, q[j[1]::int]::int) end)::varchar), ['0']),
  list_transform(range(0, length({b}) + 1), lambda k: '0')), -1)::int"""


def ratio_sql(a: str, b: str) -> str:
    return f"200.0::double * {LCS_SQL.format(a=a, b=b)} / (length({a}) + length({b}))"


#: Names that are different for each key, some of them similar.
PERSON_NAME = "substr(md5(cast(p_partkey as varchar(20))), 1, 9) || ' ' || p_name"


@query(
    f"""
    with n as (select distinct {PERSON_NAME} as x from part),
    c as (select a.x as a, b.x as b from n a, n b where a.x < b.x and levenshtein(a.x, b.x) <= 0.2 * (length(a.x) + length(b.x))),
    p as (select a, b, {ratio_sql('a', 'b')} as ratio from c)
    select a, b, round(ratio, 4) as ratio from p where ratio >= 80
    """
)
def similarity_indel(spark, sf_dir):
    """All pairs of similar names among all names."""
    names = table(spark, sf_dir, "part").select(F.expr(PERSON_NAME).alias("a")).distinct()
    found = similar_strings(names, names.withColumnRenamed("a", "b"), 80.0).where("a < b")
    return found.select("a", "b", F.round("ratio", 4).alias("ratio"))


#: A search: the ids that 50 divides, against all rows.
NAMES = f"select p_partkey as id, ' ' || upper({PERSON_NAME}) as name from part where p_partkey % 50 = 0"
KNOWN = f"select p_partkey as id, {PERSON_NAME} || ' ' as name from part"


@query(
    f"""
    with a as (select id, lower(trim(name)) as n, row_number() over () as k from ({NAMES})),
    b as (select distinct id, lower(trim(name)) as n from ({KNOWN})),
    u as (select a.n as x, b.n as y from (select distinct n from a) a, (select distinct n from b) b where levenshtein(a.n, b.n) <= 0.2 * (length(a.n) + length(b.n))),
    s as (select x, y, {ratio_sql('x', 'y')} as ratio from u),
    m as (select a.id as a_id, b.id as b_id, a.k, max(ratio) as best from a join s on a.n = s.x join b on b.n = s.y where ratio >= 80 group by 1, 2, 3)
    select a_id, b_id, round(avg(best), 4) as score from m group by 1, 2
    """
)
def people_similarity(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("docket_part")
    a, b = (spark.sql(x.replace("from part", "from docket_part")) for x in (NAMES, KNOWN))
    return dedup.people_scores(a, b, 80.0).select("a_id", "b_id", F.round("score", 4).alias("score"))


#: Plates of eleven characters, one for each part; every third one has lost a character.
PLATE_OF = "case when l_linenumber % 3 = 0 then '' else 'B' end || upper(substr(md5(cast(l_partkey as varchar(20))), 1, 10))"
IN_PLATES = f"select l_orderkey as id, {PLATE_OF} as plate from lineitem where l_orderkey % 50 = 0"
DB_PLATES = f"select l_suppkey as id, lower({PLATE_OF}) as plate from lineitem"


@query(
    f"""
    with a as (select id, upper(trim(plate)) as p, count(*) as times from ({IN_PLATES}) group by 1, 2),
    b as (select distinct id, upper(trim(plate)) as p from ({DB_PLATES})),
    u as (select x.p as x, y.p as y from (select distinct p from a) x, (select distinct p from b) y where abs(length(x.p) - length(y.p)) <= 1 and levenshtein(x.p, y.p) <= 2),
    s as (select x, y from u where x = y or {ratio_sql('x', 'y')} >= 90),
    t as (select id, sum(times) as total from a group by 1),
    h as (select distinct a.id as a_id, b.id as b_id, a.p, a.times from a join s on a.p = s.x join b on b.p = s.y)
    select a_id, b_id, round(sum(times) / min(total) * 100.0, 4) as score from h join t on t.id = a_id group by 1, 2
    """
)
def vehicle_similarity(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("docket_lineitem")
    a, b = (spark.sql(x.replace("from lineitem", "from docket_lineitem")) for x in (IN_PLATES, DB_PLATES))
    return dedup.vehicle_scores(a, b, 90.0).select("a_id", "b_id", F.round("score", 4).alias("score"))


SCORES = """select l_orderkey as a_id, l_partkey as b_id, max(l_linenumber % 7 = 0) as near, max(80 + l_quantity / 2.5) as description,
  max(60 + l_quantity * 0.8) as people, max(case when l_suppkey % 3 = 0 then 100.0 else 50 + l_quantity end) as vehicles from lineitem group by 1, 2"""


@query(
    f"""
    with s as ({SCORES}),
    c as (select a_id, b_id, coalesce(greatest(case when near then 0.85::double end, case when description >= 85 then 0.80::double * (description / 100.0) end,
      case when people >= 80 then 0.75::double * (people / 100.0) end, case when vehicles >= 90 then 0.70::double * (vehicles / 100.0) end), 0) as confidence from s),
    r as (select *, row_number() over (partition by a_id order by confidence desc, b_id) as nth from c where confidence > 0)
    select a_id, confidence >= 0.75 as is_duplicate, round(confidence, 4) as confidence, b_id as matched_id from r where nth = 1
    """
)
def confidence_best(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("docket_lineitem")
    scores = spark.sql(SCORES.replace("from lineitem", "from docket_lineitem"))
    scores = scores.select("a_id", "b_id", "near", *(F.col(c).cast("double") for c in ("description", "people", "vehicles")))
    return dedup.best_matches(dedup.confidence(scores)).drop("reason")


SPELLED = "case when p_partkey % 3 = 0 then upper(p_type) when p_partkey % 3 = 1 then ' ' || lower(p_type) || ' ' else p_type end"
STORED_TYPES = "select row_number() over (order by p_type) as crime_type_id, p_type as crime_name from (select distinct lower(p_type) as p_type from part where p_partkey < 4)"


@query(
    f"""
    with t as ({STORED_TYPES}), n as (select p_partkey as row_id, trim({SPELLED}) as v from part),
    f as (select lower(v) as k, arg_min(v, row_id) as crime_name, min(row_id) as r from n where lower(v) not in (select lower(crime_name) from t) group by 1)
    select row_number() over (order by r) + (select coalesce(max(crime_type_id), 0) from t) as crime_type_id, crime_name, 2 as severity from f
    """
)
def get_or_create_dimension(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    part.createOrReplaceTempView("docket_part")
    stored = spark.sql(STORED_TYPES.replace("from part", "from docket_part"))
    made = persist.get_or_create(part.select(F.col("p_partkey").alias("row_id"), F.expr(SPELLED).alias("value")), stored)
    return made.select("crime_type_id", "crime_name", "severity")


MARKED = """select c_custkey as case_id, 0 as list, 0 as pos, 'Victim' as role, c_name as name, case when c_custkey % 3 = 0 then null
  when c_custkey % 3 = 1 then 'ID' || (c_custkey % 200) else 'S' || (c_custkey % 150) end as identification_number, c_mktsegment as remarks from customer"""
MARKS = "select s_suppkey as person_id, 'S' || s_suppkey as identification_mark from supplier"


@query(
    f"""
    with p as ({MARKED}), s as ({MARKS}),
    k as (select p.*, s.person_id as stored, case when identification_number is not null then row_number() over (partition by identification_number order by case_id) end as nth
      from p left join s on identification_number = identification_mark),
    n as (select case_id, identification_number, row_number() over (order by case_id) + (select max(person_id) from s) as person_id
      from k where stored is null and (identification_number is null or nth = 1))
    select k.case_id, coalesce(k.stored, m.person_id, o.person_id) as person_id, k.role, k.remarks
    from k left join n m on k.identification_number = m.identification_number left join n o on k.identification_number is null and k.case_id = o.case_id
    """
)
def person_first_wins(spark, sf_dir):
    for name in ("customer", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"docket_{name}")
    people = spark.sql(MARKED.replace("from customer", "from docket_customer"))
    people = people.selectExpr("*", "null as gender", "null as age", "null as phone", "null as address")
    stored = spark.sql(MARKS.replace("from supplier", "from docket_supplier"))
    return persist.upsert_people(people, stored, ["case_id", "list", "pos"])[1]


@query(
    f"""
    select o_orderkey, coalesce(nullif(num, ''), fir) as case_number,
      coalesce(nullif(kind, ''), 'Incident') || ' report' || case when coalesce(fir, '') <> '' then ' (FIR ' || fir || ')' else '' end as title,
      case when o_orderkey % 2 = 0 then day + time '10:30:00' else day::timestamp end as incident_time, 'Open' as status, 'CSV' as source
    from {DIRTY_ORDERS}
    """
)
def case_projection(spark, sf_dir):
    records = dirty_orders(spark, sf_dir).select(
        "o_orderkey", F.col("fir").alias("fir_number"), F.col("num").alias("case_number"), F.col("kind").alias("crime_type"),
        F.col("day").alias("incident_date"), F.when(F.col("o_orderkey") % 2 == 0, "10:30:00").alias("incident_time"),
        *(F.lit(v).alias(k) for k, v in (("status", ""), ("source_type", "CSV"), ("description", ""), ("confidence_score", 1.0), ("report_date", None))),
    )
    columns = {k: v for k, v in persist.case_columns().items() if k in ("case_number", "title", "incident_time", "status", "source")}
    return records.select("o_orderkey", *(v.alias(k) for k, v in columns.items()))


@query(
    """
    select l_orderkey as case_id, (row_number() over (partition by l_orderkey order by l_linenumber, nullif(l_returnflag, 'N') nulls first, l_linestatus) - 1)::int as pos, nullif(l_returnflag, 'N') as evidence_type,
      'Evidence_' || l_orderkey || '_' || coalesce(nullif(l_returnflag, 'N'), 'None') as file_name, l_linestatus as file_path, l_linestatus as description
    from lineitem
    """
)
def child_tables(spark, sf_dir):
    item = F.struct("l_linenumber", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("evidence_type"), F.col("l_linestatus").alias("description"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    return persist.evidence_rows(lists)


@query("select 'C' || (o_custkey * 7 % 1000) as case_number, count(*) as n from orders group by 1 having count(*) > 1")
def unique_violations(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").selectExpr("'C' || (o_custkey * 7 % 1000) as case_number")
    return persist.repeated_case_numbers(cases)


def customer_places(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    values = {
        "address": F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")),
        "district": F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")),
        "country": F.col("n_name"),
        "latitude": F.when(F.col("c_custkey") % 4 == 0, F.lit(1.5)),
        "longitude": F.when(F.col("c_custkey") % 4 == 0, F.lit(2.5)),
    }
    names = [x.split(":")[0] for x in S.LOCATION[7:-1].split(",")]
    location = F.struct(*(values.get(n, F.lit(None)).alias(n) for n in names)).cast(S.LOCATION)
    return joined.select("c_custkey", "c_name", location.alias("location"))


PLACES_SQL = """(select c_custkey, case when c_custkey % 5 = 0 then '' else c_name end as address, case when c_custkey % 3 <> 0 then c_mktsegment end as district,
  n_name as country, case when c_custkey % 4 = 0 then 1.5::double end as lat, case when c_custkey % 4 = 0 then 2.5::double end as lon from customer join nation on c_nationkey = n_nationkey)"""


@query(f"select c_custkey, concat_ws(', ', nullif(address, ''), district, country) as query from {PLACES_SQL}")
def geocode_query(spark, sf_dir):
    return customer_places(spark, sf_dir).select("c_custkey", geocode.geocode_query(F.col("location")).alias("query"))


@query(
    f"""
    with p as (select *, concat_ws(', ', nullif(address, ''), district, country) as q from {PLACES_SQL}),
    g as (select q, min(c_custkey) as k from p where c_custkey % 2 = 1 group by q)
    select c_custkey, case when lat is null and k is not null then k / 10.0::double else lat end as latitude,
      case when lat is null and k is not null then k / 20.0::double else lon end as longitude,
      case when lat is null and k is not null then coalesce(district, 'county ' || k) else district end as district,
      case when lat is null and k is not null then 'P' || k end as postal_code
    from p left join g on p.q = g.q
    """
)
def geocode_enrich(spark, sf_dir):
    places = customer_places(spark, sf_dir)
    odd = places.where("c_custkey % 2 = 1").select(geocode.geocode_query(F.col("location")).alias("query"), "c_custkey")
    k = F.col("k").cast("string")
    gazetteer = odd.groupBy("query").agg(F.min("c_custkey").alias("k")).select(
        "query", (F.col("k") / 10.0).alias("lat"), (F.col("k") / 20.0).alias("lon"),
        F.struct(F.concat(F.lit("P"), k).alias("postcode"), F.lit("").alias("district"), F.concat(F.lit("county "), k).alias("county"), F.lit(None).cast("string").alias("state"), F.lit("X").alias("country")).alias("address"),
    )
    found = geocode.enrich(places, gazetteer)
    return found.select("c_custkey", *(F.col(f"location.{c}").alias(c) for c in ("latitude", "longitude", "district", "postal_code")))


@query(
    """
    with p as (select c_custkey as point_id, radians(c_custkey * 7919 % 180001 / 1000 - 90) as a, radians(c_custkey * 104729 % 360001 / 1000 - 180) as b from customer),
    g as (select 'S' || s_suppkey as place, radians(s_suppkey * 7907 % 160001 / 1000 - 80) as c, radians(s_suppkey * 99991 % 360001 / 1000 - 180) as d from supplier),
    away as (select point_id, place, pow(cos(a) * cos(b) - cos(c) * cos(d), 2) + pow(cos(a) * sin(b) - cos(c) * sin(d), 2) + pow(sin(a) - sin(c), 2) as far from p, g)
    select point_id, arg_min(place, far) as place from away group by point_id
    """
)
def nearest_place(spark, sf_dir):
    """The nearest of all suppliers to each customer, at coordinates over the whole globe that come from their keys."""
    points = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as point_id", "c_custkey * 7919 % 180001 / 1000 - 90 as lat", "c_custkey * 104729 % 360001 / 1000 - 180 as lon"
    )
    places = table(spark, sf_dir, "supplier").selectExpr(
        "concat('S', s_suppkey) as query", "s_suppkey * 7907 % 160001 / 1000 - 80 as lat",
        "s_suppkey * 99991 % 360001 / 1000 - 180 as lon", "cast(null as string) as address",
    )
    return geocode.nearest(points, places).select("point_id", F.col("query").alias("place"))


@query(
    """
    select c_custkey as user_id, n_name as role_name from customer left join nation on c_nationkey = n_nationkey
    where c_acctbal > 0 and n_name = (select max(n_name) from nation)
    """
)
def user_role_filter(spark, sf_dir):
    users = table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "c_acctbal > 0 as is_active", "c_nationkey as role_id")
    roles = table(spark, sf_dir, "nation").selectExpr("n_nationkey as role_id", "n_name as role_name")
    return jobs.authorised(users, roles, roles.agg(F.max("role_name")).first()[0]).select("user_id", "role_name")


@query(
    """
    with r as (select c_custkey as request_id, c_mktsegment || (c_custkey % 400) || '@x' as email from customer),
    s as (select distinct 'BUILDING' || s_suppkey || '@x' as email from supplier)
    select request_id, email, email not in (select email from s) and request_id = min(request_id) over (partition by email) as accepted from r
    """
)
def unique_email_check(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").selectExpr("c_custkey as request_id", "c_mktsegment || (c_custkey % 400) || '@x' as email")
    stored = table(spark, sf_dir, "supplier").selectExpr("'BUILDING' || s_suppkey || '@x' as email")
    return jobs.new_users(requests, stored).select("request_id", "email", "accepted")


@query(
    f"""
    select event_id as job_id, case when event_id % 10 = 0 then 'Running' when value > 20 then 'Completed' else 'Failed' end as processing_status,
      event_id % 10 <> 0 and value > 20 and event_id % 3 = 0 as ocr_completed, event_id % 10 <> 0 and value > 20 as extraction_completed,
      event_id % 10 <> 0 and value > 20 and event_id % 2 = 0 as database_insertion_completed,
      case when event_id % 10 <> 0 and not value > 20 then 'error ' || event_type end as error_message,
      case when event_id % 10 <> 0 and value > 20 then timestamp '{AS_OF}' end as completed_at
    from events
    """
)
def job_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = events.selectExpr("event_id as job_id", "case when event_id % 3 = 0 then 'PDF' else 'CSV' end as source_type")
    results = events.where("event_id % 10 <> 0").selectExpr("event_id as job_id", "value > 20 as success", "'error ' || event_type as error_message", "event_id % 2 = 0 as inserted")
    return jobs.job_rows(made, results, F.lit(AS_OF).cast("timestamp"))


#: Reports made from documents. Every seventh stands in a line of places, each near the next one only. The others have one facet
#: each, by their text: a place, an address, a description, a suspect or a plate; equal texts have equal ones. Some have no
#: type, some are from the future. Documents whose id 17 divides are also stored cases, unless they are in the line.
REPORT = {
    "crime_type": "case when doc_id % 11 = 3 then '' else lang end",
    "incident_date": "case when doc_id % 13 = 5 then date '2999-01-01' else date '1997-03-01' end",
}
REPORTS_SQL = f"""(select doc_id, source, text, case when doc_id % 7 = 3 then 'line' else
    ['spot', 'address', 'description', 'people', 'vehicles'][('0x' || substr(md5(text), 7, 4))::int % 5 + 1] end as facet,
  case when doc_id % 7 = 3 then md5(doc_id::varchar) when ('0x' || substr(md5(text), 7, 4))::int % 5 = 0
    then ((('0x' || substr(md5(text), 1, 6))::int) % 60000)::varchar else md5(text) end as v,
  concat_ws(',', case when coalesce({REPORT["crime_type"]}, '') = '' then 'V2' end, case when {REPORT["incident_date"]} > date '1998-01-01' then 'V4' end) as errors
  from documents)"""
OUTCOMES_SQL = f"""(
  with d as (select *, facet <> 'line' and doc_id % 17 = 0 as is_stored from {REPORTS_SQL}),
  s as (select facet, v, min(doc_id) as stored from d where is_stored group by facet, v),
  w as (select * from (values ('spot', 0.85::double), ('address', 0.85::double), ('description', 0.80::double), ('people', 0.75::double), ('vehicles', 0.70::double), ('line', 0.85::double)) x(facet, weight)),
  j as (select d.*, s.stored, w.weight, weight >= 0.75 and stored is not null as known from d join w on d.facet = w.facet left join s on d.facet = s.facet and d.v = s.v),
  f as (select facet, v, min(doc_id) as first from j where errors = '' and not known and weight >= 0.75 and facet <> 'line' group by facet, v),
  i as (select doc_id, (doc_id - 3) // 7 - row_number() over (order by doc_id) as island from j where facet = 'line' and errors = ''),
  l as (select doc_id, (row_number() over (partition by island order by doc_id)) % 2 = 0 as goes from i),
  a as (select j.*, case when j.facet = 'line' then case when coalesce(goes, false) then j.doc_id - 7 end when first < j.doc_id then first end as earlier
    from j left join f on j.facet = f.facet and j.v = f.v left join l on j.doc_id = l.doc_id)
  select doc_id, source, errors, case when errors <> '' then 'Invalid' when known or earlier is not null then 'Duplicate' else 'Inserted' end as outcome,
    case when errors = '' then stored end as matched_id, case when errors = '' and not known then earlier end as matched_row,
    case when errors = '' and (stored is not null or earlier is not null) then weight else 0 end as confidence, facet
  from a)"""


def outcomes(spark, sf_dir) -> tuple[Ingest, dict[str, DataFrame], DataFrame]:
    """The chain, its stored tables, and the outcomes of all documents as reports."""
    digits = lambda start, n: F.conv(F.substring(F.md5("text"), start, n), 16, 10).cast("long")
    position = F.floor((F.col("doc_id") - 3) / 7)
    docs = table(spark, sf_dir, "documents").withColumn("facet", F.when(F.col("doc_id") % 7 == 3, -1).otherwise(digits(7, 4) % 5))
    line, spot = F.col("facet") == -1, F.col("facet") == 0
    lat = F.when(spot, (digits(1, 6) % 60000) * F.lit(0.0025) - 75).when(line, (position % 50_000) * F.lit(0.0009))
    lon = F.when(spot, F.lit(10.0)).when(line, 20 + F.floor(position / 50_000) * F.lit(0.01))
    made = docs.select(
        "doc_id", "facet", *(F.expr(v).alias(k) for k, v in REPORT.items()), F.concat(F.lit("F"), "doc_id").alias("fir_number"),
        lat.cast("decimal(10,8)").alias("lat"), lon.cast("decimal(11,8)").alias("lon"),
        *(F.when(F.col("facet") == i, F.md5("text")).alias(c) for i, c in ((1, "address"), (2, "description"), (3, "name"), (4, "plate"))),
    )

    def struct(kind: str, **given: Column) -> Column:
        names = [x.split(":")[0] for x in kind[7:-1].split(",")]
        return F.struct(*(given.get(n, F.lit(None)).alias(n) for n in names)).cast(kind)

    place = struct(S.LOCATION, latitude=F.col("lat").cast("double"), longitude=F.col("lon").cast("double"), address=F.col("address"))
    values = {
        "location": F.when(F.col("lat").isNotNull() | F.col("address").isNotNull(), place),
        "suspects": F.when(F.col("name").isNotNull(), F.array(struct(S.PERSON, name=F.col("name")))).otherwise(F.array().cast(f"array<{S.PERSON}>")),
        "vehicles": F.when(F.col("plate").isNotNull(), F.array(struct(S.VEHICLE, registration_number=F.col("plate")))).otherwise(F.array().cast(f"array<{S.VEHICLE}>")),
    } | {c: F.col(c) for c in ("crime_type", "incident_date", "fir_number", "description")}
    lists = {f.name for f in S.RECORD.fields if f.dataType.typeName() == "array"}
    records = made.select(
        F.col("doc_id").alias("row_id"),
        *(values.get(f.name, F.array() if f.name in lists else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.RECORD.fields),
    )
    known = made.where("doc_id % 17 = 0 and facet >= 0")
    none = {"persons": "person_id long, identification_mark string, full_name string", "crime_types": "crime_type_id long, crime_name string"}
    stored = {name: spark.createDataFrame([], ddl) for name, ddl in none.items()}
    stored["people"] = known.where("name is not null").selectExpr("doc_id as case_id", "name as full_name")
    stored["vehicles"] = known.where("plate is not null").selectExpr("doc_id as case_id", "plate as registration_number")
    stored["cases"] = known.selectExpr("doc_id as case_id", "'S' || doc_id as case_number", "description", "doc_id as location_id", "cast(null as timestamp) as incident_time")
    stored["locations"] = known.selectExpr("doc_id as location_id", "address", "lat as latitude", "lon as longitude")
    chain = Ingest(as_of=F.lit(AS_OF).cast("timestamp"))
    return chain, stored, chain.outcomes(records, stored)


@query(
    f"""
    select source, count(*) as total, count(*) filter (where outcome <> 'Invalid') as processed, count(*) filter (where outcome = 'Duplicate') as duplicates,
      count(*) filter (where outcome = 'Invalid') as invalid, count(*) filter (where outcome <> 'Invalid') > 0 as success from {OUTCOMES_SQL} group by source
    """
)
def batch_summary(spark, sf_dir):
    found = outcomes(spark, sf_dir)[2].select(F.col("row_id").alias("doc_id"), "outcome")
    return jobs.batch_summary(found.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id"), "source")


@query(
    f"""
    select doc_id, errors, outcome, matched_id, matched_row, confidence::double as confidence,
      case when outcome = 'Duplicate' then case facet when 'description' then 'narrative description (similar key similarity 100.0%)'
        when 'people' then 'people profiles (similarity 100.0%)' else 'incident spatial proximity' end end as reason,
      case when outcome = 'Inserted' then dense_rank() over (partition by outcome order by doc_id) + (select max(doc_id) from documents where doc_id % 17 = 0 and doc_id % 7 <> 3) end as case_id
    from {OUTCOMES_SQL}
    """
)
def pipeline_outcome(spark, sf_dir):
    """Validation, duplicates among stored cases and within the batch, and the numbers of the rows to be stored."""
    chain, stored, found = outcomes(spark, sf_dir)
    found = written(found, "outcomes")
    cases = chain.tables(found, stored)["cases"].select("case_id", F.col("case_number").alias("fir_number"))
    return found.join(cases, "fir_number", "left").select(
        F.col("row_id").alias("doc_id"), rules(F.col("errors")).alias("errors"), "outcome", "matched_id", "matched_row",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("duplicate_reason").alias("reason"), "case_id",
    )


FILE_NAME = "url || case page_id % 6 when 0 then '/a.PDF' when 1 then '/b.jpeg' when 2 then '/c.tar.csv' when 3 then '/d.xlsx' when 4 then '/e' else '/f.exe' end"


@query(
    rf"""
    with f as (select page_id, lower(regexp_extract({FILE_NAME}, '(\.[^./]+)$', 1)) as ext,
      case when page_id % 7 = 0 then 0 when page_id % 7 = 1 then 99999999 else 1000 end as size from pages)
    select page_id, case ext when '.pdf' then 'PDF' when '.jpg' then 'Image' when '.jpeg' then 'Image' when '.png' then 'Image'
      when '.csv' then 'CSV' when '.xlsx' then 'Excel' else 'Other' end as category,
      case when ext not in ('.pdf', '.jpg', '.jpeg', '.png', '.csv', '.xlsx') then 415 when size = 0 then 400 when size > 52428800 then 413 else 200 end as status
    from f
    """
)
def file_category(spark, sf_dir):
    name = F.expr(FILE_NAME)
    size = F.when(F.col("page_id") % 7 == 0, 0).when(F.col("page_id") % 7 == 1, 99999999).otherwise(1000)
    return table(spark, sf_dir, "pages").select("page_id", documents.file_category(name).alias("category"), documents.upload_status(name, size).alias("status"))


BAD_URL = "case page_id % 6 when 0 then 'ftp' || substr(url, 5) when 1 then ' ' || url || ' ' when 2 then '//x.org/y' when 3 then '' when 4 then 'https://' else url end"


@query(
    rf"""
    with u as (select page_id, trim({BAD_URL}) as u from pages)
    select page_id, case when u = '' then 'empty address' when not regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]') then 'no scheme or host'
      when not regexp_matches(u, '(?i)^https?:') then 'scheme is not http or https' end as error from u
    """
)
def url_validate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.url_error(F.expr(BAD_URL)).alias("error"))


@query(
    """
    select conv_id, sum(case when turn < 3 then length(trim(text, chr(32) || chr(10) || chr(9))) else 0 end) >= 200 as digital, count(*) as pages
    from conversations group by conv_id
    """
)
def page_text_layer(spark, sf_dir):
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"])
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pages.alias("pages"))
    return grouped.select("conv_id", documents.has_text_layer(F.col("pages"), 3, 200).alias("digital"), F.size("pages").cast("long").alias("pages"))


@query(
    """
    select conv_id, md5(coalesce(string_agg(t, chr(10) || chr(10) order by turn) filter (where t <> ''), '')) as text_md5
    from (select conv_id, turn, case when (conv_id + turn) % 4 = 0 then '' else text end as t from conversations) group by conv_id
    """
)
def page_join(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "").otherwise(F.col("text")))
    return documents.join_pages(pages, "conv_id", "turn").select("conv_id", F.md5("text").alias("text_md5"))


@query(
    """
    select conv_id, md5(coalesce(string_agg(t, ' ' order by turn) filter (where trim(t) <> ''), '')) as text_md5,
      round(avg(c) filter (where trim(t) <> ''), 4) as confidence
    from (select conv_id, turn, case when (conv_id + turn) % 3 = 0 then '  ' else text end as t, ((conv_id * 7 + turn) % 100) / 100.0::double as c from conversations)
    group by conv_id
    """
)
def ocr_confidence(spark, sf_dir):
    text = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "  ").otherwise(F.col("text"))
    box = F.struct("turn", text.alias("text"), (((F.col("conv_id") * 7 + F.col("turn")) % 100) / 100.0).alias("confidence"))
    boxes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    found = boxes.withColumn("found", documents.box_text(F.col("boxes")))
    return found.select("conv_id", F.md5("found.text").alias("text_md5"), F.round("found.confidence", 4).alias("confidence"))


REPLY = (
    "case event_id % 6 when 0 then '```json' || chr(10) || props || chr(10) || '```' when 1 then '``` ' || props || '```' when 2 then substr(props, 1, 4)"
    " when 3 then '  ' when 4 then '{\"k\": \"text\", \"extra\": [1]}' else props end"
)


@query(
    r"""
    select event_id, case event_id % 6 when 2 then 'json' when 3 then 'empty' when 4 then 'schema' end as error,
      case when event_id % 6 in (0, 1, 5) then try_cast(json_extract_string(props, '$.k') as bigint) end as k
    from events
    """
)
def reply_parse(spark, sf_dir):
    schema = S.T.StructType.fromDDL("k long")
    parsed = table(spark, sf_dir, "events").withColumn("p", documents.parse_reply(F.expr(REPLY), schema))
    return parsed.select("event_id", F.col("p.error").alias("error"), F.col("p.record.k").alias("k"))


@query()
def html_article_text(spark, sf_dir):
    return documents.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "text", "error")
