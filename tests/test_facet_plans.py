"""What duplicate detection joins: values that are keys by themselves aren't looked up again, and stored facets are one table."""

from pyspark.sql import functions as F

from docket.operators import dedup


def test_undated_links_need_no_join_on_their_values(spark):
    texts = [(1, "a man in a blue coat took the watch"), (2, "a man in a blue coat took the match"), (3, "nothing of the kind")]
    rows = spark.createDataFrame(texts, "id long, value string").select("id", F.lit(None).cast("date").alias("day"), "value")
    links = dedup.Facet("description", 0.8, rows, rows).links(dedup.DedupConfig(), None)
    assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.s.value, r.c.value): r.confidence for r in links.collect()}
    assert {(x[1][:1], y[1]) for x in texts for y in texts if (x[1], y[1]) in found} == {("a", texts[0][1]), ("a", texts[1][1]), ("n", texts[2][1])}
    assert found[texts[0][1], texts[0][1]] == 0.8 and 0.77 < found[texts[0][1], texts[1][1]] < 0.8


def test_stored_facets_side_by_side(spark):
    """Rows of one case for each of its facets explain a match as one row with all of them would."""
    kinds = {"spot": "struct<lat: double, lon: double>", "address": "string", "description": "string", "people": "array<string>", "vehicles": "array<string>"}
    values = {"spot": (1.0, 2.0), "address": "1 high street", "description": "told", "people": ["ann"], "vehicles": ["AB1"]}
    carried = {c: spark.createDataFrame([(7, None, values[c])], f"id long, day date, value {k}") for c, k in kinds.items()}
    table = dedup.side_by_side(carried)
    assert table.count() == 5 and table.columns == ["id", "day", *dedup.FACETS]
    sought = spark.createDataFrame([(1, None, *values.values())], "id long, day date, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    matches = spark.createDataFrame([(1, 7)], "id long, matched_id long")
    (one,) = dedup.explained(matches, sought, table, dedup.DedupConfig()).collect()
    assert one.confidence == 0.85 and one.reason.count(" | ") == 3
