"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.functions.lineage import discarded, written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of all nodes of `edges` (a, b), root the smallest node that can be reached; edges with nulls are left out.

    Every round, each node points at the smallest of its neighbours and at the smallest node its own pointer points at; then
    edges are drawn between roots alone, once each. So a chain's length at least halves in a round, and a node
    with very many edges is a key of sums, never a list.
    """
    known = edges.where("a is not null and b is not null")
    nodes = written(known.select(F.col("a").alias("id")).union(known.select("b")).distinct().withColumn("root", F.col("id")), "roots")
    live = written(known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        points = written(points, "points")
        while True:  # every node at the end of its pointers
            twice = jumped(points, points)
            ahead = written(jumped(twice, twice).join(points.withColumnRenamed("to", "before"), "id").select("id", "to", (F.col("to") < F.col("before")).alias("moved")), "points")
            points = discarded(ahead.select("id", "to", "moved"), points)
            settled = points.where("moved").isEmpty()
            points = points.select("id", "to")
            if settled:
                break
        ends = points
        renamed = nodes.join(ends.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        nodes = discarded(written(renamed, "roots"), nodes)
        a, b = ends.toDF("a", "x"), ends.toDF("b", "y")
        drawn = live.join(a, "a").join(b, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        live = discarded(written(drawn, "edges"), live, points)
    return nodes


def jumped(points: DataFrame, further: DataFrame) -> DataFrame:
    """(id, to): where `further` leads from where `points` lead."""
    return points.join(further.select(F.col("id").alias("to"), F.col("to").alias("end")), "to").select("id", F.col("end").alias("to"))
