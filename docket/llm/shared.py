"""What several operators need: a folder that all executors see, written intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Inside a character class of a Java, Python or RE2 pattern: the white space that ends a word.
BLANKS = r" \t\n\x0B\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session names none, as in tests, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docket-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarding(result: Any, *frames: DataFrame) -> Any:
    """`result`, after deleting the folders of `frames`, which must come from written() and be needed no more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bytes of rows that are sent to every executor at most, small against the gigabytes an executor has.
BROADCAST_BYTES = 64 << 20


def row_bytes(schema: T.StructType) -> int:
    """What a row takes in memory, about: its header and 8 bytes a column; more where a column has no fixed size."""
    wide = {"string": 64, "binary": 32, "array": 512, "struct": 64, "map": 512}
    return 32 + sum(wide.get(f.dataType.typeName(), 8) for f in schema)


def small(df: DataFrame) -> DataFrame:
    """`df` (of numbers, hashes and short names), to be broadcast if all its rows take BROADCAST_BYTES or less.

    Otherwise Spark joins it as it sees fit by what it knows of its size.
    """
    return F.broadcast(df) if df.count() * row_bytes(df.schema) <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): (id, root), root the smallest id reachable.

    Alternates large-star and small-star steps (every node points to the smallest node it knows of) until no
    edge changes. Each step is two shuffles of at most the edges; the hub of a star is a join key, whose rows AQE
    splits, never a collected list. Null ids are dropped; loops count as a node of its own. An empty input gives
    an empty result.
    """
    nodes = edges.where("a is not null and b is not null")
    edges = written(
        nodes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "edges",
    )
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        turned = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = written(turned, "edges")
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            discarding(None, edges)
            return after.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).union(
                after.select("b", "b").distinct()
            )
        edges = discarding(after, edges)


def with_python_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[list]]], ddl: str, rows: int = 256
) -> DataFrame:
    """`df` with the columns of `ddl` added, replacing any of their names.

    `make()` runs once in each task and gives a function from a slice of at most `rows` rows to one list of values per
    new column, so that a task holds the new values of one slice at a time.
    """
    added = T.StructType.fromDDL(ddl)
    kept = df.drop(*added.names)
    schema = T.StructType([*kept.schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                new = [pa.array(values, kind) for values, kind in zip(function(part), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)

    return kept.mapInArrow(run, schema)
