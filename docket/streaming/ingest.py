"""The batch chain on a stream: each micro-batch is judged against what was committed before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docket.operators.persist import INDEXES, KEYS
from docket.operators.store import Store
from docket.plans.ingest import Ingest


def ingest_stream(records: DataFrame, chain: Ingest, base: dict[str, DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over streaming `records`, which commits each micro-batch to the store in `folder`.

    Batches are named after the query and their number, so one that is run again after a crash is committed once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        chain.store(batch, Store(batch.sparkSession, folder, KEYS, INDEXES), f"{checkpoint}#{number}", base)

    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
