"""A stream of documents into the warehouse: each micro-batch is a batch ingest, so replays insert nothing twice."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mnemo.plans.ingest import ingest
from mnemo.sources.warehouse import Warehouse


def stream(docs: DataFrame, warehouse: Warehouse, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts ingesting a streaming DataFrame of documents; with once, what is there now and no more."""
    writer = docs.writeStream.foreachBatch(lambda batch, _: ingest(warehouse, batch, int(time.time()))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
