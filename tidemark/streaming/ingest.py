"""Continuous loading: the upsert of a batch, applied to each micro-batch of new records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.unify import latest_per_key
from tidemark.sources.tables import KEY, load_records, write_upsert


def stream_upserts(records: DataFrame, source: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert a stream of source records into its table. Loading a batch twice changes nothing."""

    def load(batch: DataFrame, _: int) -> None:
        loaded = load_records(batch, source)
        write_upsert(latest_per_key(loaded, KEY, [F.col("scraped_at").desc()]), path, newest="scraped_at")

    writer = records.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
