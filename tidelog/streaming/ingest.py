"""The log's tail as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.records import unexpired
from ..plans.store import Store


def into_store(mutations: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """One segment for each micro-batch; a batch that runs again after a failure is not written twice. A stream is known by its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, batch=number, stream=checkpoint)

    return mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_stream(mutations: DataFrame, as_of_ms: int) -> DataFrame:
    """The live view as a streaming aggregation: state keeps each key's newest mutation by seq, so late rows change nothing.

    Deleted and expired keys stay in the state, since an older mutation of theirs may still come. For keys without end,
    read a Store that into_store() fills: its compactions let them go.
    """
    last = mutations.groupBy("key").agg(F.max_by(F.struct("value", "tombstone", "expiry_ms"), "seq").alias("last")).select("key", "last.*")
    return last.where(~F.col("tombstone") & unexpired(F.col("expiry_ms"), as_of_ms)).select("key", "value", "expiry_ms")
