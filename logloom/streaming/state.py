"""Session settings that keyed streaming state needs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use RocksDB state, which keeps list and value
    state on the executors' disks with snapshots in the checkpoint.  A query
    copies the session's settings when it starts, so the caller's come back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def finished(query):
    """Wait for a one-shot stream and raise what stopped it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query
