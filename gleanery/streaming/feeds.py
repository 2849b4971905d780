"""Streams that follow, tag and filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dictionary import tag_documents
from ..plans.service import canonical_url
from .tables import ChangeTable, SeenTable


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small partitions reserves megabytes
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in a store on disk with bounded memory, whose checkpoints hold only what changed;
    a stream takes the session's settings along when it starts."""
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    for name, value in STATE_ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stream_tail(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Follow an append-only folder of files."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_tag(documents: DataFrame, dictionary: DataFrame, table: ChangeTable, checkpoint: str, text: str = "text", key: str = "id", **trigger) -> StreamingQuery:
    """Tag each arriving document with its dictionary terms before it is written."""
    def write(batch: DataFrame, epoch: int) -> None:
        table.apply(tag_documents(batch, dictionary, text, key).drop(text), epoch)

    return (documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_new_urls(visits: DataFrame, known: DataFrame, table: SeenTable, checkpoint: str, pattern: str, **trigger) -> StreamingQuery:
    """Each recognised address once, unless it is known already, however late or often it is visited.

    What was visited before is keyed state of the stream, kept by address on the executors' disks and in the checkpoint, so a batch
    costs what it holds; only addresses met for the first time are held against ``known`` and added to ``table``.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        table.apply(batch.join(known.select("url"), "url", "left_anti"), epoch)

    first = visits.select(canonical_url(pattern=pattern).alias("url")).filter("url IS NOT NULL").dropDuplicates(["url"])
    with state_on_disk(visits.sparkSession):
        return (first.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def stream_buffered_commit(changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, period: str | None = "60 seconds") -> StreamingQuery:
    """Commit every ``period``; bound the rows of one commit with ``maxFilesPerTrigger`` on the source. Without a period,
    everything available is committed and the stream stops."""
    trigger = {"processingTime": period} if period else {"availableNow": True}
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
