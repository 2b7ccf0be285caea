"""Running streams to the end of what is available, into tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path


def read_table_stream(spark: SparkSession, directory: str, name: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """One Parquet table of a directory as a stream, be it one file or a folder of files; without a name, the files of
    the directory. A file source takes a plain path for a folder, so the table is named by a pattern that only it meets."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{directory.rstrip('/')}/{name}.parque[t]" if name else directory)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk instead of the executors' heaps, with change logs as checkpoints, for queries started inside."""
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode query on everything available; the batch read of its sink."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    """Run a query on everything available, handing every micro-batch to ``write``. With a ``checkpoint`` it goes on
    where the last run with that folder stopped."""
    with rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, f"{name}-checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def updates_to_table(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Keep every micro-batch under its own ``batch`` folder, overwritten when a batch is
    repeated after a failure; the batch read has one row version per batch. With a ``checkpoint`` and ``path`` it goes on
    where the last run with them stopped."""
    spark, path = stream.sparkSession, path or fresh_path(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    each_batch(stream, name, write, mode, checkpoint)
    return spark.read.schema(T.StructType(stream.schema.fields + [T.StructField("batch", T.LongType())])).parquet(path)


def in_arrivals(events: DataFrame, slot: str, slots: int, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The updates of ``build`` over a table that arrives in ``slots`` parts, numbered from 0 by the column ``slot``. Every
    part is a run of its own that goes on where the last stopped, as after a restart."""
    spark = events.sparkSession
    source, checkpoint, path = (fresh_path(spark, f"{name}-{part}") for part in ("arriving", "checkpoint", "updates"))
    rows = events.drop(slot)
    for part in range(slots):
        events.filter(F.col(slot) == part).drop(slot).write.mode("append").parquet(source)
        updates = updates_to_table(build(spark.readStream.schema(rows.schema).parquet(source)), name, "update", checkpoint, path)
    return updates
