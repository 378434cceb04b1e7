"""Running streams to a table and reading that table back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wattgrid.session import own_folder
from wattgrid.sources.adapters import Tables

#: What a stream over files reads in one batch at most, so that a series' rows of one batch fit a task.
BYTES_PER_BATCH = 4 << 30


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the files of a parquet table, in bounded batches, with event times that watermarks accept."""
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_BATCH).parquet(path)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, k in stream.dtypes if k == "timestamp_ntz"})


def replayed(df: DataFrame, name: str) -> DataFrame:
    """A table written to a folder of its own and read again as a stream."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(f"{folder}/rows")
    return file_stream(df.sparkSession, f"{folder}/rows", df.schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return own_folder(spark, "streams", f"{name}-{uuid.uuid4().hex}")


def finish(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for an ``availableNow`` query; with ``seconds``, stop it and fail when it takes longer."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream {query.name or query.id} was still running after {seconds} s")


class StreamTables(Tables):
    """The driver's tables as file streams, with event times that watermarks accept.

    A table is one file or a folder of parts. The path is a pattern that only the table's name fits,
    since a stream lists what a pattern finds, file or folder.
    """

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return file_stream(self.spark, f"{self.sf_dir}/{name}.parque[t]", schema)


def append_table(stream: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append the stream to a new parquet table until its input is used up."""
    folder = new_folder(stream.sparkSession, name)
    writer = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    finish(writer.option("checkpointLocation", f"{folder}/state").start(f"{folder}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_changes(stream: DataFrame, path: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Write each batch of changed rows as its own part of a change table.

    A repeated batch overwrites its part, so a restart changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def has_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_changes(spark: SparkSession, path: str, schema, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Latest row per key of a change table: the last batch wins, then the last by ``order``.

    ``max_by`` keeps one row per key in each task before the shuffle.
    """
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if has_folder(spark, f"{path}/rows"):
        rows = spark.read.schema(full).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    else:  # a stream without input writes no batch
        rows = spark.createDataFrame([], full)
    plain = [c for c in rows.columns if c != "batch" and c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*plain), F.struct("batch", *order)).alias("_r"))
    return latest.select(*keys, "_r.*")


def compact_changes(spark: SparkSession, path: str, target: str, schema, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Write the latest rows to a plain table for readers that need no history."""
    read_changes(spark, path, schema, keys, order).write.mode("overwrite").parquet(target)


def latest_table(stream: DataFrame, name: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Run an updating stream to its end and read the final row of each key."""
    folder = new_folder(stream.sparkSession, name)
    finish(write_changes(stream, folder))
    return read_changes(stream.sparkSession, folder, stream.schema, keys, order)


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], folder: str) -> None:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/state")
    finish(writer.trigger(availableNow=True).start())
