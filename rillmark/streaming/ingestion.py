"""Incremental ingestion and running counters with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillmark.operators import merging
from rillmark.sources import work


def source(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they arrive in ``folder``/``name``, a bounded number in each batch;
    or, where that is one file, the file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if work.is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def distinct_texts(stream: DataFrame, group: str, text: str) -> DataFrame:
    """First-seen texts of each group, by hash.  The state grows with the distinct texts;
    give the stream a watermark to bound it."""
    hashed = stream.withColumn("text_hash", F.sha1(F.trim(F.coalesce(F.col(text), F.lit(""))).cast("binary")))
    return hashed.dropDuplicates([group, "text_hash"])


def counters(stream: DataFrame, bucket: str, event: str) -> DataFrame:
    """Running counts since the start (complete mode)."""
    return stream.groupBy(F.col(bucket).alias("bucket"), F.col(event).alias("event")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, event: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by time window with a bound on lateness: what is older is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), F.col(event).alias("event")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def upsert_into(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Write each key once, as it was first seen (``merge_into`` updates): a batch lands in a folder of its own number, without the keys
    that earlier batches hold.  One run again after a failure sees the same earlier batches
    and replaces what it wrote."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([key])
        if work.exists(spark, target):
            held = spark.read.option("basePath", target).schema(f"`{key}` {batch.schema[key].dataType.simpleString()}, batch long").parquet(target)
            rows = rows.join(held.filter(F.col("batch") < number).select(key), key, "left_anti").select(*batch.columns)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_into(stream: DataFrame, table: merging.Table, checkpoint: str, order: tuple[str, ...] = (), deleted: Column | None = None) -> StreamingQuery:
    """Merge a stream into a keyed table, batch by batch: the last row of a key stays, only
    buckets that a batch touches are read and written, and a batch that comes again after a
    failure changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        merging.merge(table, batch, order, deleted, checkpoint, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run over what is there now into Parquet files, each row once, and read them."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run over what is there now into an in-memory table: for small results only."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
