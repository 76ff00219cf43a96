"""Incremental forms of filter, deduplication and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import text_hash


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filtered(stream: DataFrame, keep: Column) -> DataFrame:
    return stream.where(keep)


def windowed_counts(stream: DataFrame, time: str, key: str, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def dedup_into(stream: DataFrame, order: str, text: str, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the first row of each text over all batches: a batch's own firsts, less those whose hash the store has.

    The store is a parquet folder of (order, hash, part, batch), one subfolder a batch, overwritten if a batch is tried again, and in
    it one a part of the hashes; of earlier batches only the hashes are read, and only of the parts that the batch has.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        firsts = df.select(order, text_hash(F.col(text)).alias("h")).groupBy("h").agg(F.min(order).alias(order)).withColumn("part", F.substring("h", 1, 2))
        try:
            parts = [r["part"] for r in firsts.select("part").distinct().collect()]  # at most 256
            seen = spark.read.parquet(store).where((F.col("batch") != number) & F.col("part").isin(parts)).select("h", "part")
            firsts = firsts.join(seen, ["h", "part"], "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        firsts.write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that has arrived so far, into a parquet folder."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path=sink, format="parquet").awaitTermination()


def complete_into(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """The whole state of an aggregation after each batch, over the parquet folder of the batch before."""
    return batch_sink(lambda df, _: df.write.mode("overwrite").parquet(sink), stream, checkpoint, "complete")


def batch_sink(write: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
