"""Streaming jobs: sources, exactly-once file sinks and the incremental label refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators import feedback as fb
from ..sources import keyed_log, snapshots
from ..sources.sinks import insert_if_absent, upsert_partitions
from .pairs import latest_interactions


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def run_to_table(stream: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Drain what the source holds now into an exactly-once parquet sink and return the table.

    The checkpoint sits beside the table, so a later run goes on where this one ended.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}_checkpoint")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    job = writer.trigger(availableNow=True).start(path)
    job.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)


def _drain(stream: DataFrame, step, mode: str, checkpoint: str) -> None:
    job = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def run_to_upserts(stream: DataFrame, path: str, keys: list[str], partition: str) -> DataFrame:
    """Drain a windowed aggregate into a table that holds open windows too, and return the table.

    Every micro-batch replaces the windows that it has changed, so a window shows its count so
    far and the table is complete at any time. A batch that runs again changes nothing.
    """
    spark = stream.sparkSession
    _drain(stream, lambda batch, _: upsert_partitions(spark, path, batch, keys, partition), "update", f"{path}_checkpoint")
    table = snapshots.current(spark, path)
    return snapshots.rows_of(spark, table) if table.exists else spark.createDataFrame([], stream.schema)


def run_to_inserts(stream: DataFrame, path: str, keys: list[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """Drain a stream into a log that takes each key once, whenever it comes again, and return its rows.

    Of the rows of a micro-batch with one key, the first by ``order`` is taken, then by its digest.
    """
    spark = stream.sparkSession
    _drain(stream, lambda batch, _: insert_if_absent(spark, path, batch, keys, order), "append", f"{path}_checkpoint")
    return keyed_log.read(spark, path) if snapshots.current(spark, path).exists else spark.createDataFrame([], stream.schema)


def refresh_labels(stream: DataFrame, labels_path: str, label_date: str, days: int = 30) -> None:
    """Keep the labels of a date current from a stream of typed events.

    The signals of a (user, item) pair are keyed state, so a micro-batch reads its own events only
    and upserts the labels of the pairs it touches. A batch that runs again gives the same rows.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, _: int) -> None:
        rows = fb.with_label(batch).withColumn("label_date", F.lit(label_date).cast("date"))
        rows = rows.select("user_id", "item_id", "label", "recommendation_id", "last_interaction", "label_date")
        upsert_partitions(spark, labels_path, rows, ["user_id", "item_id", "label_date"], "label_date")

    _drain(latest_interactions(stream, label_date, days), step, "update", f"{labels_path}_checkpoint")
