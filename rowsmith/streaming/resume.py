"""File streams that resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowsmith.operators.dedupe import keep_last
from rowsmith.sources.project import ProjectTable


def new_files(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the rows of ``folder``'s files; a batch has at most ``files_per_batch`` of them."""
    source = spark.readStream.schema(schema).format(form)
    return (source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source).load(folder)


def process_new_files(
    spark: SparkSession, folder: str, schema: StructType, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, form: str = "parquet", out_form: str = "parquet", files_per_batch: int | None = None, flush: int | None = None
) -> None:
    """Run ``step`` over the files that earlier runs have not seen, append to ``out``, and stop when none is left.

    The checkpoint remembers files, so that a run that is killed goes on where it was and no row is written twice: what a
    batch has written counts once the batch is committed. A task begins a new file of ``out`` after each ``flush`` rows.
    """
    rows = step(new_files(spark, folder, schema, form, files_per_batch))
    writer = rows.writeStream.format(out_form).option("path", out).option("header", True).option("checkpointLocation", checkpoint)
    (writer.option("maxRecordsPerFile", flush) if flush else writer).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, apply: Callable[[DataFrame], None], form: str = "parquet") -> None:
    """Hand each batch of new rows to ``apply``, which merges it into a table by key."""
    source = spark.readStream.schema(schema).format(form).load(folder)
    source.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sync_batch(table: ProjectTable, batch: DataFrame, number: int, key: Sequence[str], order_by: Sequence[str], stamp: Column, stream: str = "stream") -> bool:
    """Upsert one batch by ``key`` into ``table``: the last row of each key by ``order_by`` replaces the table's, with ``synced_at``.

    The number of the batch is committed with the rows, in one step, under the name of the stream: a batch that comes again, because
    the run was killed before its checkpoint knew of it, changes nothing and gives False. Rows that the batch lacks keep their ``synced_at``.
    """
    while True:
        at = table.last()
        done = table.notes(at)
        if done.get(stream, -1) >= number:
            return False
        new = keep_last(batch, key, order_by).withColumn("synced_at", stamp)
        if at is not None:
            old = table.load()
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
            kept = old.alias("o").join(new.select(*key).alias("n"), same, "left_anti")
            new = kept.unionByName(new)
        if table.save(new, {**done, stream: number}, after=at):
            return True


def sync_stream(rows: DataFrame, checkpoint: str, table: ProjectTable, key: Sequence[str], order_by: Sequence[str], stamp: Callable[[int], Column] = lambda _: F.current_timestamp(), mode: str = "append") -> None:
    """Upsert what a stream has, batch after batch, until nothing is left; the checkpoint and the table's own notes make each batch count once."""
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer.foreachBatch(lambda batch, number: sync_batch(table, batch, number, key, order_by, stamp(number)) and None).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their sum for each window and type; on a stream, windows close ``late`` after the newest event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def not_processed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return rows.join(done.select(key), key, "left_anti")
