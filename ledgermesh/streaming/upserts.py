"""Change streams into keyed tables, and aggregates that follow updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.changefeed import current_rows


def read_changes(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of change files: what is there first, then what is added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def upsert_stream(changes: DataFrame, key: str, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append each micro-batch to the key's change log under its batch number.

    A batch written again after a restart replaces its own folder, so replay changes
    nothing; readers take the current rows from the log (latest_table).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.filter(f"{key} is not null").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    w = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest_table(spark: SparkSession, folder: str, key: str, tie: Sequence[str] = ()) -> DataFrame:
    """The current rows of an upsert stream's log."""
    return current_rows(spark.read.parquet(folder).drop("batch"), key, tie=tie)


def compact(spark: SparkSession, folder: str, key: str, target: str) -> None:
    """Write the current rows as a snapshot of its own."""
    latest_table(spark, folder, key).write.mode("overwrite").parquet(target)
