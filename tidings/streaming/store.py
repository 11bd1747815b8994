"""Per-batch tables: every micro-batch owns one folder, so running it again replaces its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.session import ensure_checkpoint_dir


EMPTY = -1


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def open_table(spark: SparkSession, folder: str, schema) -> None:
    """An empty first batch, so that the table can be read before any other is written."""
    write_batch(spark.createDataFrame([], schema), folder, EMPTY)


def read_batches(spark: SparkSession, folder: str, schema, before: int | None = None) -> DataFrame:
    """Rows of all finished batches, or of those before one batch."""
    rows = spark.read.schema(schema).parquet(folder)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the last batch per key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def run_available(stream: DataFrame, folder: str, handle, mode: str = "append") -> None:
    """Process everything that has arrived, calling ``handle(rows, batch_id)`` per micro-batch."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
