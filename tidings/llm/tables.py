"""Cutting lineage, reading the given tables and naming rows, for the operators of this package."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.session import checkpointed, ensure_checkpoint_dir  # noqa: F401  written table in the shared folder


BATCH_ROWS = 1_000


def in_short_batches(plan):
    """A query or stage whose documents travel to Python in batches of ``BATCH_ROWS``.

    The setting holds when the plan runs, so it stays in the session. Spark's own 10,000 rows would
    hold tens of megabytes of text in the executor and again in each of its workers.
    """

    @functools.wraps(plan)
    def run(spark: SparkSession, *args) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return plan(spark, *args)

    return run


class Passing:
    """Written tables in the shared folder that go when they are no longer read.

    A table may be dropped once all that is read from it has been written itself; at the end of the
    block the rest goes. What leaves the block must be written by ``checkpointed``.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.folders = spark, {}

    def __enter__(self):
        return self

    def write(self, df: DataFrame) -> DataFrame:
        folder = f"{self.spark.sparkContext.getCheckpointDir()}/passing-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        found = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(found)] = (folder, found)
        return found

    def drop(self, *tables: DataFrame) -> None:
        for found in tables:
            folder, _ = self.folders.pop(id(found))
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_) -> None:
        self.drop(*[found for _, found in list(self.folders.values())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the caller's table does not have."""
    while name in df.columns:
        name += "_"
    return name


def documents_of(df: DataFrame) -> DataFrame:
    """Only (doc_id, text, text_key): whatever other columns the caller has, none can clash.

    ``text_key`` tells rows apart that share a doc_id; it is the hash of the text, and the hash of
    nothing for a null text.
    """
    return df.select(df["doc_id"].cast("bigint").alias("doc_id"), df["text"].cast("string").alias("text"), F.xxhash64(df["text"].cast("string")).alias("text_key"))


