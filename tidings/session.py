"""Session set-up, reliable checkpoints and the size checks used before a broadcast."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tidings", cpus: str = "*") -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    A private folder is chosen only for a local master with the setting unset, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidings-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared checkpoint folder and read it back.

    The result survives lost executors, has no lineage, and carries real sizes, so later joins can
    choose a broadcast from them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def row_blocks(df: DataFrame, key: str, size: int) -> Iterator[list]:
    """The rows of a table in blocks of about ``size`` rows, one on the driver at a time.

    A table that fits is one block; a longer one is dealt out by the hash of ``key``. The rows that
    meet the blocks pass from one to the next, so any length works the same way.
    """
    count = max(1, math.ceil(df.count() / size))
    for n in range(count):
        block = df if count == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(count)) == n)
        yield block.collect()
