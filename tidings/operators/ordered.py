"""Running totals and ordered batches that never sort a whole group in one task.

Rows are range-partitioned on (group, order), so even a group with most of the rows spreads over
many tasks. Each slice is totalled on its own; the offsets of a slice come from the small table of
slice totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tidings.session import checkpointed


def running_totals(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add, per name in ``sums``, the sum of its expression over the group's rows up to this one.

    ``order`` must identify a row within its group. The sliced rows are written to the checkpoint
    folder once, so the slice numbers cannot change if a task is run again.
    """
    values = df.select("*", F.lit(0).alias("_all"), *[v.alias(f"_v_{n}") for n, v in sums.items()])
    sliced = checkpointed(values.repartitionByRange(*(group or ["_all"]), *order).withColumn("_slice", F.spark_partition_id()))
    keys = [*(group or ["_all"]), "_slice"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys[:-1]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    local = sliced.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    on = [local[k].eqNullSafe(offsets[f"_k_{k}"]) for k in keys]
    return local.join(offsets, on, "left").select(
        *[local[c] for c in df.columns],
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def batches(df: DataFrame, size: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Number the rows in order and cut them into chunks: adds ``batch_no`` and ``idx``."""
    numbered = running_totals(df, group or [], order, {"_n": F.lit(1).cast("bigint")})
    at = F.col("_n") - 1
    return numbered.select(*df.columns, F.floor(at / size).cast("bigint").alias("batch_no"), (at % size).alias("idx"))


def top_rows(df: DataFrame, k: int, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1, where the first k are what is asked for.

    Spark limits each group inside every map task first, so a hot group sends k rows per task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def most_rows(df: DataFrame, most: int | None, group: list[str], order: list[Column]) -> DataFrame:
    """All rows, or, for a caller that wants no more, the first ``most`` of each group."""
    return df if most is None else top_rows(df, most, group, order, "_n").drop("_n")


def newest_rows(df: DataFrame, most: int | None, order: list[Column]) -> DataFrame:
    """All rows, or the first ``most`` in order for a caller that wants no more."""
    return df if most is None else df.orderBy(*order).limit(most)
