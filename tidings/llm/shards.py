"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; rows and bytes are summed per slot; a versioned map says
which shard holds which slot. Rebalancing writes a further version of the map in which only the
slots that must move have changed. Only the slot totals (at most ``SLOTS`` rows) reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tidings.llm.tables import checkpointed, documents_of

SLOTS = 4096
SCHEMA = "version int, virtual_slot int, shard int, n_rows long, n_bytes long"


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, spread): the record's slot hangs on its doc_id alone.

    A null text has no bytes and no checksum; a null doc_id hashes like a value of its own.
    ``spread`` orders equal doc_ids.
    """
    docs = documents_of(records)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8
    slot = F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(slots)).cast("int")
    return docs.select("doc_id", size.alias("size"), F.crc32("text").cast("bigint").alias("text_crc32"), slot.alias("virtual_slot"), F.col("text_key").alias("spread"))


def slot_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def even_map(slots: int, shards: int) -> np.ndarray:
    """The map before any size is known: neighbouring slots in neighbouring shards."""
    return np.arange(slots) % shards


def rebalanced(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map edited until no move or swap of slots between the heaviest and the lightest shard
    narrows their gap. Slots that need not move stay."""
    owner = owner.copy()
    totals = np.bincount(owner, weights=load, minlength=shards)[:shards]
    mean = totals.sum() / shards
    pool = []
    for shard in np.flatnonzero(totals > mean):
        own = np.flatnonzero(owner == shard)
        for slot in own[np.argsort(load[own], kind="stable")]:
            if totals[shard] - load[slot] < mean:
                break
            totals[shard] -= load[slot]
            pool.append(slot)
    for slot in sorted(pool, key=lambda s: (-load[s], s)):
        owner[slot] = shard = int(totals.argmin())
        totals[shard] += load[slot]
    for _ in range(64 * shards):
        high, low = int(totals.argmax()), int(totals.argmin())
        gap = totals[high] - totals[low]
        give, take = np.flatnonzero(owner == high), np.flatnonzero((owner == low) & (load > 0))
        moved = np.concatenate([load[give][:, None] - load[take][None, :], load[give][:, None]], axis=1)
        left = np.abs(gap - 2 * moved)
        best = int(left.argmin())
        if not len(give) or left.flat[best] >= gap:
            break
        i, j = divmod(best, moved.shape[1])
        owner[give[i]] = low
        if j < len(take):
            owner[take[j]] = high
        totals[high] -= moved[i, j]
        totals[low] += moved[i, j]
    return owner


def slot_map(totals: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """All versions of the map as a written table: version 1 is even, version 2 is rebalanced by
    the bytes. A further rebalancing starts from the owners of the last version in the same way."""
    spark = totals.sparkSession
    rows, load = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in totals.collect():
        rows[r["virtual_slot"]], load[r["virtual_slot"]] = r["n_rows"], r["n_bytes"]
    first = even_map(slots, shards)
    maps = [(1, first), (2, rebalanced(first, load.astype(float), shards))]
    frame = pd.concat([pd.DataFrame({"version": v, "virtual_slot": np.arange(slots), "shard": m, "n_rows": rows, "n_bytes": load}) for v, m in maps])
    return checkpointed(spark.createDataFrame(frame, SCHEMA).coalesce(1))


def sharded(records: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Every record with its shard by the newest map, and its place in the shard.

    (doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version). ``slot`` counts
    the records of a shard from 0 without gaps: by virtual slot, then doc_id. Places are numbered
    inside a virtual slot and shifted by the rows of the slots before it, so no task sees a whole
    shard. An empty table gives no rows. Rows that repeat a doc_id get places of their own.
    """
    records = checkpointed(slotted(records, slots))
    versions = slot_map(slot_totals(records), shards, slots)
    newest = versions.filter(F.col("version") == 2)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    newest = newest.select("version", "virtual_slot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "spread")
    placed = records.withColumn("place", F.row_number().over(inside))
    # At most SLOTS rows by construction.
    return placed.join(F.broadcast(newest), "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("shift") + F.col("place") - 1).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "version",
    )


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
