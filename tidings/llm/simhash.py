"""SimHash near duplicates by meeting in the middle of Hamming balls.

Every distinct fingerprint is sent to all fingerprints within half the distance (itself and its
one-bit neighbours for a distance of 2). Two fingerprints within the distance meet at one of them at
least; two that meet are within the distance. Only one-to-64 bits apart fit around a meeting place, so
at most 65 distinct fingerprints meet there, however many copies a text has: copies share a
fingerprint and are grouped before anything is sent.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tidings.llm import buffers
from tidings.llm.graph import components
from tidings.llm.tables import checkpointed, documents_of, free_name

SHINGLE = 3
DISTANCE = 2
BITS = 64
BLOCK = 1 << 19


def votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: bits set in over half of them; 0 for an empty run."""
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.zeros((len(counts), BITS), dtype=np.int64)
    for a in range(0, len(hashes), BLOCK):
        b = min(a + BLOCK, len(hashes))
        own = np.flatnonzero((counts > 0) & (starts < b) & (ends > a))
        bits = np.unpackbits(np.ascontiguousarray(hashes[a:b], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total[own] += np.add.reduceat(bits, np.maximum(starts[own] - a, 0), axis=0, dtype=np.int32)
    set_ = 2 * total > counts[:, None]
    return np.packbits(set_, axis=1).view(">u8").astype(np.uint64).reshape(-1).view(np.int64)


def fingerprint_batches(shingle: int):
    import xxhash

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for rows, data, offsets in buffers.byte_groups(batches):
            raw, hashes, counts = data.tobytes().lower(), [], np.zeros(rows.num_rows, dtype=np.int64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words = raw[a:b].split()
                if not words:
                    continue
                joined = b" ".join(words)
                if len(words) < shingle:
                    found = [digest(joined, 42)]
                else:
                    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                    ends = np.cumsum(lengths + 1) - 1
                    begins = ends - lengths
                    found = [digest(joined[s:e], 42) for s, e in zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
                counts[i] = len(found)
                hashes.append(np.array(found, dtype=np.uint64))
            prints = votes(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(prints)], ["doc_id", "text_key", "simhash"])

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, simhash) of every whole text; bytes.lower() and split() touch ASCII only,
    as the rule asks. No words: fingerprint 0. Fewer words than a shingle: the whole sequence."""
    return documents_of(documents).mapInArrow(fingerprint_batches(shingle), "doc_id long, text_key long, simhash long")


def ball_masks(radius: int) -> list[int]:
    masks = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of distinct fingerprints at most ``distance`` bits apart, verified. At each meeting
    place all are linked to the smallest there, which keeps every connection. Null gives no link."""
    if distance % 2:
        raise ValueError("the distance must be even: balls of half of it meet")
    sent = prints.select("simhash", F.explode(F.array(*[F.col("simhash").bitwiseXOR(F.lit(m).cast("bigint")) for m in ball_masks(distance // 2)])).alias("meet"))
    least = F.min("simhash").over(Window.partitionBy("meet"))
    met = sent.withColumn("least", least).filter("simhash > least").select(F.col("simhash").alias("a"), F.col("least").alias("b")).distinct()
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_groups(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, simhash, root, component_id): component_id is the smallest doc_id that can
    be reached over links, the document itself included; root is a fingerprint of the component.

    Null and wordless texts have fingerprint 0 and are linked like others. A null doc_id names no
    component, it belongs to that of its fingerprint (null if that has no other). Repeated rows give
    repeated rows. An empty table gives no rows.
    """
    marked = checkpointed(fingerprints(documents, shingle))
    prints = checkpointed(marked.groupBy("simhash").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints.select("simhash"), distance)).withColumnRenamed("node", "simhash")
    rooted = checkpointed(prints.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = rooted.join(named, "root").select("simhash", "root", "component_id")
    return marked.join(by_print, "simhash").select("doc_id", "text_key", "simhash", "root", "component_id")


def first_of_groups(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents, all columns as they came, with one document of each root in ``groups`` (doc_id,
    text_key, root): the one with the smallest doc_id (a null doc_id only if the group has no other;
    then the smallest text hash)."""
    order = F.struct(F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).max))).alias("at"), F.col("text_key"), F.col("doc_id").alias("id"))
    one, key = free_name(documents, "_id"), free_name(documents, "_key")
    keep = groups.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.id").alias(one), F.col("k.text_key").alias(key))
    same = documents["doc_id"].cast("bigint").eqNullSafe(keep[one]) & (F.xxhash64(documents["text"].cast("string")) == keep[key])
    # Rows that repeat the chosen one as a whole are the same document.
    return documents.join(keep, same, "inner").dropDuplicates([one, key]).select(*documents.columns)


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents, all columns as they came, with one document of each group."""
    return first_of_groups(documents, near_groups(documents, shingle, distance))


def op1_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
