"""K-means in exact integers by bit planes and population counts.

A vector of 64 integers, moved up so that none is negative, is kept as one 64-bit word per bit plane:
bit i of word p is bit p of component i. The dot product of two such vectors is the sum over pairs of
planes of 2**(p + q) times the set bits of the two words' conjunction, so squared distances are exact.
The planes are written once and read in every round; a round sends one row of sums per task and
cluster, and only the centroids (k times 64 numbers) pass through the driver.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import integers as it
from tidings.llm.tables import checkpointed

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
SALT = "2:"
ROWS = 2048


class Clusters(NamedTuple):
    """Rows (vec_id, cluster, distance) and the centroids that they were last assigned to."""

    assigned: DataFrame
    centroids: list[list[int]]


def planes_of(values: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) words of (rows, 64) numbers that are not negative."""
    out = np.empty((len(values), count), dtype=np.uint64)
    for p in range(count):
        out[:, p] = np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def dot_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(rows of left, rows of right) exact dot products of two sets of planes."""
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for p in range(left.shape[1]):
        inner = np.zeros_like(total)
        for q in range(right.shape[1]):
            inner += np.bitwise_count(left[:, p, None] & right[None, :, q]).astype(np.int64) << q
        total += inner << p
    return total


def component_sums(planes: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """(k, 65) sums of the components of each cluster's rows, and their number."""
    member = np.zeros((k, len(planes)), dtype=np.float32)
    member[cluster, np.arange(len(planes))] = 1
    out = np.zeros((k, DIMS + 1), dtype=np.int64)
    for p in range(planes.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, p]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Counts below 2**24 are exact in single precision.
        out[:, :DIMS] += (member @ bits.astype(np.float32)).astype(np.int64) << p
    out[:, DIMS] = np.bincount(cluster, minlength=k)
    return out


class Assigner:
    """Nearest centroids of packed vectors, equal distances to the smaller number."""

    def __init__(self, centroids: list[list[int]], low: int, planes: int):
        values = np.array(centroids, dtype=np.int64).reshape(-1, DIMS) - low
        self.planes, self.norms = planes_of(values, planes), (values**2).sum(axis=1)

    def blocks(self, batch: pa.RecordBatch):
        """(rows, planes, cluster, distance) of consecutive rows (vec_id, planes, norm)."""
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            words = it.from_blobs(rows.column(1), np.uint64, (self.planes.shape[1],))
            norms = rows.column(2).to_numpy(zero_copy_only=False)
            squared = norms[:, None] - 2 * dot_products(words, self.planes) + self.norms[None, :]
            cluster = squared.argmin(axis=1)
            yield rows, words, cluster, squared[np.arange(len(cluster)), cluster]

    def sums(self, batches):
        """One row per task and cluster that it has vectors of."""
        k = len(self.norms)
        total = np.zeros((k, DIMS + 1), dtype=np.int64)
        for batch in batches:
            for _, words, cluster, _ in self.blocks(batch):
                total += component_sums(words, cluster, k)
        held = np.flatnonzero(total[:, DIMS])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    def nearest(self, batches):
        for batch in batches:
            for rows, _, cluster, distance in self.blocks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])


def pack(low: int, planes: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                values = it.matrix(rows.column(1)) - low
                yield pa.RecordBatch.from_arrays([rows.column(0), it.blobs(planes_of(values, planes)), pa.array((values**2).sum(axis=1))], ["vec_id", "planes", "norm"])

    return run


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT) -> Clusters | None:
    """K-means over the vectors of exactly 64 components, none null or non-finite; other rows are left out.

    Component x becomes floor(256 x), within +-2**24. Centroids start as the vectors with the smallest
    SHA-256 of ``salt`` and vec_id, rows without a vec_id last, equal hashes in the order of the
    vectors; fewer vectors make fewer centroids, and none make no result (None). A round assigns every
    row and replaces every centroid that has rows by their componentwise floor(sum / count). Rows that
    repeat are rows of their own. Other columns are not read.
    """
    rows = it.integer_rows(embeddings).filter(F.size("v") == DIMS).select("vec_id", "v")
    ends = rows.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    if ends["low"] is None:
        return None
    low, planes = ends["low"], max(1, (ends["high"] - ends["low"]).bit_length())
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in rows.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()]
    packed = checkpointed(rows.mapInArrow(pack(low, planes), "vec_id long, planes binary, norm long"))
    for _ in range(rounds):
        parts = packed.mapInArrow(Assigner(centroids, low, planes).sums, "cluster int, sums array<long>")
        for r in parts.groupBy("cluster").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS + 1)]).alias("sums")).collect():
            *sums, n = r["sums"]
            centroids[r["cluster"]] = [s // n + low for s in sums]
    return Clusters(packed.mapInArrow(Assigner(centroids, low, planes).nearest, "vec_id long, cluster int, distance long"), centroids)


def op12_popcount_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of distances beyond a long is null."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    found = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], schema)
    assigned = checkpointed(found.assigned)
    totals = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    short = lambda n: int(n) if n < 1 << 63 else None
    inertia = short(sum(totals.values()))
    per_cluster = [(n, short(t), inertia, hashlib.sha256(",".join(map(str, found.centroids[n])).encode()).hexdigest()) for n, t in totals.items()]
    # One row per centroid, at most CLUSTERS.
    named = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in SQL: rounds written one after the other, every vector against every centroid."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), v) - 1 AS cluster, v AS c FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{SALT}' || vec_id), v) <= {clusters})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT row, vec_id, v, (best).cluster AS cluster, (best).d AS distance FROM (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'cluster': cluster}}) AS best "
            f"FROM (SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{n}) GROUP BY row))"
        )
        if n < rounds:
            steps.append(
                f"m{n} AS MATERIALIZED (SELECT cluster, list(((s - ((s % k) + k) % k) // k) ORDER BY pos) AS c FROM (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS k "
                f"FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMS})) AS pos FROM a{n}) GROUP BY cluster, pos) GROUP BY cluster)"
            )
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""
