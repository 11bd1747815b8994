"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated at random and split into blocks of few dimensions. Two vectors within the
squared distance that belongs to the cosine are, in one block at least, within that block's share of
it. Every block is range-joined by a grid over its first dimensions: a vector lies in one cell and
visits the later ones that its radius touches, so a pair meets once. The union of the pairs found is
verified exactly on the given vectors. Equal vectors are one class before anything is joined, and
classes are only ever compared inside their label.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.llm.graph import components
from tidings.llm.tables import checkpointed

COSINE = 0.98
BLOCK_DIMS = 8
GRID_DIMS = 3
ROWS = 4096


def comparable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def block_edges(dims: int) -> list[tuple[int, int]]:
    count = max(1, (dims + BLOCK_DIMS // 2) // BLOCK_DIMS)
    edges = [i * dims // count for i in range(count + 1)]
    return list(zip(edges[:-1], edges[1:]))


def cell_rows(cosine: float, visiting: bool):
    """Per class and block its own cell, or with ``visiting`` its own and all later cells that its
    radius touches. Coordinates travel in single precision; the budget has room for that."""
    names = ["id", "label", "dims", "block", "cell", "own", *[f"x{i}" for i in range(BLOCK_DIMS + BLOCK_DIMS // 2)]]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids, labels = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
                vectors = rows.column(2).to_pylist()
                sizes = np.array([len(v) for v in vectors])
                for dims in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dims)
                    block = np.array([vectors[i] for i in own.tolist()], dtype=np.float64)
                    # Scaled first: squares of very large or small components stay finite.
                    block /= np.abs(block).max(axis=1, keepdims=True)
                    block /= np.sqrt((block**2).sum(axis=1, keepdims=True))
                    yield from blocks(block @ rotation(dims), ids[own], labels[own], dims)

    def blocks(turned, ids, labels, dims):
        for number, (a, b) in enumerate(block_edges(dims)):
            radius = np.sqrt(budget(cosine, dims, b - a))
            grid = turned[:, a : min(b, a + GRID_DIMS)] / (2 * radius)
            home = np.floor(grid).astype(np.int64)
            inside = grid - home
            for move in product((-1, 0, 1), repeat=grid.shape[1]):
                if move < (0,) * grid.shape[1] or (any(move) and not visiting):
                    continue
                away = np.where(np.array(move) > 0, 1 - inside, np.where(np.array(move) < 0, inside, 0.0))
                keep = np.flatnonzero((away**2).sum(axis=1) <= 0.25)
                if not len(keep):
                    continue
                cell = np.zeros(len(keep), dtype=np.int64)
                for k in range(grid.shape[1]):
                    cell = (cell << 20) + (home[keep, k] + move[k] & 0xFFFFF)
                n = len(keep)
                fill = [pa.array(turned[keep, a + i] if a + i < b else np.zeros(n), pa.float32()) for i in range(BLOCK_DIMS + BLOCK_DIMS // 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array(labels[keep]), pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(cell), pa.array(np.full(n, not any(move))), *fill], names
                )

    return run


def budget(cosine: float, dims: int, own: int) -> float:
    """A block's share of the squared distance, with room for rounding."""
    return (2 - 2 * cosine) * own / dims * (1 + 1e-4) + 1e-6


def candidates(classes: DataFrame, cosine: float) -> DataFrame:
    """(a, b) of class ids that are close in some block; a superset of all links between classes."""
    xs = [f"x{i}" for i in range(BLOCK_DIMS + BLOCK_DIMS // 2)]
    schema = f"id long, label {classes.schema['label'].dataType.simpleString()}, dims int, block int, cell long, own boolean, " + ", ".join(f"{x} float" for x in xs)
    keys = ["label", "dims", "block", "cell"]
    parts = classes.select("id", "label", "vector")
    visits = parts.mapInArrow(cell_rows(cosine, True), schema)
    homes = parts.mapInArrow(cell_rows(cosine, False), schema).select(*keys, F.col("id").alias("other"), *[F.col(x).alias(f"o{x}") for x in xs])
    apart = reduce(lambda s, t: s + t, [(F.col(x).cast("double") - F.col(f"o{x}")) * (F.col(x).cast("double") - F.col(f"o{x}")) for x in xs])
    share = F.lit((2 - 2 * cosine) * (1 + 1e-4)) / F.col("dims")
    # A block's dimensions: an even split, so their number follows from the block's number.
    count = F.greatest(F.lit(1), F.floor((F.col("dims") + BLOCK_DIMS // 2) / BLOCK_DIMS)).cast("int")
    own_dims = F.floor((F.col("block") + 1) * F.col("dims") / count) - F.floor(F.col("block") * F.col("dims") / count)
    near = apart <= share * own_dims + 1e-5
    once = (~F.col("own") & (F.col("id") != F.col("other"))) | (F.col("other") > F.col("id"))
    met = visits.join(homes, keys).filter(once & near)
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def cosine_of(x: str, y: str) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    return dot / F.sqrt(total(F.transform(F.col(x), lambda e: e * e)) * total(F.transform(F.col(y), lambda e: e * e)))


def linked(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, zero or hold null or non-finite components, vectors without a label, and
    rows without a vec_id link with nothing: no links, a component of their own (null without a
    vec_id, and then not kept). Vectors of different length never link. Rows that repeat a vec_id
    are one vector. An empty table gives no rows.
    """
    rows = embeddings.select(embeddings["vec_id"].cast("bigint").alias("vec_id"), embeddings["label"].alias("label"), embeddings["embedding"].cast("array<double>").alias("vector"))
    fit = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & comparable(F.col("vector"))).distinct()
    classes = checkpointed(fit.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    sides = [classes.select(F.col("id").alias(s), F.col("label").alias(f"label_{s}"), F.col("vector").alias(f"vector_{s}")) for s in ("a", "b")]
    pairs = checkpointed(candidates(classes, cosine)).join(sides[0], "a").join(sides[1], "b").filter("label_a = label_b and size(vector_a) = size(vector_b)")
    links = checkpointed(pairs.filter(cosine_of("vector_a", "vector_b") >= cosine).select("a", "b").distinct())
    sizes = classes.groupBy("id").agg(F.sum("n").alias("n"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    roots = components(links)
    rooted = sizes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = checkpointed(rooted.join(degree, "id", "left").select("id", "root", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "n_links", "component")
    members = fit.join(classes.select("label", "vector", "id"), ["label", "vector"]).select("vec_id", "id").groupBy("vec_id").agg(F.min("id").alias("id"))
    found = members.join(named, "id").select("vec_id", "n_links", "component")
    alone = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), alone.alias("component_id"), F.coalesce(alone == F.col("vec_id"), F.lit(False)).alias("kept"))


def op5_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
