"""Keys that let near neighbours meet in an equi-join, without loss.

Every pair within the distance shares at least one key; pairs that share a key are verified, so
keys never change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidings.session import checkpointed

BITS = 64
MAX_PIVOT_BYTES = 64 << 20
LEAST_GAP = 1e-4
BLOCK = 500


def block_masks(distance: int, intact: int) -> list[int]:
    """Masks over ``distance + intact`` blocks: with at most ``distance`` bits flipped, at least
    ``intact`` blocks are untouched, so one of the combinations agrees."""
    blocks = distance + intact
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), intact)]


def simhash_keys(simhash: Column, distance: int, intact: int = 2) -> Column:
    """Array of block keys; empty for a null fingerprint."""
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in block_masks(distance, intact)]
    keys = F.array(*[F.xxhash64(F.lit(n), simhash.bitwiseAND(F.lit(m).cast("bigint"))) for n, m in enumerate(signed)])
    return F.when(simhash.isNotNull(), keys).otherwise(F.array().cast("array<bigint>"))


def chord(cosine: float) -> float:
    """Distance of unit vectors at the cosine, with room for rounding."""
    return float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) + 1e-6


class PivotTree:
    """Two levels of pivots that cut the unit vectors into cells.

    A vector lives in the cell of the nearest lower pivot under the nearest upper pivot. ``rings`` holds
    per cell how near and how far its members are from its pivot, once that is known. A cell can hold a vector within a
    radius of another one only if neither the plane between two sibling pivots nor the ring is farther
    away than that.
    """

    def __init__(self, pivots: np.ndarray):
        upper = pivots[: max(1, int(np.ceil(np.sqrt(len(pivots)))))]
        owner = _squared(pivots, upper).argmin(axis=1)
        order = np.argsort(owner, kind="stable")
        self.upper, self.lower = upper, pivots[order]
        self.first = np.searchsorted(owner[order], np.arange(len(upper) + 1))
        self.rings = np.tile([-np.inf, np.inf], (len(pivots), 1))

    def homes(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of every vector."""
        upper = _squared(block, self.upper).argmin(axis=1)
        cell, apart = np.empty(len(block), dtype="int64"), np.empty(len(block))
        for u in np.unique(upper).tolist():
            rows = np.flatnonzero(upper == u)
            squared = _squared(block[rows], self._children(u))
            near = squared.argmin(axis=1)
            cell[rows], apart[rows] = self.first[u] + near, np.sqrt(squared[np.arange(len(rows)), near])
        return cell, apart

    def reached(self, block: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that may hold a vector within ``radius`` of the row, rows ascending."""
        rows, cells = [], []
        near_upper = _within_planes(_squared(block, self.upper), self.upper, radius)
        for u in np.flatnonzero(near_upper.any(axis=0)).tolist():
            own = np.flatnonzero(near_upper[:, u])
            children = slice(self.first[u], self.first[u + 1])
            squared = _squared(block[own], self._children(u))
            apart, (low, high) = np.sqrt(squared), self.rings[children].T
            open_cells = _within_planes(squared, self._children(u), radius) & (apart <= high + radius) & (apart >= low - radius)
            r, c = np.nonzero(open_cells)
            rows.append(own[r])
            cells.append(self.first[u] + c)
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return rows[order], cells[order]

    def _children(self, u: int) -> np.ndarray:
        return self.lower[self.first[u] : self.first[u + 1]]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


def _within_planes(squared: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Which pivots' cells begin no farther than ``radius`` away, by the plane to the nearest pivot."""
    home = squared.argmin(axis=1)
    gap = np.sqrt(_squared(pivots, pivots))[home]
    depth = (squared - squared[np.arange(len(home)), home][:, None]) / (2 * np.maximum(gap, LEAST_GAP))
    return (depth <= radius) | (gap < LEAST_GAP)


class Placed(NamedTuple):
    """The rows with ``home``, the key of their cell (null without a vector), the tree that placed them,
    and the share of the cells that vectors of a sample reach."""

    rows: DataFrame
    tree: PivotTree | None
    share: float

    def home(self, vector: Column) -> Column:
        """The key of the vector's cell as an array; empty for null."""
        if self.tree is None:
            return F.transform(_cells(None, 0.0)(vector), _key)
        return F.when(vector.isNotNull(), F.array(_key(_homes(self.tree)(vector)["cell"]))).otherwise(F.array().cast("array<bigint>"))

    def reach(self, vector: Column, radius: float) -> Column:
        """Keys of all cells that may hold a row within ``radius`` of the vector; empty for null."""
        return F.transform(_cells(self.tree, radius)(vector), _key)


def _key(cell: Column) -> Column:
    return F.xxhash64(F.lit("cell"), cell)


def place(rows: DataFrame, id_col: str, vector_col: str, radius: float) -> Placed:
    """Cells for the unit vectors of ``rows``, which must be a written table.

    The tree has about the square root of the rows as lower pivots, drawn by hash, as far as they fit
    ``MAX_PIVOT_BYTES``. Where vectors have no structure to cut along and a sample of them reaches more
    than half of the cells within ``radius``, cells would only repeat rows, and there is one for all.
    """
    held = rows.filter(F.col(vector_col).isNotNull())
    count = held.count()
    first = held.select(F.size(vector_col).alias("n")).first()
    wanted = int(np.ceil(np.sqrt(count))) if count else 0
    most = MAX_PIVOT_BYTES // (8 * max(1, first["n"])) if count else 0
    drawn = held.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(vector_col).alias("v")).orderBy("h", "v").limit(min(wanted, most)).collect() if count else []
    pivots = np.array(list(dict.fromkeys(tuple(r["v"]) for r in drawn)), dtype="float64")
    if len(pivots) < 2:
        return Placed(rows.withColumn("home", F.when(F.col(vector_col).isNotNull(), _key(F.lit(0).cast("bigint")))), None, 1.0)
    tree = PivotTree(pivots)
    homed = checkpointed(rows.withColumn("_home", _homes(tree)(F.col(vector_col))))
    tree.rings = np.tile([np.inf, -np.inf], (len(pivots), 1))
    for r in homed.filter("_home is not null").groupBy("_home.cell").agg(F.min("_home.apart").alias("low"), F.max("_home.apart").alias("high")).collect():
        tree.rings[r["cell"]] = r["low"] - 1e-6, r["high"] + 1e-6
    sample = pivots[:1000]
    share = len(tree.reached(sample, radius)[0]) / len(sample) / max(1, int(np.isfinite(tree.rings[:, 0]).sum()))
    if share > 0.5:
        return Placed(rows.withColumn("home", F.when(F.col(vector_col).isNotNull(), _key(F.lit(0).cast("bigint")))), None, share)
    return Placed(homed.withColumn("home", _key(F.col("_home.cell"))).drop("_home"), tree, share)


def _filled(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(vectors.notna().to_numpy())
    return rows, np.stack([np.asarray(vectors.iloc[i], dtype="float64") for i in rows]) if len(rows) else np.zeros((0, 1))


def _homes(tree: PivotTree):
    @F.pandas_udf("cell bigint, apart double")
    def homes(vectors: pd.Series) -> pd.DataFrame:
        rows, block = _filled(vectors)
        out = pd.DataFrame({"cell": pd.array([None] * len(vectors), dtype="Int64"), "apart": pd.array([None] * len(vectors), dtype="Float64")})
        if len(rows):
            cell, apart = tree.homes(block)
            out.loc[rows, "cell"], out.loc[rows, "apart"] = cell, apart
        return out

    return lambda vector: F.when(vector.isNotNull(), homes(vector))


def _cells(tree: PivotTree | None, radius: float):
    if tree is None:
        return lambda vector: F.when(vector.isNotNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    @F.pandas_udf("array<bigint>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = [np.zeros(0, dtype="int64")] * len(vectors)
        rows, block = _filled(vectors)
        if len(rows):
            row, cell = tree.reached(block, radius)
            for n, own in zip(rows.tolist(), np.split(cell, np.searchsorted(row, np.arange(1, len(rows))))):
                out[n] = own
        return pd.Series(out)

    return cells


# --- blocks of vectors


def packed(df: DataFrame, columns: list[str], vector: str, by: list[str] = (), rows: int = BLOCK) -> DataFrame:
    """Rows as blocks of at most ``rows``: (``by``, an array per column, and the vectors one after the
    other in one array). With ``by`` the rows of a block agree in these; they are dealt out by them first,
    where a value with very many rows is spread over several tasks."""
    if by:
        df = df.hint("rebalance", *by).sortWithinPartitions(*by)
    fields = {c: df.schema[c].dataType.simpleString() for c in (*by, *columns)}
    schema = ", ".join([*[f"{c} {fields[c]}" for c in by], *[f"{c}s array<{fields[c]}>" for c in columns], f"{vector}s array<double>"])
    return df.select(*by, *columns, vector).mapInPandas(_pack(list(columns), vector, list(by), rows), schema)


def every_meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of ``left`` beside every block of ``right``. Both are written first: a product reads
    its sides more than once, and with the real size of ``right`` known it is broadcast if it is small."""
    return checkpointed(left).crossJoin(checkpointed(right))


def _pack(columns: list[str], vector: str, by: list[str], rows: int):
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            groups = part.groupby(by, sort=False, dropna=False) if by and len(part) else [((), part)]
            for key, group in groups:
                for a in range(0, len(group), rows):
                    own = group.iloc[a : a + rows]
                    flat = np.concatenate([np.asarray(v, dtype="float64") for v in own[vector]])
                    yield pd.DataFrame({**{c: [k] for c, k in zip(by, key)}, **{f"{c}s": [own[c].tolist()] for c in columns}, f"{vector}s": [flat]})

    return pack
