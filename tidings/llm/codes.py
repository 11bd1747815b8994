"""Vector codes from part codebooks, trained by k-means with adaptive distance bounds.

Vectors of integers are cut into equal parts, each coded by the nearest entry of its position's
codebook. Of every part a row keeps its ``b`` closest entries in order, a lower bound of the distance to
each, and one outer bound for all others. After the entries have moved, every bound falls by the way
its entry went (the outer one by the longest way). Where the exact distance to the part's entry stays
below all bounds the assignment stands; else the kept entries are compared in integers; only where the
outer bound is reached too, all entries are. Bounds are rounded down, so no result depends on them.
``b`` starts at a quarter of the entries and shrinks, to an eighth at least, to what nearly all parts
needed in the round before. The rows with their bounds are a written table from round to round; a task
sends one row of sums, and only codebooks pass through the driver.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import integers as it
from tidings.llm.tables import checkpointed

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SETTLED = 0.99
ROWS = 2048


class Codes(NamedTuple):
    """Rows (vec_id, label, code, error), the codebooks (parts, entries, components), and per round
    how many parts were settled by the bounds, by the kept entries, and by all entries."""

    rows: DataFrame
    codebooks: np.ndarray
    settled: list[tuple[int, int, int]]


def squared(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances."""
    return (part**2).sum(axis=1)[:, None] - 2 * (part @ entries.T) + (entries**2).sum(axis=1)[None, :]


def below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots in single precision."""
    return np.nextafter(np.sqrt(squares).astype(np.float32), np.float32(-np.inf))


def closest(part: np.ndarray, entries: np.ndarray, b: int):
    """(b closest entries in order, their squared distances, the outer bound), by all distances."""
    squares = squared(part, entries)
    order = np.argsort(squares, axis=1, kind="stable")
    ordered = np.take_along_axis(squares, order, axis=1)
    outer = below(ordered[:, b]) if b < len(entries) else np.full(len(part), np.inf, dtype=np.float32)
    return order[:, :b], ordered[:, :b], outer


def folded(near: np.ndarray, lows: np.ndarray, b: int):
    """The first ``b`` kept entries; the bounds of the others join the outer one."""
    if b >= near.shape[1]:
        return near, lows
    return near[:, :b], np.concatenate([lows[:, :b], lows[:, b:].min(axis=1, keepdims=True)], axis=1)


def reassigned(part: np.ndarray, near: np.ndarray, lows: np.ndarray, entries: np.ndarray, moved: np.ndarray):
    """(near, lows, squared distance, needed) after the entries moved by at most ``moved``.

    ``needed`` is how many kept entries the part had to look at: 1 where the bounds sufficed, one more
    than are kept where all entries were compared.
    """
    n, b = near.shape
    lows = np.concatenate([lows[:, :b] - moved[near], lows[:, b:] - moved.max()], axis=1)
    near, exact = near.copy(), ((part - entries[near[:, 0]]) ** 2).sum(axis=1)
    reach = np.sqrt(exact) * (1 + 1e-9) + 1e-9
    needed = 1 + (lows[:, 1:b] <= reach[:, None]).sum(axis=1)
    open_rows = np.flatnonzero(lows[:, 1:].min(axis=1) <= reach)
    if len(open_rows):
        kept = near[open_rows]
        squares = ((part[open_rows, None, :] - entries[kept]) ** 2).sum(axis=2)
        order = np.lexsort((kept, squares), axis=1)
        kept, squares = np.take_along_axis(kept, order, axis=1), np.take_along_axis(squares, order, axis=1)
        near[open_rows], lows[open_rows, :b], exact[open_rows] = kept, below(squares), squares[:, 0]
        far = open_rows[lows[open_rows, b] <= np.sqrt(squares[:, 0]) * (1 + 1e-9) + 1e-9]
        if len(far):
            near[far], ordered, lows[far, b] = closest(part[far], entries, b)
            lows[far, :b], exact[far], needed[far] = below(ordered), ordered[:, 0], b + 1
    lows[:, 0] = below(exact)
    return near, np.nextafter(lows.astype(np.float32), np.float32(-np.inf)), exact, needed


class Round:
    """One assignment of all rows. ``held`` is how many entries the rows before kept, 0 for a start."""

    def __init__(self, books: np.ndarray, moved: np.ndarray, held: int, b: int, last: bool):
        self.books, self.moved, self.held, self.b, self.last = books, moved, held, b, last

    def assigned(self, rows: pa.RecordBatch):
        """(values, near, lows, squared distances, needed) of rows (vec_id, label, v[, near, lows])."""
        parts, entries, width = self.books.shape
        values, b = it.matrix(rows.column(2)).reshape(-1, parts, width), self.b
        near, lows = np.empty((len(values), parts, b), dtype=np.uint8), np.empty((len(values), parts, b + 1), dtype=np.float32)
        exact, needed = np.empty((len(values), parts), dtype=np.int64), np.full((len(values), parts), b + 1)
        if self.held:
            old = it.from_blobs(rows.column(3), np.uint8, (parts, self.held))
            bounds = it.from_blobs(rows.column(4), np.float32, (parts, self.held + 1))
        for p in range(parts):
            if self.held:
                kept, low = folded(old[:, p], bounds[:, p], b)
                near[:, p], lows[:, p], exact[:, p], needed[:, p] = reassigned(values[:, p], kept, low.astype(np.float64), self.books[p], self.moved[p])
            else:
                near[:, p], ordered, lows[:, p, b] = closest(values[:, p], self.books[p], b)
                lows[:, p, :b], exact[:, p] = below(ordered), ordered[:, 0]
        return values, near, lows, exact, needed

    def __call__(self, batches):
        parts, entries, width = self.books.shape
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        needs = np.zeros(self.b + 2, dtype=np.int64)
        names = ["vec_id", "label", "v", "near", "lows", "error", "code", "sums"]
        label = None
        for batch in batches:
            label = batch.column(1).type
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                n = rows.num_rows
                values, near, lows, exact, needed = self.assigned(rows)
                needs += np.bincount(needed.ravel(), minlength=self.b + 2)
                none = pa.nulls(n, pa.list_(pa.int64()))
                if self.last:
                    code = pa.array([c.tobytes().hex() for c in near[:, :, 0]], pa.string())
                    yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(exact.sum(axis=1)), code, none], names)
                    continue
                for p in range(parts):
                    own = near[:, p, 0]
                    for d in range(width):  # sums of a block are exact in double precision
                        sums[p, :, d] += np.bincount(own, weights=values[:, p, d], minlength=entries).astype(np.int64)
                    sums[p, :, width] += np.bincount(own, minlength=entries)
                yield pa.RecordBatch.from_arrays([*rows.columns[:2], rows.column(2).cast(pa.list_(pa.int32())), it.blobs(near), it.blobs(lows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), none], names)
        if label is not None:
            tail = [pa.nulls(1, t) for t in (pa.int64(), label, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*tail, pa.array([[*sums.ravel().tolist(), *needs.tolist()]], pa.list_(pa.int64()))], names)


def summed(table: DataFrame) -> np.ndarray:
    """The sums that the tasks of a round sent, position by position."""
    parts = table.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("pos", "n"))
    found = parts.groupBy("pos").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(found), dtype=np.int64)
    for r in found:
        out[r["pos"]] = r["n"]
    return out


def next_kept(needs: np.ndarray, b: int, entries: int) -> int:
    """How many entries to keep: as many as nearly all parts needed, between an eighth and what is kept."""
    share = np.cumsum(needs) / max(1, needs.sum())
    return int(min(b, max(1, entries // 8, np.searchsorted(share, SETTLED))))


def coded(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes | None:
    """Codes of all rows whose vector is not null and holds no null or non-finite component.

    Component x becomes floor(256 x), within +-2**24. The codebooks start as the parts of the rows
    with the smallest vec_id (rows without one last, equal ids in the order of the vectors); fewer rows
    make fewer entries. All vectors should have one length, a multiple of ``parts``: that of the first
    such row counts, and rows of another length have no code and no error. Rows that repeat are rows of
    their own. None if there is nothing to code. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("between 1 and 256 entries")
    rows = it.integer_rows(embeddings)
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(*order).limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["v"])
    fit = rows.filter(F.size("v") == dims)
    start = np.array([r["v"] for r in fit.orderBy(*order).limit(entries).collect()], dtype=np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))
    count = books.shape[1]
    kind = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, v array<int>, near binary, lows binary, error long, code string, sums array<long>"
    state, held, b, moved, settled = fit, 0, max(1, count // 4), np.zeros(books.shape[:2]), []
    for _ in range(rounds):
        table = checkpointed(state.mapInArrow(Round(books, moved, held, b, False), schema))
        sums = summed(table)
        size = books.size + parts * count
        totals, needs = sums[:size].reshape(parts, count, -1), sums[size:]
        settled.append((int(needs[1]), int(needs[2 : b + 1].sum()), int(needs[b + 1])))
        used = totals[:, :, -1:]
        fresh = np.where(used > 0, totals[:, :, :-1] // np.maximum(used, 1), books)
        moved = np.sqrt(((fresh - books) ** 2).sum(axis=2)) * (1 + 1e-9)
        books, state = fresh, table.filter(F.col("sums").isNull()).select("vec_id", "label", "v", "near", "lows")
        held, b = b, next_kept(needs, b, count) if held else b
    table = checkpointed(state.mapInArrow(Round(books, moved, held, b, True), schema))
    needs = summed(table)[books.size + parts * count :]
    settled.append((int(needs[1]), int(needs[2 : b + 1].sum()), int(needs[b + 1])))
    other = rows.filter(F.size("v") != dims).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(table.filter(F.col("sums").isNull()).select("vec_id", "label", "code", "error").unionByName(other), books, settled)


def op13_bounded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, found.codebooks.ravel().tolist())).encode()).hexdigest()
    by_label = checkpointed(found.rows.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "_of")
    rows = found.rows.join(by_label, F.col("label").eqNullSafe(F.col("_of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: every part against every entry, rounds written one after the other."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT row, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(range({parts})) AS part))",
        f"firsts AS (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept QUALIFY row_number() OVER (ORDER BY vec_id, v) <= {entries})",
        "b0 AS MATERIALIZED (SELECT part, entry, x AS e FROM cut JOIN firsts USING (row))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT row, part, any_value(x) AS x, min({{'d': d, 'entry': entry}}) AS best FROM (SELECT row, part, x, entry, "
            f"CAST(list_sum(list_transform(list_zip(x, e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM cut JOIN b{n} USING (part)) GROUP BY row, part)"
        )
        if n < rounds:
            steps.append(
                f"m{n} AS MATERIALIZED (SELECT part, entry, list(((s - ((s % k) + k) % k) // k) ORDER BY pos) AS e FROM (SELECT part, entry, pos, CAST(sum(c) AS BIGINT) AS s, count(*) AS k "
                f"FROM (SELECT part, (best).entry AS entry, unnest(x) AS c, unnest(range(len(x))) AS pos FROM a{n}) GROUP BY part, entry, pos) GROUP BY part, entry)"
            )
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{n}.e, b{n}.e) AS e FROM b{n} LEFT JOIN m{n} USING (part, entry))")
    steps.append(f"done AS MATERIALIZED (SELECT row, string_agg(lpad(lower(to_hex((best).entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum((best).d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)")
    return f"""WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN done USING (row)"""
