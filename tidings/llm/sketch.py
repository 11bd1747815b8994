"""Sketches of saturating counters, merged over all partitions into one bit a cell.

A cell's bit says that at least two of the counted hashes fell into it. Counts are never too low: a
hash whose cell lacks the bit in any row was counted once. The merged sketch has a fixed size,
``ROWS * cells / 8`` bytes, whatever the input; with more hashes than cells more of them pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidings.llm import buffers

ROWS = 2
SLICE_CELLS = 1 << 18
FLUSH = 4 << 20


def packed_gaps(cells: np.ndarray) -> bytes:
    """Rising numbers as bytes: each gap, with 255 standing for 255 and more to come."""
    gaps = np.diff(cells, prepend=0)
    more = gaps // 255
    out = np.full(int(len(gaps) + more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = gaps - 255 * more
    return out.tobytes()


def unpacked_gaps(packed: bytes) -> np.ndarray:
    found = np.frombuffer(packed, dtype=np.uint8)
    return np.cumsum(found, dtype=np.int64)[found < 255]


def shift_of(cells: int) -> np.uint64:
    return np.uint64(64 - (cells.bit_length() - 1))


def partition_sketch(hashes_of, cells: int, slice_cells: int):
    """Per slice of each sketch row: cells counted once, and cells counted more often. ``hashes_of``
    makes a function from a group of texts to two hashes of everything that is counted."""
    shift = shift_of(cells)

    def slices(hashes):
        parts, once, often = [], [], []
        for r in range(ROWS):
            found, counts = np.unique((np.concatenate(hashes[r]) >> shift).astype(np.int64), return_counts=True)
            for kind, into in ((found[counts == 1], once), (found[counts > 1], often)):
                edges = np.searchsorted(kind, np.arange(0, cells + 1, slice_cells))
                into.extend(packed_gaps(kind[a:b] - k * slice_cells) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
            parts.extend(range(r * (cells // slice_cells), (r + 1) * (cells // slice_cells)))
        keep = [i for i in range(len(parts)) if once[i] or often[i]]
        return pa.RecordBatch.from_arrays(
            [pa.array([parts[i] for i in keep], pa.int32()), pa.array([once[i] for i in keep], pa.binary()), pa.array([often[i] for i in keep], pa.binary())],
            ["part", "once", "often"],
        )

    def run(batches):
        counted, held, n = hashes_of(), ([], []), 0
        for _, data, offsets in buffers.byte_groups(batches):
            one, two = counted(data, offsets)
            held[0].append(one)
            held[1].append(two)
            n += len(one)
            if n >= FLUSH:
                yield slices(held)
                held, n = ([], []), 0
        if n:
            yield slices(held)

    return run


def merged_slices(slice_cells: int):
    """One bit a cell of each slice: counted at least twice in all partitions together."""

    def run(batches):
        part, seen, twice = None, None, None
        for batch in batches:
            for number, once, often in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != part:
                    if part is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])
                    part, seen, twice = number, np.zeros(slice_cells, dtype=bool), np.zeros(slice_cells, dtype=bool)
                single, many = unpacked_gaps(once), unpacked_gaps(often)
                twice[single[seen[single]]] = True
                seen[single] = True
                twice[many] = True
                seen[many] = True
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    return run


def merged_sketch(texts: DataFrame, hashes_of, cells: int, slice_cells: int = SLICE_CELLS) -> np.ndarray:
    """(ROWS, cells / 8) bytes of the merged sketch over the column ``text``; of fixed size."""
    sketches = texts.select("text").mapInArrow(partition_sketch(hashes_of, cells, slice_cells), "part int, once binary, often binary")
    merged = sketches.repartition("part").sortWithinPartitions("part").mapInArrow(merged_slices(slice_cells), "part int, bits binary")
    bits = np.zeros((ROWS * cells // slice_cells, slice_cells // 8), dtype=np.uint8)
    for row in merged.collect():
        bits[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits.reshape(ROWS, -1)


def passing(bits: np.ndarray, cells: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Places of the hashes that may have been counted more than once."""
    keep = np.flatnonzero(_set(bits[0], one >> shift_of(cells)))
    return keep[_set(bits[1], two[keep] >> shift_of(cells))]


def _set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    cell = cell.astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
