"""Words and rolling hashes over the UTF-8 bytes of Arrow text columns, in whole-array numpy.

Texts of a batch are taken in groups of about a megabyte, so memory follows the group and the longest
single text, never the partition. Hashes are polynomials modulo 2**64 over mixed byte values; where
equality decides a result, two independent ones are used together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def separators(word: str) -> np.ndarray:
    """256 flags of bytes that are no part of a word. ``space``: words run between white space.
    ``letters``: words are runs of a-z, A-Z, 0-9 and everything beyond ASCII."""
    flags = np.zeros(256, dtype=bool)
    if word == "space":
        flags[[0x20, *range(0x09, 0x0E)]] = True
    else:
        flags[:0x80] = True
        for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            flags[low : high + 1] = False
    return flags


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def byte_groups(batches, text: str = "text", limit: int = GROUP_BYTES):
    """(rows as a RecordBatch, bytes, offsets) for consecutive rows of at most ``limit`` bytes
    together, or one longer row. Null texts count as empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        first = 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), len(column))
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
    """Byte starts and ends of all words, and the number of the first word of each text (one more
    than texts). A word never crosses a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(len(word), dtype=bool)
    before[0], before[1:] = False, word[:-1]
    before[filled] = False
    starts = np.flatnonzero(word & ~before)
    before[:-1], before[-1] = word[1:], False
    before[filled - 1] = False
    before[-1] = False
    ends = np.flatnonzero(word & ~before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Rolling:
    """Polynomial hashes of runs of values, from prefix sums modulo 2**64."""

    def __init__(self, salt: int):
        self.base = ODD[salt % 4] ^ (salt << 7 & ~7)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD[(salt + 1) % 4]))

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                table = np.full(n + 1, base, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """One more entry than values; ``values`` are bytes or already mixed 64-bit numbers."""
        self._grow(len(values))
        out = np.empty(len(values) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum((self.values[values] if values.dtype == np.uint8 else values) * self.up[: len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` values."""
        n = len(prefix) - size
        return mix((prefix[size:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(firsts - starts, counts)


RUN_BITS = 20


def packed_runs(owner: np.ndarray, places: np.ndarray):
    """(first row, run) of every stretch of consecutive places with the same owner; rows are sorted
    by owner and place. A run is its first place and its length less one in one number."""
    at = np.arange(len(places))
    begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (places[1:] > places[:-1] + 1)])) if len(places) else at
    # Repeated places stay in their stretch; overlong stretches are cut.
    length = places[np.append(begin[1:], len(places)) - 1] - places[begin] if len(places) else at
    pieces = (length >> RUN_BITS) + 1
    head, step = np.repeat(begin, pieces), repeat_ranges(np.zeros(len(begin), dtype=np.int64), pieces) << RUN_BITS
    rest = np.minimum(np.repeat(length, pieces) - step, (1 << RUN_BITS) - 1)
    return head, (places[head] + step << RUN_BITS) + rest


def unpacked_runs(runs: np.ndarray):
    """Starts of packed runs and how many places each holds."""
    return runs >> RUN_BITS, (runs & (1 << RUN_BITS) - 1) + 1


def covered(length: int, starts: np.ndarray, sizes) -> np.ndarray:
    """Flags of the ``length`` places that lie in any run."""
    edges = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + sizes, length), -1)
    return np.cumsum(edges[:-1]) > 0
