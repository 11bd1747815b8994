"""Removal of repeated byte strings by refining suffix buckets on bucket identifiers.

Suffixes are put in buckets by their first ``Q`` bytes; a string of ``LENGTH`` bytes is named by the
bucket identifiers at its start and at its end less ``Q`` (128 bits), and longer stretches by those of
the strings in them. Refinement runs from the coarse to the fine, and a suffix leaves as soon as its
bucket says enough:

1. Every string of ``LENGTH`` bytes picks, among the suffixes that begin in it, the one in the bucket
   with the smallest identifier. Equal strings pick the same place, so only picked suffixes (a few in
   a hundred) have to be sorted. A table of bucket sizes, merged over all partitions, takes out those
   whose bucket holds one suffix.
2. Picked suffixes of a bucket are refined by the identifier of the whole stretch of strings that
   picked them. In a bucket of equal stretches all but the earliest are repeats as a whole.
3. Only where a bucket falls apart, its earliest stretches are refined string by string.

The levels and their shuffles are those of ``repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidings.llm import buffers, repeats

LENGTH = 100
Q = 64
CELLS = 1 << 27


class Buckets:
    """Bucket identifiers of all suffixes in a group of texts, and the stretches that pick them."""

    def __init__(self, length: int, q: int):
        if not q <= length <= 2 * q:
            raise ValueError("two bucket identifiers must cover a string")
        self.length, self.q, self.reach = length, q, length - q + 1
        self.first, self.second = buffers.Rolling(1), buffers.Rolling(2)

    def identifiers(self, data: np.ndarray) -> np.ndarray:
        return self.first.windows(self.first.prefix(data), self.q)

    def stretches(self, data: np.ndarray, offsets: np.ndarray):
        """(bucket of the picked suffix, identifier of the stretch, text, first string, strings)."""
        counts = np.maximum(np.diff(offsets) - self.length + 1, 0)
        if not counts.sum():
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        ids = self.identifiers(data)
        starts = buffers.repeat_ranges(offsets[:-1], counts)
        place = repeats.picked(ids, self.reach)[starts]
        begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        size = np.diff(np.append(begin, len(starts)))
        low = starts[begin]
        whole = self.second.runs(self.second.prefix(data), low, low + size - 1 + self.length)
        text = np.repeat(np.arange(len(counts)), counts)[begin]
        return ids[place[begin]], whole, text, low - offsets[text], size

    def strings(self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray):
        """The two bucket identifiers that name each string."""
        ids, starts = self.identifiers(data), offsets[text] + start
        return ids[starts], ids[starts + self.length - self.q]


def digests(length: int):
    def run(batches):
        for rows, data, offsets in buffers.byte_groups(batches):
            out, runs = [], rows.column(2)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own, spans = data[a:b], 0
                if runs[i].is_valid and len(runs[i]):
                    starts, counts = buffers.unpacked_runs(runs[i].values.to_numpy(zero_copy_only=False))
                    gone = buffers.covered(b - a, starts, length + counts - 1)
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    own = own[~gone]
                out.append((b - a, b - a - len(own), spans, hashlib.sha256(own.tobytes()).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([rows.column(1), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def removal(documents: DataFrame, length: int = LENGTH, q: int = Q, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``documents``.

    Earlier means a smaller doc_id, or an earlier start in the same document. A null text is empty.
    A null doc_id comes after all others. Rows that share a doc_id (or have none) are ordered by the
    hash of their text; rows alike in both are one document, with a result each. Texts shorter than
    ``length`` bytes lose nothing. An empty table gives no rows.
    """
    found = repeats.repeats(documents, lambda: Buckets(length, q), True, cells)
    joined = repeats.keyed(documents).join(found, ["id", "text_key"], "left").select("text", "doc_id", "runs")
    return joined.mapInArrow(digests(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_bucket_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
