"""Removal of repeated word windows behind a count-min prefilter.

Pass one: every partition counts its windows in a sketch of saturating counters, each window by the
run of ``PICK`` words that it picks (a window occurs at most as often as its run, and neighbouring
windows mostly pick the same). The sketches are merged slice by slice; counts are never too low, so a
window whose run lacks the bit for "twice or more" occurs once. Pass two: only windows estimated as
repeated are grouped, exactly, by 128 bits of their words; neighbours that pick the same run first go
together, and one by one only where they differ. The shuffles are those of ``repeats``.

The merged sketch has a fixed size, whatever the input. When more runs than cells come in, more windows
pass the first test and the second pass has more to do; the result is the same. Raise ``cells`` with
the memory of the executors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import buffers, repeats
from tidings.llm.tables import free_name

WORDS = 50
PICK = 25
CELLS = 1 << 26


class Windows:
    """Windows of consecutive words, and the stretches of them that pick the same run of words."""

    def __init__(self, words: int, pick: int):
        self.words, self.pick, self.reach = words, pick, words - pick + 1
        self.separator = buffers.separators("space")
        self.bytes, self.first, self.second = buffers.Rolling(1), buffers.Rolling(2), buffers.Rolling(3)

    def _hashed(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, first = buffers.word_spans(data, offsets, self.separator)
        word = self.bytes.runs(self.bytes.prefix(data), starts, ends)
        return word, first

    def stretches(self, data: np.ndarray, offsets: np.ndarray):
        """(picked run, whole stretch, text, first window, windows)."""
        word, first = self._hashed(data, offsets)
        counts = np.maximum(np.diff(first) - self.words + 1, 0)
        if not counts.sum():
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        ids = self.first.windows(self.first.prefix(word), self.pick)
        at = buffers.repeat_ranges(first[:-1], counts)
        place = repeats.picked(ids, self.reach)[at]
        begin = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
        size = np.diff(np.append(begin, len(at)))
        whole = self.second.runs(self.second.prefix(buffers.mix(word)), at[begin], at[begin] + size - 1 + self.words)
        text = np.repeat(np.arange(len(counts)), counts)[begin]
        return ids[place[begin]], whole, text, at[begin] - first[text], size

    def strings(self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray):
        """Two hashes of each window."""
        word, first = self._hashed(data, offsets)
        at = first[text] + start
        one = self.first.runs(self.first.prefix(word), at, at + self.words)
        return one, self.second.runs(self.second.prefix(buffers.mix(word)), at, at + self.words)


def kept_words(text: bytes, runs: list[int] | None, words: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by a space)."""
    own = text.split()
    if not runs:
        return len(own), 0, b" ".join(own)
    starts, counts = buffers.unpacked_runs(np.array(runs, dtype=np.int64))
    hit = buffers.covered(len(own), starts, words + counts - 1)
    return len(own), int(hit.sum()), b" ".join(w for w, h in zip(own, hit.tolist()) if not h)


def digests(words: int):
    def run(batches):
        for batch in batches:
            texts, runs = batch.column(1).cast(pa.binary()), batch.column(2)
            done = [kept_words(t.as_py() or b"", r.as_py(), words) for t, r in zip(texts, runs)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in done], pa.int64()),
                    pa.array([n for _, n, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for _, _, t in done], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def _found(documents: DataFrame, words: int, pick: int, cells: int) -> DataFrame:
    return repeats.repeats(documents, lambda: Windows(words, pick), False, cells)


def removal(documents: DataFrame, words: int = WORDS, pick: int = PICK, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``documents``.

    Null and empty texts have no words. Rows with the same doc_id are one document: neither removes
    words of the other. A null doc_id counts as larger than all: its windows remove nothing. Texts
    with fewer than ``words`` words have no window. An empty table gives no rows.
    """
    joined = repeats.keyed(documents).join(_found(documents, words, pick, cells), ["id", "text_key"], "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(digests(words), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, words: int = WORDS, pick: int = PICK, cells: int = CELLS) -> DataFrame:
    """The documents with repeated windows cut out of their texts, all columns as they came.

    A text that loses words becomes its kept words joined by a space (``n_chars``, where present,
    follows); other texts stay as they are. A document that loses all its words goes.
    """
    names = documents.columns
    one, key, runs = (free_name(documents, n) for n in ("_id", "_key", "_runs"))
    found = _found(documents, words, pick, cells).select(F.col("id").alias(one), F.col("text_key").alias(key), F.col("runs").alias(runs))
    def cut(batches):
        for batch in batches:
            at = names.index("text")
            runs = batch.column(batch.num_columns - 1)
            columns = [batch.column(i) for i in range(len(names))]
            changed = [i for i, r in enumerate(runs) if r.is_valid]
            keep = [True] * batch.num_rows
            if changed:
                texts = columns[at].to_pylist()
                for i in changed:
                    n, gone, kept = kept_words(texts[i].encode(), runs[i].as_py(), words)
                    if gone:
                        texts[i], keep[i] = kept.decode(), gone < n
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    chars = columns[names.index("n_chars")].to_pylist()
                    for i in changed:
                        chars[i] = len(texts[i])
                    columns[names.index("n_chars")] = pa.array(chars, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    number = F.coalesce(documents["doc_id"].cast("bigint"), F.lit(int(repeats.LAST)))
    same = (number == found[one]) & (F.xxhash64(documents["text"].cast("string")) == found[key])
    return documents.join(found, same, "left").select(*[documents[c] for c in names], found[runs]).mapInArrow(cut, documents.schema)


def op9_countmin_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
