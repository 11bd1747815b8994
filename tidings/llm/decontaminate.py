"""Benchmark decontamination by suffix arrays of the training texts.

Each task builds suffix arrays over the words of its documents, a few megabytes of text at a time (a
shard). Every suffix of every test item is binary-searched in every shard; the range it finds holds
all verbatim places of its window. Training words that occur in no test item cannot be part of a
match: they end a suffix, and suffixes too short for the shortest window are not sorted.

Test items are sent to the executors in blocks of bounded size; documents pass through the blocks
one after the other, so a benchmark of any size works without one large broadcast.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import buffers
from tidings.llm.tables import documents_of, free_name

WINDOW = 13
BLOCK_BYTES = 16 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_hit long, items array<string>, text_key long"


def word_hashes(data: np.ndarray, offsets: np.ndarray, rolling, lower, separator):
    data = lower[data]
    starts, ends, first = buffers.word_spans(data, offsets, separator)
    return rolling.runs(rolling.prefix(data), starts, ends), first


class TestSuffixes:
    """Suffixes of the test items as word numbers: each distinct window once, with its items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        rolling, lower, separator = buffers.Rolling(7), buffers.lower_table(), buffers.separators("letters")
        texts = [(t or "").encode() for _, t in items]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, first = word_hashes(data, offsets, rolling, lower, separator)
        self.vocabulary = np.unique(hashes)
        words = np.searchsorted(self.vocabulary, hashes) + 1
        holders: dict[tuple, set] = {}
        for i, (item, _) in enumerate(items):
            own = words[first[i] : first[i + 1]].tolist()
            for at in range(max(1, len(own) - window + 1) if own else 0):
                holders.setdefault(tuple(own[at : at + window]), set()).add(item)
        ordered = sorted(holders)
        self.items = [sorted(holders[w]) for w in ordered]
        self.sizes = np.array([len(w) for w in ordered], dtype=np.int64)
        self.words = np.zeros((len(ordered), window), dtype=np.int32)
        for i, w in enumerate(ordered):
            self.words[i, : len(w)] = w
        self.window = window
        self.shortest = int(self.sizes.min()) if ordered else 0
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of training words, 0 for words of no test item."""
        out = np.zeros(len(hashes), dtype=np.int32)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[place] == hashes[maybe], place + 1, 0)
        return out


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` numbers that follow each; prefix doubling on ranks."""
    rank = words.astype(np.int64)
    reach, need = 1, depth
    while reach < need:
        step = min(reach, need - reach)
        later = np.zeros_like(rank)
        later[: len(rank) - step] = rank[step:] if step else 0
        pair = rank * (int(rank.max(initial=0)) + 1) + later
        live = np.flatnonzero(words)
        unique, place = np.unique(pair[live], return_inverse=True)
        rank = np.zeros_like(rank)
        rank[live] = place + 1
        reach += step
    return starts[np.argsort(rank[starts], kind="stable")]


def search(words: np.ndarray, order: np.ndarray, tests: TestSuffixes, after: bool) -> np.ndarray:
    """For every test suffix the first place in ``order`` whose suffix is not before it (or, with
    ``after``, is past all that begin with it): one binary search over all of them together."""
    low, high = np.zeros(len(tests.sizes), dtype=np.int64), np.full(len(tests.sizes), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        right = np.full(len(open_), after)  # go right on equality
        undecided = np.arange(len(open_))
        for k in range(tests.window):
            undecided = undecided[tests.sizes[open_[undecided]] > k]
            if not len(undecided):
                break
            a, b = words[order[mid[undecided]] + k], tests.words[open_[undecided], k]
            right[undecided[a < b]] = True
            right[undecided[a > b]] = False
            undecided = undecided[a == b]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]


def found_in(words: np.ndarray, tests: TestSuffixes):
    """(place, test suffix) of every verbatim occurrence in one shard. ``words`` must end in
    ``window`` zeros, and hold a zero between documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(tests.sizes):
        return none
    stops = np.flatnonzero(words == 0)
    alive = np.flatnonzero(words)
    run = stops[np.searchsorted(stops, alive)] - alive
    starts = alive[run >= tests.shortest]
    if not len(starts):
        return none
    order = suffix_array(words, starts, tests.window)
    low, high = search(words, order, tests, False), search(words, order, tests, True)
    count = np.maximum(high - low, 0)
    return order[buffers.repeat_ranges(low, count)], np.repeat(np.arange(len(count)), count)


def through_block(tests, then=None):
    """One block of test items: adds its hits and items to the state of each document. ``then`` goes
    on with the result in the same worker."""

    def run(batches):
        block, rolling, lower, separator = tests.value, buffers.Rolling(7), buffers.lower_table(), buffers.separators("letters")
        for rows, data, offsets in buffers.byte_groups(batches):
            hashes, first = word_hashes(data, offsets, rolling, lower, separator)
            counts = np.diff(first)
            # Each document's words, then a zero; ``window`` zeros at the very end.
            at = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
            words = np.zeros(len(hashes) + len(counts) + block.window, dtype=np.int32)
            words[at] = block.numbered(hashes)
            places, which = found_in(words, block)
            begins = first[:-1] + np.arange(len(counts))
            owner = np.searchsorted(begins, places, side="right") - 1
            sort = np.lexsort((places, owner))
            owner, places, which = owner[sort], places[sort], which[sort]
            edges = np.searchsorted(owner, np.arange(len(counts) + 1))
            kept = rows.num_columns - 2
            old_hits, old_items = rows.column(kept).to_pylist(), rows.column(kept + 1).to_pylist()
            hits, items = [], []
            for d in range(len(counts)):
                mine = slice(edges[d], edges[d + 1])
                spans = np.frombuffer(old_hits[d] or b"", dtype=np.int64).reshape(-1, 2)
                if edges[d] < edges[d + 1]:
                    new = np.unique(np.stack([places[mine] - begins[d], block.sizes[which[mine]]], axis=1), axis=0)
                    spans = np.concatenate([spans, new])
                hits.append(spans.tobytes())
                items.append(sorted({*(old_items[d] or []), *(x for w in np.unique(which[mine]).tolist() for x in block.items[w])}))
            yield pa.RecordBatch.from_arrays([*rows.columns[:kept], pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=rows.schema.names)

    return run if then is None else lambda batches: then(run(batches))


def spans_hit(n_words: int, packed: bytes | None) -> np.ndarray:
    spans = np.frombuffer(packed or b"", dtype=np.int64).reshape(-1, 2)
    return buffers.covered(n_words, spans[:, 0], spans[:, 1]) if len(spans) else np.zeros(0, bool)


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def judged(batches):
    """Counts and verdict of each document (doc_id, text, text_key, _hits, _items)."""
    separator = buffers.separators("letters")
    for rows, data, offsets in buffers.byte_groups(batches):
        counts = np.diff(buffers.word_spans(data, offsets, separator)[2]).tolist()
        hits, items = rows.column(3).to_pylist(), [x or [] for x in rows.column(4).to_pylist()]
        n_hit, longest = [], []
        for n, packed in zip(counts, hits):
            hit = spans_hit(n, packed)
            n_hit.append(int(hit.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            longest.append(int((edges[1::2] - edges[::2]).max()) if len(edges) else 0)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                pa.array(counts, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([is_contaminated(h, n) for h, n in zip(n_hit, counts)], pa.bool_()),
                pa.array(longest, pa.int64()),
                pa.array(items, pa.list_(pa.string())),
                rows.column(2),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit", "items", "text_key"],
        )


def clean_only(batches):
    """The rows whose documents are clean, without the two state columns at their end."""
    separator = buffers.separators("letters")
    for rows, data, offsets in buffers.byte_groups(batches):
        kept = rows.num_columns - 2
        counts = np.diff(buffers.word_spans(data, offsets, separator)[2]).tolist()
        clean = [not is_contaminated(int(spans_hit(n, h).sum()), n) for n, h in zip(counts, rows.column(kept).to_pylist())]
        yield pa.RecordBatch.from_arrays(rows.columns[:kept], names=rows.schema.names[:kept]).filter(pa.array(clean, pa.bool_()))


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int):
    """The test items in blocks of about ``block_bytes``, one on the driver at a time."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / block_bytes))
    for k in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield TestSuffixes([(r["item"], r["text"]) for r in block.collect()], window)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words inside verbatim benchmark windows, the items they come
    from, the longest verbatim run of hit words, and whether the document is contaminated (at least
    a twentieth of its words are hit).

    Null and wordless texts have no words and are clean. A null item_id counts as the empty string;
    items with null or wordless text have no window. Rows that repeat an item_id are one item. An
    empty benchmark leaves every document clean. No shuffle: a document is judged where it is read.
    """
    return _through_blocks(documents_of(documents), benchmark, window, block_bytes, judged, RESULT)


def _through_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, then, schema) -> DataFrame:
    """``docs``, with packed hit spans and items as their last two columns, through all blocks, and
    behind the last one through ``then``."""
    state = docs.select("*", F.lit(None).cast("binary").alias(free_name(docs, "_hits")), F.lit(None).cast("array<string>").alias(free_name(docs, "_items")))
    context, last = docs.sparkSession.sparkContext, None
    for tests in blocks_of(benchmark, window, block_bytes):
        if last is not None:
            state = state.mapInArrow(through_block(last), state.schema)
        last = context.broadcast(tests)  # at most a block
    return state.mapInArrow(through_block(last, then), schema)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns as they came, less the contaminated ones. No shuffle."""
    return _through_blocks(documents, benchmark, window, block_bytes, clean_only, documents.schema)


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(documents, benchmark).drop("items", "text_key")
