"""Language-model scores by a hidden Markov model.

Hidden states emit symbols: a symbol of its own for each of the most frequent tokens, and one of a
fixed set of shape classes (length, first and last byte) for all others; a class symbol then picks
its token by the training counts of the class, with one place left for tokens never met. The model is
trained by Baum-Welch over all training documents: every partition sums expected counts, Spark adds
them up, the driver holds only the model (states x symbols numbers). Scoring multiplies the scaled
forward matrices of all segments of a text, which is the exact likelihood of the whole sequence.

Token counts grow with the corpus. The counts of the most frequent tokens (at most ``head``) travel
with the tasks; all others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import buffers
from tidings.llm.tables import checkpointed

STATES = 6
OWN_SYMBOLS = 1024
CLASSES = 64
HEAD = 1 << 19
ROUNDS = 3
SEGMENT = 64
RESCALE = 8
FLUSH = 2 << 20
STEPS_PER_DOUBLING = 8


class Tokens:
    """Tokens of a group of texts: two 64-bit hashes each, a shape class, and an end after each text."""

    def __init__(self):
        self.lower, self.separator = buffers.lower_table(), buffers.separators("space")
        self.one, self.two = buffers.Rolling(4), buffers.Rolling(5)
        kinds = np.full(256, 2, dtype=np.int64)
        kinds[0x61:0x7B], kinds[0x30:0x3A], kinds[0x80:] = 0, 1, 3
        self.kinds = kinds

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, hash, class, first token of each text): the end token has hashes 0 and class 0."""
        data = self.lower[data]
        starts, ends, first = buffers.word_spans(data, offsets, self.separator)
        texts = len(offsets) - 1
        at = np.arange(len(starts)) + np.repeat(np.arange(texts), np.diff(first))
        one, two, shape = (np.zeros(len(starts) + texts, dtype=t) for t in (np.uint64, np.uint64, np.int64))
        if len(starts):
            one[at] = self.one.runs(self.one.prefix(data), starts, ends)
            two[at] = self.two.runs(self.two.prefix(data), starts, ends)
            length = np.searchsorted([4, 6, 9], ends - starts, side="right")
            shape[at] = 16 * length + 4 * self.kinds[data[starts]] + self.kinds[data[ends - 1]]
        return one, two, shape, first + np.arange(texts + 1)


def count_batches(batches):
    """(one, two, shape, n): the tokens of a partition, counted before they are shuffled."""
    tokens, held, n = Tokens(), [], 0

    def counted(held):
        one, two, shape = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((two, one))
        one, two, shape = one[order], two[order], shape[order]
        begin = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        sizes = np.diff(np.append(begin, len(one)))
        for a in range(0, len(begin), 100_000):
            b = begin[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(one[b].view(np.int64)), pa.array(two[b].view(np.int64)), pa.array(shape[b].astype(np.int32)), pa.array(sizes[a : a + 100_000])], ["one", "two", "shape", "n"])

    for _, data, offsets in buffers.byte_groups(batches):
        one, two, shape, _ = tokens.of(data, offsets)
        held.append((one, two, shape))
        n += len(one)
        if n >= FLUSH:
            yield from counted(held)
            held, n = [], 0
    if n:
        yield from counted(held)


def token_counts(training: DataFrame) -> DataFrame:
    """(one, two, shape, n) of all tokens of ``training`` (text)."""
    found = training.select("text").mapInArrow(count_batches, "one long, two long, shape int, n long")
    return found.groupBy("one", "two", "shape").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent tokens, at most ``most``: all above the lowest count bucket that still fits.

    Buckets are steps of the logarithm of the count, so a few hundred sums find the bound.
    """
    bucket = F.floor(F.log2("n") * STEPS_PER_DOUBLING).cast("int")
    sizes = sorted(((r["bucket"], r["tokens"]) for r in counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    total, lowest = 0, 1 << 30
    for b, n in sizes:
        if total + n > most:
            break
        total, lowest = total + n, b
    return counts.filter(bucket >= lowest)


class Vocabulary:
    """What the tasks need to know of the counts: frequent tokens, sums of each class, all sums."""

    def __init__(self, counts: DataFrame, head: int, own_symbols: int):
        sums = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        self.total, self.distinct = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
        rows = frequent(counts, head).toArrow()
        one, two, n, shape = (rows[c].to_numpy().astype(np.int64) for c in ("one", "two", "n", "shape"))
        by_count = np.lexsort((two, one, -n))
        one, two, n, shape = one[by_count], two[by_count], n[by_count], shape[by_count]
        end = (one == 0) & (two == 0)
        own = np.zeros(len(n), dtype=bool)
        own[:own_symbols] = True
        own |= end
        symbol = np.where(own, np.cumsum(own), 0)
        symbol[end] = 0
        symbol = np.where(own, symbol, 0)
        different = np.unique(symbol[own & ~end])
        symbol[own & ~end] = np.searchsorted(different, symbol[own & ~end]) + 1
        # Symbol 0 is the end, then own symbols, then classes.
        self.own = len(different) + 1
        symbol[~own] = self.own + shape[~own]
        self.symbols = self.own + CLASSES
        one, two = one.view(np.uint64), two.view(np.uint64)
        order = np.lexsort((two, one))
        self.one, self.two, self.n, self.symbol = one[order], two[order], n[order], symbol[order].astype(np.int32)
        class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in sums:
            class_n[r["shape"]], class_v[r["shape"]] = r["n"], r["v"]
        taken = own.nonzero()[0]
        class_n -= np.bincount(shape[taken], weights=n[taken], minlength=CLASSES)
        class_v -= np.bincount(shape[taken], minlength=CLASSES)
        self.class_size = np.log10(class_n + class_v + 1)
        self.symbol_n = np.concatenate([np.zeros(self.own), class_n])
        np.add.at(self.symbol_n, symbol[taken], n[taken])
        bits = max(1, (2 * len(one)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.bucket = np.searchsorted(self.one >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.reach = int(np.diff(self.bucket).max(initial=0))

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Place among the frequent tokens, or -1."""
        out = np.full(len(one), -1, dtype=np.int64)
        if not len(self.one):
            return out
        slot = (one >> self.shift).astype(np.int64)
        at, last, open_ = self.bucket[slot], self.bucket[slot + 1], np.arange(len(one))
        for _ in range(self.reach):
            live = at < last
            open_, at, last = open_[live], at[live], last[live]
            hit = (self.one[at] == one[open_]) & (self.two[at] == two[open_])
            out[open_[hit]] = at[hit]
            open_, at, last = open_[~hit], at[~hit] + 1, last[~hit]
        return out

    def symbols_of(self, place: np.ndarray, shape: np.ndarray, ends: np.ndarray) -> np.ndarray:
        symbol = (self.own + shape).astype(np.int64)
        known = place >= 0
        symbol[known] = self.symbol[place[known]]
        symbol[ends] = 0
        return symbol


class Hmm:
    """Start, middle and transition probabilities of the states, and their symbols."""

    def __init__(self, start, middle, moves, emits):
        self.start, self.middle, self.moves, self.emits = start, middle, moves, emits

    @classmethod
    def first(cls, symbol_n: np.ndarray, states: int) -> "Hmm":
        """Unequal states around the symbol counts, the same at every call."""
        draw = np.random.default_rng(17)
        emits = (symbol_n + 1)[None, :] * draw.uniform(0.5, 1.5, (states, len(symbol_n)))
        moves = draw.uniform(0.5, 1.5, (states, states))
        even = np.full(states, 1 / states)
        return cls(even, even, moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))

    def trained(self, counts: np.ndarray) -> "Hmm":
        """The model that the expected counts ask for, lightly smoothed."""
        k, s = self.emits.shape
        start, middle, moves, emits = np.split(counts, np.cumsum([k, k, k * k]))
        share = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
        return Hmm(share(start), share(middle), share(moves.reshape(k, k)), share(emits.reshape(k, s)))


def segments_of(symbol: np.ndarray, first: np.ndarray, size: int, pad: int):
    """Symbols as (segments, size) padded with ``pad``; the text of each segment; whether it is the
    text's first."""
    counts = -(-np.diff(first) // size)
    text = np.repeat(np.arange(len(counts)), counts)
    order = buffers.repeat_ranges(np.zeros(len(counts), dtype=np.int64), counts)
    starts = first[text] + order * size
    place = starts[:, None] + np.arange(size)[None, :]
    inside = place < first[text + 1][:, None]
    return np.where(inside, symbol[np.minimum(place, len(symbol) - 1)], pad), text, order


def expected(model: Hmm, grid: np.ndarray, is_first: np.ndarray) -> np.ndarray:
    """Expected counts (start, middle, moves, emits) over independent segments: scaled forward and
    backward passes."""
    k, pad = len(model.start), model.emits.shape[1]
    table = np.concatenate([model.emits.T, np.ones((1, k))]).astype(np.float32)
    moves = model.moves.astype(np.float32)
    n, size = grid.shape
    alpha = np.empty((size, n, k), dtype=np.float32)
    scale = np.empty((size, n, 1), dtype=np.float32)
    now = np.where(is_first[:, None], model.start, model.middle).astype(np.float32)
    for t in range(size):
        now = (now @ moves if t else now) * table[grid[:, t]]
        scale[t] = now.sum(axis=1, keepdims=True)
        now /= scale[t]
        alpha[t] = now
    moved, emitted = np.zeros((k, k)), np.zeros((k, pad + 1))
    beta = np.ones((n, k), dtype=np.float32)
    start = middle = None
    for t in range(size - 1, -1, -1):
        gamma = alpha[t] * beta
        for j in range(k):
            emitted[j] += np.bincount(grid[:, t], weights=gamma[:, j], minlength=pad + 1)
        if t == 0:
            start, middle = gamma[is_first].sum(axis=0), np.zeros(k)
        else:
            ahead = beta * table[grid[:, t]] / scale[t]
            moved += alpha[t - 1].T @ (ahead * (grid[:, t] != pad)[:, None])
            beta = ahead @ moves.T
    moved *= model.moves
    middle = emitted[:, :pad].sum(axis=1)
    return np.concatenate([start, middle, moved.ravel(), emitted[:, :pad].ravel()])


def expectation(words, shared):
    """(place, value) of a partition's expected counts."""

    def run(batches):
        vocabulary, model = words.value, shared.value
        tokens, total = Tokens(), None
        for _, data, offsets in buffers.byte_groups(batches):
            one, two, shape, first = tokens.of(data, offsets)
            symbol = vocabulary.symbols_of(vocabulary.find(one, two), shape, first[1:] - 1)
            grid, _, order = segments_of(symbol, first, SEGMENT, vocabulary.symbols)
            found = expected(model, grid, order == 0)
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    return run


def train(training: DataFrame, words, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all training texts; ``words`` is the vocabulary as the tasks have it. Long texts
    count as segments; only their first segment says how texts start."""
    context = training.sparkSession.sparkContext
    model = Hmm.first(words.value.symbol_n, states)
    for _ in range(rounds):
        shared = context.broadcast(model)  # states x symbols numbers
        sums = training.select("text").mapInArrow(expectation(words, shared), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        if not sums.num_rows:
            return model
        counts = np.zeros(sums.num_rows)
        counts[sums["place"].to_numpy()] = sums["value"].to_numpy()
        model = model.trained(counts)
    return model


def likelihoods(model: Hmm, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 likelihood of each text's symbols: forward matrices of all segments, then one product
    along the segments of each text."""
    k, pad = len(model.start), model.emits.shape[1]
    grid, text, order = segments_of(symbol, first, SEGMENT, pad)
    n = len(grid)
    table = np.concatenate([model.emits.T, np.ones((1, k))])
    matrix, log = np.broadcast_to(np.eye(k), (n, k, k)).copy(), np.zeros(n)
    entry = order == 0
    live = np.arange(n)
    used = (grid != pad).sum(axis=1)
    for t in range(grid.shape[1]):
        if t and used[live].min(initial=1) <= t:
            live = live[used[live] > t]
        if not len(live):
            break
        part = matrix if len(live) == n else matrix[live]
        # The first token of a text is drawn from the start, without a move before it.
        step = (part.reshape(-1, k) @ model.moves).reshape(-1, k, k)
        if t == 0:
            step[entry] = part[entry]
        step *= table[grid[live, t]][:, None, :]
        if t % RESCALE == RESCALE - 1:
            size = step.sum(axis=(1, 2))
            step /= size[:, None, None]
            log[live] += np.log10(size)
        if len(live) == n:
            matrix = step
        else:
            matrix[live] = step
    texts = len(first) - 1
    state, out = np.tile(model.start, (texts, 1)), np.zeros(texts)
    begin = np.searchsorted(text, np.arange(texts))
    counts = np.bincount(text, minlength=texts)
    for o in range(int(counts.max(initial=0))):
        own = np.flatnonzero(counts > o)
        at = begin[own] + o
        state[own] = np.einsum("ni,nij->nj", state[own], matrix[at])
        size = state[own].sum(axis=1)
        state[own] /= size[:, None]
        out[own] += np.log10(size) + log[at]
    return out


def score_batches(words, shared):
    """Per text one row with what is known here, and one row per rare token to be joined.

    ``row`` names a text among those of its partition; the rows of a text meet again by it."""

    def run(batches):
        vocabulary, model = words.value, shared.value
        tokens, row = Tokens(), TaskContext.get().partitionId() << 40
        plus = np.log10(vocabulary.n + 1.0)

        def out(one, two, rows, n, ids, held, tokens_, known, base, score):
            return pa.RecordBatch.from_arrays(
                [pa.array(one), pa.array(two), pa.array(rows), pa.array(n), ids, held, pa.array(tokens_), pa.array(known), pa.array(base), pa.array(score)],
                ["one", "two", "row", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
            )

        for rows, data, offsets in buffers.byte_groups(batches):
            one, two, shape, first = tokens.of(data, offsets)
            texts = len(first) - 1
            text = np.repeat(np.arange(texts), np.diff(first))
            place = vocabulary.find(one, two)
            known = place >= 0
            symbol = vocabulary.symbols_of(place, shape, first[1:] - 1)
            gain = np.where(known, plus[np.maximum(place, 0)] if len(plus) else 0.0, 0.0)
            in_class = symbol >= vocabulary.own
            inside = np.where(in_class, gain - vocabulary.class_size[np.where(in_class, symbol - vocabulary.own, 0)], 0.0)
            sums = lambda x: np.bincount(text, weights=x, minlength=texts)
            score = likelihoods(model, symbol, first) + sums(inside)
            names = row + np.arange(texts)
            yield out(names * 0x9E3779B1, names, names, np.zeros(texts, np.int64), rows.column(0), rows.column(1), np.diff(first), sums(known).astype(np.int64), sums(gain), score)
            rare = np.flatnonzero(~known)
            if len(rare):
                order = rare[np.lexsort((two[rare], one[rare], text[rare]))]
                a, b, c = one[order], two[order], text[order]
                begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
                n = np.diff(np.append(begin, len(order)))
                a, b, c = a[begin].view(np.int64), b[begin].view(np.int64), c[begin]
                for i in range(0, len(a), 100_000):
                    s = slice(i, i + 100_000)
                    m = len(a[s])
                    zero, none = np.zeros(m, np.int64), np.zeros(m)
                    yield out(a[s], b[s], row + c[s], n[s], pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), zero, zero, none, none)
            row += texts

    return run


SCORED = "one long, two long, row long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def scores(documents: DataFrame, folds: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from documents whose crc32(doc_id as text) mod ``folds`` is not ``held``; a null doc_id
    counts as the empty text. A null or empty text is the end token alone. Repeated rows are trained
    on and scored one by one. Without any training text the counts are 0 and the model is the one
    before training. An empty table gives no rows.
    """
    fold = F.crc32(F.coalesce(documents["doc_id"].cast("string"), F.lit(""))) % folds
    docs = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), (fold == held).alias("held_out"), documents["text"].cast("string").alias("text"))
    training = docs.filter("not held_out")
    counts = checkpointed(token_counts(training))
    vocabulary = Vocabulary(counts, head, OWN_SYMBOLS)
    context = documents.sparkSession.sparkContext
    words = context.broadcast(vocabulary)  # at most ``head`` tokens
    shared = context.broadcast(train(training, words, states, rounds))
    found = docs.mapInArrow(score_batches(words, shared), SCORED)
    rare = counts.select("one", "two", F.col("n").alias("c"))
    joined = found.join(rare, ["one", "two"], "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("c", F.lit(0))).otherwise(0))
    gain = F.sum(F.col("n") * F.log10(F.col("c") + 1))
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.sum("base") + gain).alias("base"),
        (F.sum("score") + gain).alias("score"),
    )
    space = float(np.log10(vocabulary.total + vocabulary.distinct + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.total)).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * space).alias("base_score"), "score")


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
