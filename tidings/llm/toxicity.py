"""Toxicity of texts by their nearest labelled examples.

Terms are words and beginnings of words that the labelled rows tell apart: surely (a log-likelihood
ratio of their document counts) and clearly (the odds of the label with and without the term differ by a
factor, or larger samples would let in ever weaker terms); all other words of a text together are one
more term. Texts are TF-IDF vectors
over them, with inverse document frequencies of all documents. The examples with the highest cosine are
found exactly, over an inverted index whose examples lie in blocks: the largest weight of every term in
every block bounds the cosines in it, blocks are read from the highest bound down, and reading stops
when no block left can hold a better example. Neighbours vote with their cosine, and isotonic regression
on votes for the examples themselves, each left out of its own vote, turns votes into probabilities.

Examples are a bounded sample (``EXAMPLES`` of each label) with at most ``TERMS`` terms, so vocabulary and
index fit a broadcast. Every text is read whole, once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.llm import buffers
from tidings.llm.tables import checkpointed

EXAMPLES = 8192
TERMS = 8192
LEAST_RATIO = 30.0
LEAST_ODDS = 4.0
BEGINNINGS = (4, 6, 8)
NEIGHBOURS = 16
BLOCK = 64
TOXIC_FROM = 0.3
BITMAP_BITS = 20
BOUND_CELLS = 1 << 23


# --- texts to terms


class Reader:
    """Hashes of the words of texts and of the beginnings of longer ones, A-Z in lower case."""

    def __init__(self):
        self.separator, self.lower, self.rolling = buffers.separators("letters"), buffers.lower_table(), buffers.Rolling(5)

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Per kind of term (hashes, numbers of the texts); the first kind is whole words."""
        data = self.lower[data]
        starts, ends, first = buffers.word_spans(data, offsets, self.separator)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        prefix = self.rolling.prefix(data)
        yield self.rolling.runs(prefix, starts, ends), text
        for size in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > size)
            yield buffers.mix(self.rolling.runs(prefix, starts[longer], starts[longer] + size)), text[longer]


def term_sums(size: int):
    """(term, n): in how many texts of a task each of the ``size`` terms occurs, from their lists."""

    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64), minlength=size)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[own])], ["term", "n"])

    return run


def counted_terms(batches):
    """(term, toxic, clean): texts of each label (doc_id, text, toxic) that hold the term, summed over
    about a megabyte of text."""
    reader = Reader()
    for rows, data, offsets in buffers.byte_groups(batches):
        label = rows.column(2).to_numpy(zero_copy_only=False)
        kinds = list(reader.read(data, offsets))
        term, text = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
        order = np.lexsort((text, term))
        term, text = term[order], text[order]
        new_term = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool)
        new = new_term | np.concatenate([[True], text[1:] != text[:-1]]) if len(term) else new_term
        term, toxic, at = term[new], label[text[new]], np.flatnonzero(new_term[new])
        if len(term):
            held, size = np.add.reduceat(toxic, at, dtype=np.int64), np.diff(np.append(at, len(term)))
            yield pa.RecordBatch.from_arrays([pa.array(term[at].view(np.int64)), pa.array(held), pa.array(size - held)], ["term", "toxic", "clean"])


def told_apart(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Log-likelihood ratio of a term's counts in texts of both labels."""

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))

    n, total = toxic + clean, all_toxic + all_clean
    cells = [(toxic, n * all_toxic / total), (clean, n * all_clean / total), (all_toxic - toxic, (total - n) * all_toxic / total), (all_clean - clean, (total - n) * all_clean / total)]
    return 2 * sum((part(a, b) for a, b in cells[1:]), part(*cells[0]))


def odds_apart(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Factor, 1 or more, between the odds of the label with and without a term; half a text is added
    to every count."""
    log = F.log((toxic + 0.5) * (all_clean - clean + 0.5) / ((clean + 0.5) * (all_toxic - toxic + 0.5)))
    return F.exp(F.abs(log))


class Vocabulary:
    """Numbers of the chosen terms by their hashes."""

    def __init__(self, terms: list[int]):
        self.terms = np.sort(np.array(terms, dtype=np.int64).view(np.uint64))
        self.maybe = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.maybe[self._cells(self.terms)] = True

    @staticmethod
    def _cells(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)

    def __call__(self, batches):
        """(doc_id, held_out, terms, counts, others): the chosen terms of every text with how often
        they occur, and how many words are none of them."""
        reader = Reader()
        for rows, data, offsets in buffers.byte_groups(batches):
            n = len(offsets) - 1
            found, others = [], np.zeros(n, dtype=np.int64)
            for kind, (hashes, text) in enumerate(reader.read(data, offsets)):
                at = np.flatnonzero(self.maybe[self._cells(hashes)])
                place = np.searchsorted(self.terms, hashes[at])
                hit = place < len(self.terms)
                hit[hit] = self.terms[place[hit]] == hashes[at][hit]
                found.append(text[at[hit]] * (len(self.terms) + 1) + place[hit])
                if kind == 0:
                    others += np.bincount(text, minlength=n) - np.bincount(text[at[hit]], minlength=n)
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            text, term = np.divmod(keys, len(self.terms) + 1)
            edges = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (term, counts)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *lists, pa.array(others)], ["doc_id", "held_out", "terms", "counts", "others"])


# --- vectors and the index


class Weights:
    """TF-IDF weights; the last term stands for all other words."""

    def __init__(self, terms: int, found: dict[int, int], documents: int):
        self.idf = np.ones(terms + 1)
        for term in range(terms):
            self.idf[term] = 1 + math.log((1 + documents) / (1 + found.get(term, 0)))

    def units(self, terms: pa.Array, counts: pa.Array, others: np.ndarray):
        """(first entry of each row, terms, weights) of unit vectors, terms ascending, other words last.
        A text without chosen terms is that one term, whatever its length; without words it is empty."""
        sizes = np.diff(terms.offsets.to_numpy()) if len(terms) else np.zeros(0, np.int64)
        has_others = others > 0
        full = sizes + has_others
        start = np.concatenate([[0], np.cumsum(full)])
        ids, tf = np.empty(start[-1], dtype=np.int64), np.empty(start[-1])
        own = buffers.repeat_ranges(start[:-1], sizes)
        ids[own], tf[own] = terms.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False)
        last = start[1:][has_others] - 1
        ids[last], tf[last] = len(self.idf) - 1, np.where(sizes[has_others] > 0, others[has_others], 1)
        weight = (1 + np.log(tf)) * self.idf[ids]
        row = np.repeat(np.arange(len(full)), full)
        weight /= np.sqrt(np.bincount(row, weights=weight**2, minlength=len(full)))[row]
        return start, ids, weight


class Index:
    """Examples by term and block. Equal examples are one, with a number of toxic and of clean ones."""

    def __init__(self, doc_ids: np.ndarray, toxic: np.ndarray, start: np.ndarray, ids: np.ndarray, weights: np.ndarray, terms: int):
        rows = {}
        for n, d in enumerate(doc_ids.tolist()):
            own = slice(start[n], start[n + 1])
            if own.start < own.stop:
                rows.setdefault((ids[own].tobytes(), weights[own].tobytes()), []).append(n)
        # Like examples side by side: by their heaviest terms, so that few blocks hold a term's best.
        groups = []
        for members in rows.values():
            own = slice(start[members[0]], start[members[0] + 1])
            heavy = tuple(ids[own][np.argsort(-weights[own], kind="stable")[:4]].tolist())
            groups.append((heavy, min(doc_ids[members].tolist()), members, own))
        groups.sort(key=lambda g: g[:2])
        self.doc_ids = np.array([g[1] for g in groups], dtype=np.int64)
        self.toxic = np.array([int(toxic[g[2]].sum()) for g in groups], dtype=np.int64)
        self.clean = np.array([len(g[2]) for g in groups], dtype=np.int64) - self.toxic
        self.blocks = max(1, -(-len(groups) // BLOCK))
        example = np.repeat(np.arange(len(groups)), [g[3].stop - g[3].start for g in groups])
        term = np.concatenate([ids[g[3]] for g in groups]) if groups else np.zeros(0, np.int64)
        weight = np.concatenate([weights[g[3]] for g in groups]) if groups else np.zeros(0)
        order = np.lexsort((example, term))
        self.place, self.weight = (example % BLOCK)[order], weight[order]
        cell = (term * self.blocks + example // BLOCK)[order]
        self.first = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        highest = np.zeros(terms * self.blocks)
        np.maximum.at(highest, cell, self.weight)
        self.highest = highest.reshape(terms, self.blocks)

    def search(self, start: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, step: int = 4):
        """(examples, cosines), the ``k`` best of every row, the earlier example among equals; -1 where
        there are fewer."""
        n = len(start) - 1
        best, who = np.full((n, k), -1.0), np.full((n, k), -1)
        rows = max(1, BOUND_CELLS // self.blocks)
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(start, start[a] + rows, side="right")) - 1)
            b = min(b, n)
            if start[b] > start[a] and len(self.doc_ids):
                own = slice(start[a], start[b])
                best[a:b], who[a:b] = self._search(start[a : b + 1] - start[a], ids[own], weights[own], k, step)
            a = b
        return who, best

    def _search(self, start, ids, weights, k, step):
        n = len(start) - 1
        best, who = np.full((n, k), -1.0), np.full((n, k), -1)
        filled = np.flatnonzero(np.diff(start) > 0)
        bound = np.zeros((n, self.blocks))
        bound[filled] = np.add.reduceat(self.highest[ids] * weights[:, None], start[:-1][filled], axis=0)
        bound *= 1 + 1e-9  # sums in another order
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        open_rows = filled
        for at in range(0, self.blocks, step):
            open_rows = open_rows[(bound[open_rows, at] > 0) & (bound[open_rows, at] >= best[open_rows, -1])]
            if not len(open_rows):
                break
            blocks = order[open_rows, at : at + step]
            scores = self._scores(start, ids, weights, open_rows, blocks).reshape(len(open_rows), -1)
            examples = (blocks[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(len(open_rows), -1)
            scores, examples = np.concatenate([best[open_rows], np.where(scores > 0, scores, -1.0)], axis=1), np.concatenate([who[open_rows], examples], axis=1)
            top = np.lexsort((examples, -scores), axis=1)[:, :k]
            best[open_rows], who[open_rows] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(examples, top, axis=1)
        who[best <= 0] = -1
        return best, who

    def _scores(self, start, ids, weights, rows, blocks):
        """Exact dot products of every row with all examples of its blocks."""
        sizes = np.diff(start)[rows]
        entries = buffers.repeat_ranges(start[:-1][rows], sizes)
        owner = np.repeat(np.arange(len(rows)), sizes)
        cell = ids[entries][:, None] * self.blocks + blocks[owner]
        first, count = self.first[cell], self.first[cell + 1] - self.first[cell]
        slot = (owner[:, None] * blocks.shape[1] + np.arange(blocks.shape[1])).ravel()
        count, at = count.ravel(), buffers.repeat_ranges(first.ravel(), count.ravel())
        part = np.repeat(np.broadcast_to(weights[entries][:, None], cell.shape).ravel(), count) * self.weight[at]
        return np.bincount(np.repeat(slot, count) * BLOCK + self.place[at], weights=part, minlength=len(rows) * blocks.shape[1] * BLOCK)


class Judge:
    """Votes of the nearest examples, and what they mean as probabilities."""

    def __init__(self, index: Index, weights: Weights, per_label: tuple[float, float], prior: float, k: int = NEIGHBOURS):
        self.index, self.weights, self.per_label, self.prior, self.k = index, weights, per_label, prior, k
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def votes(self, who: np.ndarray, cosine: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
        """Share of toxic votes of the ``k`` nearest examples; of a group of equal examples that does
        not fit whole, both labels count in proportion. ``left_out`` (group, label) leaves out one."""
        # A place without a neighbour is -1: the group behind the last, with no example.
        toxic, clean = np.append(self.index.toxic, 0)[who].astype(float), np.append(self.index.clean, 0)[who].astype(float)
        if left_out is not None:
            own = who == left_out[:, :1]
            toxic -= own & (left_out[:, 1:] == 1)
            clean -= own & (left_out[:, 1:] == 0)
        size = toxic + clean
        room = np.clip(self.k - (np.cumsum(size, axis=1) - size), 0, None)
        share = np.divide(np.minimum(size, room), size, out=np.zeros_like(size), where=size > 0) * np.maximum(cosine, 0)
        yes, no = (share * toxic).sum(axis=1) * self.per_label[1], (share * clean).sum(axis=1) * self.per_label[0]
        return np.divide(yes, yes + no, out=np.full(len(yes), self.prior), where=yes + no > 0)

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Isotonic regression by pooling adjacent violators, each pool one vote short of certain."""
        order = np.argsort(votes, kind="stable")
        weight = np.where(toxic[order] == 1, self.per_label[1], self.per_label[0])
        pools: list[list[float]] = []
        for v, y, w in zip(votes[order].tolist(), toxic[order].tolist(), weight.tolist()):
            if pools and pools[-1][0] == v:
                pools[-1][2] += y * w
                pools[-1][3] += w
            else:
                pools.append([v, v, y * w, w])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                low, high, yes, all_ = pools.pop()
                pools[-1][1:] = [high, pools[-1][2] + yes, pools[-1][3] + all_]
        if pools:
            spots = np.array([(p[0] + p[1]) / 2 for p in pools])
            means = np.array([(p[2] + self.prior) / (p[3] + 1) for p in pools])
            self.steps = spots, np.maximum.accumulate(means)

    def probabilities(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(votes, *self.steps), 0.0, 1.0)

    def neighbours(self, rows: pa.RecordBatch, k: int):
        """(number of the distinct vector of each row, their neighbours and cosines); rows (doc_id, *,
        terms, counts, others). Equal vectors are looked up once."""
        start, ids, weights = self.weights.units(rows.column(2), rows.column(3), rows.column(4).to_numpy(zero_copy_only=False))
        seen: dict[bytes, int] = {}
        number, picked = np.empty(len(start) - 1, dtype=np.int64), []
        for n in range(len(start) - 1):
            own = slice(start[n], start[n + 1])
            key = ids[own].tobytes() + weights[own].tobytes()
            number[n] = seen.setdefault(key, len(picked))
            if number[n] == len(picked):
                picked.append(n)
        sizes = np.diff(start)[picked]
        entries = buffers.repeat_ranges(start[:-1][picked], sizes)
        who, cosine = self.index.search(np.concatenate([[0], np.cumsum(sizes)]), ids[entries], weights[entries], k)
        return number, who, cosine


def left_out_votes(shared):
    def run(batches):
        """(vote, toxic) of examples (doc_id, toxic, terms, counts, others), each without itself."""
        judge = shared.value
        for rows in batches:
            number, who, cosine = judge.neighbours(rows, judge.k + 1)
            toxic = rows.column(1).to_numpy(zero_copy_only=False)
            own = np.where(cosine[:, 0] > 1 - 1e-9, who[:, 0], -2)[number] if len(number) else number
            votes = judge.votes(who[number], cosine[number], np.stack([own, toxic], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(toxic, pa.int32())], ["vote", "toxic"])

    return run


def judged(shared):
    def run(batches):
        """(doc_id, held_out, score, evidence) of rows (doc_id, held_out, terms, counts, others)."""
        judge = shared.value
        for rows in batches:
            if not rows.num_rows:
                continue
            number, who, cosine = judge.neighbours(rows, judge.k)
            score = judge.probabilities(judge.votes(who, cosine))
            index = judge.index
            proof = [[{"example": int(index.doc_ids[w]), "cosine": float(c), "toxic": int(index.toxic[w]), "clean": int(index.clean[w])} for w, c in zip(ws, cs) if w >= 0] for ws, cs in zip(who.tolist(), cosine.tolist())]
            evidence = pa.array(proof, pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int64()), ("clean", pa.int64())]))).take(pa.array(number))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(score[number]), evidence], ["doc_id", "held_out", "score", "evidence"])

    return run


# --- the operator


def learnt_labels(labels: DataFrame, folds: int, left: int, examples: int) -> DataFrame:
    """(doc_id, toxic, rows) of a sample: of each label the ``examples`` doc_ids with the smallest hash,
    with how many rows the label has. A doc_id with both labels is toxic."""
    rows = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != left))
    each = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [each.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)]
    totals = each.groupBy("toxic").agg(F.count("*").alias("rows"))
    return parts[0].unionByName(parts[1]).join(totals, "toxic").select("doc_id", "toxic", "rows")


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = 4, left: int = 2, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, held_out, score, evidence) of every row of ``documents`` (doc_id, text).

    Learns from rows of ``labels`` (doc_id, toxic 0 or 1) whose crc32(doc_id as text) mod ``folds`` is
    not ``left``; labels of another value or without a doc_id are left out, and of a doc_id that occurs
    more than once in ``documents`` the smallest vector is the example. ``evidence`` lists the nearest
    groups of equal examples: the smallest doc_id of one, its cosine, and how many are toxic and clean.
    A null text counts as empty, a null doc_id as the empty text. Texts without a word get the share
    of toxic labels, or what the vote without neighbours was calibrated to; without any label all
    scores are 0. Repeated rows are judged one by one; other columns are not read.
    """
    spark = documents.sparkSession
    key = documents["doc_id"].cast("bigint")
    rows = documents.select(key.alias("doc_id"), documents["text"].cast("string").alias("text"), (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == left).alias("held_out"))
    sample = checkpointed(learnt_labels(labels, folds, left, examples))
    sizes = {r["toxic"]: (r["n"], r["rows"]) for r in sample.groupBy("toxic").agg(F.count("*").alias("n"), F.max("rows").alias("rows")).collect()}
    none = (0, 0)
    (clean, all_clean), (toxic, all_toxic) = sizes.get(0, none), sizes.get(1, none)
    # The sample has at most two times ``examples`` rows, so it may be broadcast.
    learnt = rows.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id")
    terms: list[int] = []
    if clean and toxic:
        counted = learnt.select("doc_id", "text", "toxic").mapInArrow(counted_terms, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # A doc_id with more than one row counts more than once, but never for more texts than there are.
        counts = F.least("toxic", F.lit(toxic)), F.least("clean", F.lit(clean)), toxic, clean
        apart = counted.select("term", told_apart(*counts).alias("ratio"), odds_apart(*counts).alias("odds"))
        terms = [r["term"] for r in apart.filter((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("ratio"), "term").limit(TERMS).collect()]
    shape = "doc_id long, held_out boolean, terms array<int>, counts array<int>, others long"
    found = checkpointed(rows.select("doc_id", "text", "held_out").mapInArrow(Vocabulary(terms), shape))
    held = {r["term"]: r["n"] for r in found.select("terms").mapInArrow(term_sums(len(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = Weights(len(terms), held, found.count())
    chosen = found.join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("terms", "counts", "others")).alias("v"))
    chosen = checkpointed(chosen.select("doc_id", "toxic", "v.*"))
    judge = Judge(example_index(chosen, weights, len(terms) + 1), weights, (all_clean / clean if clean else 0.0, all_toxic / toxic if toxic else 0.0), all_toxic / max(1, all_toxic + all_clean), neighbours)
    votes = chosen.mapInArrow(left_out_votes(spark.sparkContext.broadcast(judge)), "vote double, toxic int").toPandas()
    judge.calibrate(votes["vote"].to_numpy(), votes["toxic"].to_numpy())
    return found.mapInArrow(judged(spark.sparkContext.broadcast(judge)), "doc_id long, held_out boolean, score double, evidence array<struct<example: bigint, cosine: double, toxic: bigint, clean: bigint>>")


def example_index(chosen: DataFrame, weights: Weights, terms: int) -> Index:
    """The index of the sample's vectors (doc_id, toxic, terms, counts, others): bounded as the sample is."""
    table = chosen.orderBy("doc_id").toArrow().combine_chunks()
    columns = [table.column(name).combine_chunks() for name in ("doc_id", "toxic", "terms", "counts", "others")]
    start, ids, unit = weights.units(columns[2], columns[3], columns[4].to_numpy(zero_copy_only=False))
    return Index(columns[0].to_numpy(zero_copy_only=False), columns[1].to_numpy(zero_copy_only=False), start, ids, unit, terms)


def op11_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = toxicity(read("documents"), read("labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
