"""Language of texts by a bidirectional gated recurrent network over bytes.

Two light gated layers (an update gate and a candidate state) read every piece of a text forwards and
backwards; each byte position gets a probability for every language, and a document's probability is
the mean over all its positions. The network is trained in numpy by backpropagation through time on a
bounded sample: at most about ``2 * PER_LANGUAGE`` labelled documents a language, ``PIECES`` pieces of
each. Texts are read whole; only the weights (a few thousand numbers) are sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import buffers
from tidings.llm.tables import free_name

PER_LANGUAGE = 300
PIECES = 4
PIECE = 64
SEGMENT = 128
HIDDEN = 8
WIDTH = 6
STEPS = 400
BATCH = 192
BLOCK = 2048
PAD = 256


class Network:
    """Byte vectors (257, WIDTH), gates (2, 2 HIDDEN, HIDDEN + WIDTH + 1), labels (n, 2 HIDDEN + 1)."""

    def __init__(self, languages: list[str], seed: int = 11):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.weights = [
            draw.normal(0, 0.5, (257, WIDTH)).astype(np.float32),
            draw.normal(0, 0.4, (2, 2 * HIDDEN, HIDDEN + WIDTH + 1)).astype(np.float32),
            draw.normal(0, 0.3, (len(languages), 2 * HIDDEN + 1)).astype(np.float32),
        ]

    def states(self, grid: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(positions, 2 HIDDEN, pieces) of a (pieces, positions) grid of bytes and PAD. A pad leaves
        the state as it is. ``keep`` receives what backpropagation needs."""
        vectors, gates, _ = self.weights
        n, size = grid.shape
        padded = bool((grid == PAD).any())
        table = np.ascontiguousarray(vectors.T)
        columns = np.ascontiguousarray(grid.T)
        out = np.empty((size, 2 * HIDDEN, n), dtype=np.float32)
        entry = np.zeros((2, HIDDEN + WIDTH + 1, n), dtype=np.float32)
        entry[:, -1] = 1
        half = gates.copy()
        half[:, :HIDDEN] *= 0.5  # the logistic function as a hyperbolic tangent
        for t in range(size):
            for d, at in enumerate((t, size - 1 - t)):
                np.take(table, columns[at], axis=1, out=entry[d, HIDDEN:-1])
            pre = np.tanh(half @ entry)
            z = pre[:, :HIDDEN]
            z *= 0.5
            z += 0.5
            if padded:
                for d, at in enumerate((t, size - 1 - t)):
                    z[d] *= columns[at] != PAD
            if keep is not None:
                keep.append((entry.copy(), z.copy(), pre[:, HIDDEN:].copy()))
            change = pre[:, HIDDEN:]
            change -= entry[:, :HIDDEN]
            change *= z
            entry[:, :HIDDEN] += change
            out[t, :HIDDEN] = entry[0, :HIDDEN]
            out[size - 1 - t, HIDDEN:] = entry[1, :HIDDEN]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(positions, languages, pieces)."""
        labels = self.weights[2]
        logits = labels[:, :-1] @ states + labels[:, -1][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, grid: np.ndarray, target: np.ndarray):
        """Mean cross entropy over all positions and its gradients, back through time."""
        vectors, gates, labels = self.weights
        keep: list = []
        states = self.states(grid, keep)
        prob = self.probabilities(states)
        n, size = grid.shape
        real = (grid.T != PAD).astype(np.float32)
        count = max(1.0, float(real.sum()))
        picked = prob[:, target, np.arange(n)]
        loss = float(-(np.log(picked + 1e-9) * real).sum() / count)
        prob[:, target, np.arange(n)] -= 1
        prob *= real[:, None, :] / count
        d_labels = np.concatenate([np.einsum("tln,thn->lh", prob, states), prob.sum(axis=(0, 2))[:, None]], axis=1)
        d_states = labels[:, :-1].T @ prob
        d_gates, d_vectors = np.zeros_like(gates), np.zeros_like(vectors)
        ahead = np.zeros((2, HIDDEN, n), dtype=np.float32)
        for t in range(size - 1, -1, -1):
            entry, z, fresh = keep[t]
            grow = ahead + np.stack([d_states[t, :HIDDEN], d_states[size - 1 - t, HIDDEN:]])
            before = entry[:, :HIDDEN]
            d_pre = np.concatenate([grow * (fresh - before) * z * (1 - z), grow * z * (1 - fresh**2)], axis=1)
            d_gates += d_pre @ entry.transpose(0, 2, 1)
            d_entry = gates.transpose(0, 2, 1) @ d_pre
            ahead = grow * (1 - z) + d_entry[:, :HIDDEN]
            for d, at in enumerate((t, size - 1 - t)):
                np.add.at(d_vectors, grid[:, at], d_entry[d, HIDDEN:-1].T)
        return loss, [d_vectors, d_gates, d_labels]

    def train(self, grid: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 5) -> "Network":
        """Adam over balanced batches; pieces are also seen cut short, as short texts are."""
        draw = np.random.default_rng(seed)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        by_label = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            label = draw.integers(0, len(self.languages), BATCH)
            rows = np.array([draw.choice(by_label[k]) for k in label])
            batch = grid[rows].copy()
            if step % 2:
                length = draw.integers(3, PIECE + 1, BATCH)
                batch[np.arange(PIECE)[None, :] >= length[:, None]] = PAD
            _, found = self.gradients(batch, target[rows])
            rate = 0.02 * (1 - step / (steps + 1))
            for w, g, a, b in zip(self.weights, found, first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return self


def grid_of(data: np.ndarray, offsets: np.ndarray, size: int):
    """All bytes as (pieces, size) padded with PAD, full pieces and others alike; the text of each."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = offsets[text] + buffers.repeat_ranges(np.zeros(len(counts), dtype=np.int64), counts) * size
    place = begin[:, None] + np.arange(size)[None, :]
    return np.where(place < offsets[text + 1][:, None], data[np.minimum(place, max(len(data) - 1, 0))].astype(np.int64), PAD), text


def sample_pieces(shares: dict[str, float]):
    """Pieces of the labelled documents whose hash falls under the share of their language."""

    def run(batches):
        for rows, data, offsets in buffers.byte_groups(batches):
            languages, order = rows.column(1).to_pylist(), rows.column(2).to_pylist()
            out = []
            for i, (name, h) in enumerate(zip(languages, order)):
                if not 0 <= h < shares.get(name, 0.0) * 2.0**62:
                    continue
                a, b = int(offsets[i]), int(offsets[i + 1])
                for k in range(min(PIECES, -(-(b - a) // PIECE))):
                    at = a + k * max(0, b - a - PIECE) // max(1, PIECES - 1)
                    out.append((name, h, k, data[at : min(at + PIECE, b)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "h", "k", "piece"])

    return run


def trained(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network learnt from (text, lang, h): rows are counted per language, and a share of each
    language is drawn by the hash ``h`` (0 to 2**62) so that about ``per_language`` documents are
    taken (fewer where there are fewer)."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    shares = {k: min(1.0, per_language / n) for k, n in counts.items()}
    rows = labelled.select("text", "lang", "h").mapInArrow(sample_pieces(shares), "lang string, h long, k long, piece binary").collect()
    rows = sorted((r["lang"], r["h"], r["k"], bytes(r["piece"])) for r in rows)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    grid = np.full((len(rows), PIECE), PAD, dtype=np.int64)
    for i, (_, _, _, piece) in enumerate(rows):
        grid[i, : len(piece)] = np.frombuffer(piece, dtype=np.uint8)
    return Network(languages).train(grid, np.array([languages.index(r[0]) for r in rows]))


def pooled(network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean over all byte positions of each text; zeros for empty texts."""
    texts = len(offsets) - 1
    total = np.zeros((texts, len(network.languages)))
    if len(data):
        grid, text = grid_of(data, offsets, SEGMENT)
        order = np.argsort(grid[:, -1] == PAD, kind="stable")  # short pieces last, so that few blocks hold pads
        for a in range(0, len(order), BLOCK):
            own = order[a : a + BLOCK]
            used = grid[own]
            prob = network.probabilities(network.states(used))
            if (used[:, -1] == PAD).any():
                prob *= (used.T != PAD)[:, None, :]
            np.add.at(total, text[own], prob.sum(axis=0).T)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def judged(network, letters, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``letters`` tells which hold a letter."""
    if network is None:
        return ["und"] * len(letters), np.zeros(len(letters))
    mean = pooled(network, data, offsets)
    best = mean.argmax(axis=1)
    sure = np.array(letters, dtype=bool)
    names = [network.languages[b] if s else "und" for b, s in zip(best.tolist(), sure.tolist())]
    return names, np.where(sure, np.clip(mean[np.arange(len(best)), best], 0.0, 1.0), 0.0)


def label_batches(shared):
    def run(batches):
        for rows, data, offsets in buffers.byte_groups(batches):
            names, score = judged(shared.value, rows.column(2).to_pylist(), data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(3), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def network_of(documents: DataFrame, folds: int, per_language: int):
    """The network learnt from the documents outside the held-out fold, sent to the executors."""
    id_text, text = _id_text(documents), documents["text"].cast("string")
    labelled = documents.filter((F.crc32(id_text) % folds != 0) & documents["lang"].isNotNull() & text.isNotNull())
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), id_text, text), 2)
    network = trained(labelled.select(text.alias("text"), documents["lang"].cast("string").alias("lang"), drawn.alias("h")), per_language)
    return documents.sparkSession.sparkContext.broadcast(network)  # a few thousand weights


def _id_text(documents: DataFrame):
    return F.coalesce(documents["doc_id"].cast("string"), F.lit(""))


def _letters(documents: DataFrame):
    return F.coalesce(documents["text"].cast("string").rlike("\\p{L}"), F.lit(False))


def languages(documents: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text.

    Learns from rows with a label and a text whose crc32(doc_id as text) mod ``folds`` is not 0; a
    null doc_id counts as the empty text. ``und`` with score 0 stands for a null text, a text without
    a letter, and for all texts when there is nothing to learn from. Rows are judged one by one.
    """
    rows = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"),
        documents["text"].cast("string").alias("text"),
        _letters(documents).alias("letters"),
        (F.crc32(_id_text(documents)) % folds == 0).alias("held_out"),
    )
    return rows.mapInArrow(label_batches(network_of(documents, folds, per_language)), "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(documents: DataFrame, least: float, folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents, all columns as they came, whose language is found with a score of at least
    ``least``; texts that are null or hold no letter go. No shuffle."""
    shared = network_of(documents, folds, per_language)

    def run(batches):
        for rows, data, offsets in buffers.byte_groups(batches):
            kept = rows.num_columns - 1
            names, score = judged(shared.value, rows.column(kept).to_pylist(), data, offsets)
            keep = [n != "und" and s >= least for n, s in zip(names, score.tolist())]
            yield pa.RecordBatch.from_arrays(rows.columns[:kept], names=rows.schema.names[:kept]).filter(pa.array(keep, pa.bool_()))

    return documents.select("*", _letters(documents).alias(free_name(documents, "_letters"))).mapInArrow(run, documents.schema)


def op2_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
