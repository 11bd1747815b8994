"""The block-max search against all pairs, votes by hand, and held-out accuracy."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.harness import DATA
from tests.llm import brute
from tests.llm.conftest import frame_of, words
from tidings.llm import toxicity as tx

LABELS = "doc_id long, toxic int, other string"


def sparse(draw, n, terms, most):
    rows = [sorted(draw.choice(terms, size=draw.integers(0, most), replace=False).tolist()) for _ in range(n)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids = np.array([t for r in rows for t in r], dtype=np.int64)
    weights = draw.uniform(0.1, 3, len(ids)).round(1)
    row = np.repeat(np.arange(n), np.diff(start))
    return start, ids, weights / np.sqrt(np.bincount(row, weights=weights**2, minlength=n))[row]


def dense(start, ids, weights, terms):
    out = np.zeros((len(start) - 1, terms))
    out[np.repeat(np.arange(len(start) - 1), np.diff(start)), ids] = weights
    return out


@pytest.mark.parametrize("terms, n, k, step", [(40, 900, 5, 4), (300, 500, 17, 1), (3, 200, 4, 2), (20, 3, 8, 4)])
def test_search_is_that_of_all_pairs(terms, n, k, step):
    draw = np.random.default_rng(terms)
    made = sparse(draw, n, terms, min(terms, 9))
    doc_ids, toxic = draw.permutation(n), draw.integers(0, 2, n)
    index = tx.Index(doc_ids, toxic, *made, terms)
    asked = sparse(draw, 120, terms, min(terms, 9))
    who, cosine = index.search(*asked, k, step)
    every = dense(*made, terms)
    by_doc = {d: every[i] for i, d in enumerate(doc_ids.tolist())}
    groups = np.stack([by_doc[d] for d in index.doc_ids.tolist()])
    assert len(np.unique(groups, axis=0)) == len(groups) == len(np.unique(every[every.any(axis=1)], axis=0))
    assert index.toxic.sum() + index.clean.sum() == every.any(axis=1).sum()
    scores = dense(*asked, terms) @ groups.T
    for row, (ws, cs) in enumerate(zip(who, cosine)):
        want = np.sort(scores[row][scores[row] > 1e-12])[::-1][:k]
        held = ws >= 0
        assert held.sum() == len(want) and len(set(ws[held])) == held.sum()
        assert np.allclose(cs[held], want) and np.allclose(scores[row][ws[held]], want)


def test_blocks_are_skipped(monkeypatch):
    """Rows whose best examples fill one block look at few others."""
    draw = np.random.default_rng(2)
    n, terms = 64 * 40, 80
    ids = np.stack([np.arange(n) // 64, np.full(n, 40) + draw.integers(0, 40, n)], axis=1)
    weights = np.stack([draw.uniform(0.7, 0.99, n), np.zeros(n)], axis=1)
    weights[:, 1] = np.sqrt(1 - weights[:, 0] ** 2)
    index = tx.Index(np.arange(n), np.zeros(n, int), np.arange(0, 2 * n + 1, 2), ids.ravel(), weights.ravel(), terms)
    read, scores = [], tx.Index._scores
    monkeypatch.setattr(tx.Index, "_scores", lambda self, s, i, w, rows, blocks: read.append(blocks.size) or scores(self, s, i, w, rows, blocks))
    index.search(np.arange(41), np.arange(40), np.ones(40), 10, 1)
    assert sum(read) <= 2 * 40


def test_votes_of_equal_examples_are_shared():
    index = tx.Index(np.arange(6), np.array([1, 0, 0, 0, 1, 1]), np.arange(7), np.array([0, 0, 0, 0, 1, 1]), np.ones(6), 2)
    judge = tx.Judge(index, tx.Weights(1, {}, 1), (1.0, 1.0), 0.5, k=2)
    first = [n for n in range(2) if index.clean[n] == 3][0]
    who, cosine = np.array([[first, 1 - first], [-1, -1], [1 - first, first]]), np.array([[1.0, 0.5], [-1, -1], [1.0, 0.5]])
    assert np.allclose(judge.votes(who, cosine), [0.25, 0.5, 1.0])
    assert np.allclose(judge.votes(who, cosine, np.array([[first, 1], [-2, 0], [1 - first, 1]])), [0.0, 0.5, (1 + 0.5 * 0.25) / 1.5])


def test_isotonic_steps():
    judge = tx.Judge(tx.Index(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int), np.zeros(0, int), np.zeros(0), 1), tx.Weights(0, {}, 0), (1.0, 1.0), 0.5)
    draw = np.random.default_rng(0)
    votes = draw.uniform(size=4000)
    judge.calibrate(votes, (draw.uniform(size=4000) < votes**2).astype(int))
    asked = np.linspace(0, 1, 101)
    found = judge.probabilities(asked)
    assert (np.diff(found) >= 0).all() and np.abs(found - asked**2).max() < 0.12


def test_terms_and_counts(spark, documents, rows):
    """The chosen terms of every text, counted by a plain loop."""

    def terms_of(text):
        for w in brute.LETTERS.findall(brute.lower(text)):
            b = w.encode()
            yield ("word", b)
            yield from (("start", b[:n]) for n in tx.BEGINNINGS if len(b) > n)

    reader, names = tx.Reader(), {}
    for _, text in rows:
        data = (text or "").encode()
        kinds = list(reader.read(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])))
        hashes = Counter(int(h) for k in kinds for h in k[0].view(np.int64))
        plain = Counter(terms_of(text))
        assert sorted(hashes.values()) == sorted(plain.values())
        names.update(zip((int(h) for h in kinds[0][0].view(np.int64)), (("word", w.encode()) for w in brute.LETTERS.findall(brute.lower(text)))))
    chosen = sorted(names)[::3]
    found = documents.selectExpr("doc_id", "text", "true as held").mapInArrow(tx.Vocabulary(chosen), "doc_id long, held_out boolean, terms array<int>, counts array<int>, others long").collect()
    order = [int(t) for t in np.sort(np.array(chosen, dtype=np.int64).view(np.uint64)).view(np.int64)]
    texts = dict(rows)
    for r in found:
        every = brute.LETTERS.findall(brute.lower(texts[r["doc_id"]]))
        plain = Counter(w.encode() for w in every)
        want = {n: plain[names[t][1]] for n, t in enumerate(order) if plain[names[t][1]]}
        assert dict(zip(r["terms"], r["counts"])) == want and r["others"] == len(every) - sum(want.values())


def made(n, seed=5):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = words(draw, draw.randint(20, 120))
        if toxic:
            parts = text.split(" ")
            for _ in range(1 + len(parts) // 15):
                parts.insert(draw.randint(0, len(parts)), draw.choice(["Vilify!", "vermin,", "nastyx" + draw.choice("abcdef") + "q"]))
            text = " ".join(parts)
        rows.append((i, text))
        labels.append((i, int(toxic), "x"))
    return rows, labels


def test_toxic_texts_are_found_among_odd_rows(spark):
    rows, labels = made(800)
    odd = [(10_000, None), (10_001, ""), (10_002, " \n"), (None, "vermin vermin some words"), (None, None), (10_003, "VERMIN"), rows[0], rows[0], (10_004, " ".join(t for _, t in rows) * 3)]
    odd_labels = [(None, 1, "x"), (1, None, "x"), (3, 7, "x"), (0, 0, "y"), (0, 1, "y"), (99_999, 1, "z")]
    documents, table = frame_of(spark, rows + odd, clashing=True).selectExpr("*", "'t' as terms", "'o' as others", "'x' as toxic"), spark.createDataFrame(labels + odd_labels, LABELS)
    found = tx.toxicity(documents, table).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d for d, _ in rows + odd)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 800]
    wrong = [r["doc_id"] for r in held if (r["score"] >= tx.TOXIC_FROM) != (r["doc_id"] % 5 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[10_003]["score"] >= tx.TOXIC_FROM and by_id[10_000]["evidence"] == by_id[10_001]["evidence"] == by_id[10_002]["evidence"] == []
    proof = by_id[10_003]["evidence"]
    assert proof and all(e["toxic"] > e["clean"] for e in proof[:1]) and [e["cosine"] for e in proof] == sorted((e["cosine"] for e in proof), reverse=True)


def test_equal_texts_have_equal_scores_whatever_their_rows(spark):
    rows, labels = made(300)
    table = spark.createDataFrame(labels, LABELS)
    one = {r["doc_id"]: r["score"] for r in tx.toxicity(frame_of(spark, rows), table).collect()}
    again = {r["doc_id"]: r["score"] for r in tx.toxicity(frame_of(spark, rows[::-1]).repartition(7), table).collect()}
    assert one == pytest.approx(again, abs=1e-12)


def test_without_labels_or_documents(spark, empty):
    rows, labels = made(40)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in tx.toxicity(frame_of(spark, rows), none).collect()} == {0.0}
    assert tx.toxicity(empty, spark.createDataFrame(labels, LABELS)).count() == 0
    only = tx.toxicity(frame_of(spark, rows), spark.createDataFrame([(i, 0, "x") for i in range(40)], LABELS)).collect()
    assert len(only) == 40 and all(r["score"] < tx.TOXIC_FROM for r in only)


def test_held_out_accuracy(spark):
    folder = f"{DATA}/sf0.1"
    found = tx.op11_nearest_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert found.predicted[found.toxic == 1].mean() > 0.9 and found.predicted[found.toxic == 0].mean() < 0.01


def test_units_of_odd_batches():
    weights = tx.Weights(2, {0: 1}, 10)
    lists = lambda x: pa.array(x, pa.list_(pa.int32()))
    start, ids, w = weights.units(lists([[0, 1], [], [], [1]]), lists([[2, 1], [], [], [1]]), np.array([5, 7, 0, 0]))
    assert start.tolist() == [0, 3, 4, 4, 5] and ids.tolist() == [0, 1, 2, 2, 1] and w[3] == w[4] == 1.0


def test_texts_of_a_term_are_summed_per_task():
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], ["terms"])
    (found,) = tx.term_sums(6)(iter([batch([[0, 3], None, []]), batch([]), batch([[3], [5, 3]])]))
    assert found.to_pydict() == {"term": [0, 3, 5], "n": [1, 3, 1]}
    (found,) = tx.term_sums(0)(iter([batch([[], None])]))
    assert found.num_rows == 0
