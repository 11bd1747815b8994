"""The pipeline's near copies against all pairs of five-word sets."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import frame_of, words
from tidings.llm import near


def copies():
    """Texts with some words replaced, at similarities around 4/5, in chains and in one large group."""
    draw = random.Random(7)
    texts = []
    for k in range(25):
        own = words(draw, 200).split()
        texts.append(" ".join(own))
        for gone in range(1, 8):
            changed = list(own)
            for i in draw.sample(range(len(own)), gone):
                changed[i] = f"other{k}"
            texts.append(" ".join(changed))
    common = words(draw, 80).split()
    for k in range(150):
        changed = list(common)
        changed[draw.randrange(80)] = f"new{k}"
        texts.append(" ".join(changed) + f" end{k}")
    texts += [" ".join(common[:40]) + " " + words(draw, 30) for _ in range(40)]
    texts += ["a b c d e f g h i j k l m", "A b c d e f g h i j k l m n", "one two three four", "one two three", "one two  three four"]
    draw.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_are_those_of_all_pairs(spark, rows):
    every = [*copies(), *[(d + 10_000, t) for d, t in rows]]
    want = brute.near_kept(every)
    assert len(want) < len(every) - 150
    assert sorted(r["doc_id"] for r in near.one_of_each(frame_of(spark, every, clashing=True)).collect()) == want


@pytest.mark.parametrize("heavy, most", [(0, 1 << 19), (2, 40), (1 << 30, 1 << 19)])
def test_any_order_of_shingles_gives_the_same(spark, monkeypatch, heavy, most):
    monkeypatch.setattr(near, "HEAVY", heavy)
    monkeypatch.setattr(near, "MOST_HEAVY", most)
    every = copies()
    assert sorted(r["doc_id"] for r in near.one_of_each(frame_of(spark, every)).collect()) == brute.near_kept(every)


def test_odd_rows(spark):
    own = words(random.Random(3), 60)
    every = [(None, own), (4, own), (4, own), (5, own + " more"), (6, None), (7, ""), (8, " \t "), (9, "x " * 200_000)]
    assert sorted(r["doc_id"] for r in near.one_of_each(frame_of(spark, every, clashing=True)).collect()) == [4, 6, 9]


def test_passing_tables_go(spark):
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    near.near_groups(frame_of(spark, copies())).count()
    assert not list(folder.glob("passing-*"))


def test_no_documents(empty):
    assert near.one_of_each(empty).count() == 0


def test_pipeline_stage_drops_a_copy_with_words_changed(spark):
    own = words(random.Random(1), 200).split()
    changed = [*own[:60], "other", *own[61:140], "words", *own[141:]]
    found = corpus_pipeline.drop_near_copies(spark, frame_of(spark, [(1, " ".join(own)), (2, " ".join(changed))]), "")
    assert [r["doc_id"] for r in found.collect()] == [1]
