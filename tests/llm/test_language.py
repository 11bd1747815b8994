"""Language identification: held-out accuracy, gradients, odd texts."""

from __future__ import annotations

import numpy as np

from tests.harness import DATA
from tests.llm.conftest import frame_of
from tidings.llm import language


def test_gradients_are_those_of_small_differences():
    network = language.Network(["a", "b", "c"])
    network.weights = [w.astype(np.float64) for w in network.weights]
    draw = np.random.default_rng(2)
    grid = draw.integers(0, 256, (5, 12))
    grid[1, 7:] = language.PAD
    target = draw.integers(0, 3, 5)
    _, found = network.gradients(grid, target)
    for weight, gradient in zip(network.weights, found):
        flat = np.argsort(-np.abs(gradient).ravel())[:5]
        for i in flat:
            at = np.unravel_index(i, weight.shape)
            kept, step = weight[at], 1e-2
            weight[at] = kept + step
            up, _ = network.gradients(grid, target)
            weight[at] = kept - step
            down, _ = network.gradients(grid, target)
            weight[at] = kept
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3 + 0.02 * abs(gradient[at])


def test_pieces_cover_every_byte():
    data = np.arange(200, dtype=np.uint8)
    offsets = np.array([0, 0, 3, 150, 200])
    grid, text = language.grid_of(data, offsets, 64)
    for i in range(4):
        joined = grid[text == i]
        assert joined[joined != language.PAD].tolist() == data[offsets[i] : offsets[i + 1]].tolist()


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = language.languages(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.filter("score < 0 or score > 1").isEmpty()


def test_texts_without_letters(spark):
    labelled = [(i, t) for i, t in enumerate(["the cat and the dog " * 5, "der hund und die katze " * 5] * 30)]
    odd = [(1000, None), (1001, ""), (1002, "12 -- 34"), (1003, "漢字"), (None, "the cat and the dog")]
    from pyspark.sql import functions as F

    frame = frame_of(spark, labelled + odd, clashing=True).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") < 1000, "de"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(frame).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[1003][0] in ("en", "de") and found[None][0] == "en"
    assert all(found[i][0] == ("en", "de")[i % 2] for i in range(60))
    kept = language.in_known_language(frame, 0.4)
    assert kept.columns == frame.columns and kept.filter("doc_id in (1000, 1001, 1002)").isEmpty() and kept.filter("doc_id < 1000").count() == 60


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    frame = frame_of(spark, [(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert [(r["lang_pred"], r["score"]) for r in language.languages(frame).collect()] == [("und", 0.0)] * 2
