"""Operators on texts against their brute-force versions, over all the odd cases of the corpus."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import frame_of
from tidings.llm import decontaminate, hmm, language, pieces, shards, simhash, substrings, suffixes

CELLS = 1 << 18  # small enough that many windows share a cell


def got(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def doubled(rows):
    """Rows that repeat others, and rows without an id."""
    return [*rows, rows[3], rows[3], rows[8], *[(None, t) for _, t in rows[:6]], (None, rows[0][1])]


def test_simhash_groups(documents, rows):
    found = simhash.near_groups(documents).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")), "component_id")
    assert {tuple(r) for r in found.collect()} == brute.simhash_rows(rows)


def test_simhash_links_at_two_bits_not_three(spark):
    prints = [0, 0b11, 0b111 << 20, 1 << 63, (1 << 63) | 1, 0x5555555555555555, 0x5555555555555555 ^ 0b101]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "simhash long"))
    near = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    rooted = brute.roots(signed, [tuple(sorted(p)) for p in near])
    linked = [(r["a"], r["b"]) for r in found.collect()]
    assert {frozenset(p) for p in linked} <= near
    assert brute.roots(signed, linked) == rooted


def test_simhash_null_ids_and_repeats(spark, rows):
    frame = frame_of(spark, doubled(rows), clashing=True)
    marked = simhash.near_groups(frame)
    assert marked.count() == len(doubled(rows))
    plain = {r["simhash"]: r["component_id"] for r in simhash.near_groups(frame_of(spark, rows)).collect()}
    assert all(r["component_id"] == plain[r["simhash"]] for r in marked.collect())


def test_one_of_each(documents, rows):
    kept = simhash.one_of_each(documents)
    want = {c for _, _, c in brute.simhash_rows(rows)}
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_contamination(documents, rows, benchmark_table, benchmark_rows):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(brute.contamination_rows(rows, benchmark_rows), key=repr)
    assert any(w[5] for w in want) and any(w[2] and not w[5] for w in want)
    assert got(decontaminate.contamination(documents, benchmark_table), *columns) == want
    # Several blocks of test items give the same.
    assert got(decontaminate.contamination(documents, benchmark_table, block_bytes=300), *columns) == want


def test_contamination_keeps_clean_rows(documents, rows, benchmark_table, benchmark_rows):
    kept = decontaminate.without_contaminated(documents, benchmark_table)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, *_, bad in brute.contamination_rows(rows, benchmark_rows) if not bad)


def test_contamination_of_an_empty_benchmark(spark, documents, rows):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents, nothing).filter("contaminated or n_hit > 0").isEmpty()


def test_word_windows(documents, rows):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted(brute.word_repeat_rows(rows), key=repr)
    assert sum(w[2] > 0 for w in want) >= 4
    assert got(substrings.removal(documents, cells=CELLS), *columns) == want


def test_word_windows_with_null_ids_and_repeats(spark, rows):
    many = doubled(rows)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(substrings.removal(frame_of(spark, many), cells=CELLS), *columns) == sorted(brute.word_repeat_rows(many), key=repr)


def test_word_windows_cut_texts(documents, rows):
    kept = substrings.without_repeats(documents, cells=CELLS)
    assert kept.columns == documents.columns
    texts = dict(rows)
    want = {d: texts[d] if not gone else " ".join(own) for d, n, gone, own in brute.word_repeats(rows) if not n or gone < n}
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert {d: t for d, (t, _) in found.items()} == want
    assert all(n == (None if t is None else len(t)) for t, n in found.values())


def test_byte_strings(documents, rows):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(brute.byte_repeat_rows(rows), key=repr)
    assert sum(w[2] > 0 for w in want) > 8 and any(w[3] > 1 for w in want)
    assert got(suffixes.removal(documents, cells=CELLS), *columns) == want


@pytest.mark.parametrize("length,q", [(100, 100), (30, 15), (5, 3)])
def test_byte_strings_of_other_lengths(spark, rows, length, q):
    short = [(d, (t or "")[:400]) for d, t in rows]
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(suffixes.removal(frame_of(spark, short), length, q, CELLS), *columns) == sorted(brute.byte_repeat_rows(short, length), key=repr)


def test_byte_strings_of_repeated_rows(spark, rows):
    once = {r["doc_id"]: tuple(r) for r in suffixes.removal(frame_of(spark, rows), cells=CELLS).collect()}
    again = suffixes.removal(frame_of(spark, [*rows, *rows[:9], (None, rows[1][1])]), cells=CELLS).collect()
    assert len(again) == len(rows) + 10
    assert all(tuple(r) == once[r["doc_id"]] for r in again if r["doc_id"] is not None)
    last = next(r for r in again if r["doc_id"] is None)
    assert last["n_removed"] == (last["n_bytes"] if last["n_bytes"] >= 100 else 0)


def test_tokens_are_those_of_the_library(documents, rows):
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = []
    for d, t in rows:
        ids = [*reader.encode(t or ""), reader.eos_id()]
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(reader.decode(ids))))
    assert got(pieces.token_digests(documents, pieces.model_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_tokens_round_trip(spark, rows):
    frame = frame_of(spark, rows)
    back = pieces.decode(pieces.encode(frame, pieces.model_path()), pieces.model_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {d: (t or "").replace("▁", " ") for d, t in rows}


def test_slots(documents, rows):
    found = shards.sharded(documents, shards=4).toPandas().set_index("doc_id")
    sizes = {d: len((t or "").encode()) + 8 for d, t in rows}
    import zlib

    sums = {d: None if t is None else zlib.crc32(t.encode()) for d, t in rows}
    assert found["size"].to_dict() == sizes
    assert {d: None if c != c else int(c) for d, c in found["text_crc32"].items()} == sums
    assert all(sorted(g) == list(range(len(g))) for _, g in found.groupby("shard")["slot"])


def test_slots_are_near_equal_and_edits_are_few():
    import numpy as np

    load = np.random.default_rng(1).lognormal(5, 1, 4096)
    load[7] = load.sum() / 60
    first = shards.even_map(4096, 24)
    second = shards.rebalanced(first, load, 24)
    totals = np.bincount(second, weights=load, minlength=24)
    assert totals.max() - totals.min() < 0.001 * totals.mean()
    assert (first != second).mean() < 0.3
    assert (shards.rebalanced(second, load, 24) != second).mean() < 0.02


def test_hmm_base_scores(documents, rows):
    want = brute.base_scores(rows)
    # A small table of frequent tokens, so that most are joined.
    found = {r["doc_id"]: r for r in hmm.scores(documents, head=64, rounds=1).collect()}
    assert len(found) == len(rows)
    for d, (held, n, known, total, base) in want.items():
        r = found[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    whole = {r["doc_id"]: r["score"] for r in hmm.scores(documents, rounds=1).collect()}
    assert all(s < 0 for s in whole.values())


def test_hmm_likelihood_is_the_sum_over_all_paths():
    import itertools

    import numpy as np

    draw = np.random.default_rng(3)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(draw.uniform(0.1, 1, s))
    model = hmm.Hmm(share(3), share(3), share(3, 3), share(3, 5))
    texts = [draw.integers(0, 5, n) for n in (1, 2, 7)]
    symbol, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, log in zip(texts, hmm.likelihoods(model, symbol, first)):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(text)):
            p = model.start[path[0]] * model.emits[path[0], text[0]]
            for a, b, s in zip(path, path[1:], text[1:]):
                p *= model.moves[a, b] * model.emits[b, s]
            total += p
        assert log == pytest.approx(np.log10(total), rel=1e-9)


def test_hmm_long_texts_in_segments_are_exact():
    import numpy as np

    draw = np.random.default_rng(5)
    share = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(draw.uniform(0.1, 1, s))
    model = hmm.Hmm(share(4), share(4), share(4, 4), share(4, 9))
    texts = [draw.integers(0, 9, n) for n in (64, 65, 128, 1000)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, log in zip(texts, hmm.likelihoods(model, np.concatenate(texts), first)):
        now, total = model.start * model.emits[:, text[0]], 0.0
        for s in text[1:]:
            total, now = total + np.log10(now.sum()), (now / now.sum()) @ model.moves * model.emits[:, s]
        assert log == pytest.approx(total + np.log10(now.sum()), rel=1e-9)


def test_hmm_training_raises_the_likelihood():
    import numpy as np

    draw = np.random.default_rng(8)
    text = np.tile([0, 1, 2, 3], 400) + 0
    text[draw.integers(0, len(text), 100)] = 4
    model = hmm.Hmm.first(np.bincount(text, minlength=5).astype(float), 4)
    logs = []
    for _ in range(12):
        grid, _, order = hmm.segments_of(text, np.array([0, len(text)]), hmm.SEGMENT, 5)
        logs.append(hmm.likelihoods(model, text, np.array([0, len(text)]))[0])
        model = model.trained(hmm.expected(model, grid, order == 0))
    assert logs[-1] > logs[0] + 50 and all(b > a - 1 for a, b in zip(logs, logs[1:]))


@pytest.mark.parametrize(
    "run",
    [
        lambda d, b: simhash.near_groups(d),
        lambda d, b: simhash.one_of_each(d),
        lambda d, b: language.languages(d),
        lambda d, b: shards.sharded(d),
        lambda d, b: pieces.token_digests(d, pieces.model_path()),
        lambda d, b: decontaminate.contamination(d, b),
        lambda d, b: substrings.removal(d, cells=CELLS),
        lambda d, b: suffixes.removal(d, cells=CELLS),
        lambda d, b: hmm.scores(d, rounds=1),
    ],
)
def test_empty_tables(empty, benchmark_table, run):
    assert run(empty, benchmark_table).count() == 0
