"""The pipeline against the brute-force versions of its stages, one after the other."""

from __future__ import annotations

import corpus_pipeline

from tests.harness import DATA
from tests.llm import brute
from tidings.llm import language, pieces


def test_pipeline(spark):
    import sentencepiece

    folder = f"{DATA}/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    # The network has no brute-force version: its own verdicts are taken, and the rule is applied.
    verdicts = {r["doc_id"]: r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE for r in language.languages(documents).collect()}
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if verdicts[r["doc_id"]]]
    assert len(rows) >= 0.95 * len(verdicts)
    first = {c for _, _, c in brute.simhash_rows(rows)}
    rows = [(d, t) for d, t in rows if d in first]
    texts = dict(rows)
    rows = [(d, " ".join(kept) if gone else texts[d]) for d, n, gone, kept in brute.word_repeats(rows) if not n or gone < n]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_, contaminated in brute.contamination_rows(rows, benchmark) if contaminated}
    rows = [(d, t) for d, t in rows if d not in bad]
    reader = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert {d: r["text"] for d, r in found.items()} == dict(rows)
    for d, t in rows:
        assert found[d]["ids"] == [*reader.encode(t), reader.eos_id()] and found[d]["decoded"] == reader.decode(found[d]["ids"])
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_near_copies_are_those_of_operator_one(spark):
    """Fingerprints decide, not the share of common words; texts without words are linked like others."""
    from tidings.llm import simhash

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words, "end"]), " ".join(words[200:]), "", None, "one two", "one two three"]
    rows = [(10 - n, t, "en", "src1") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted({c for _, _, c in brute.simhash_rows([(d, t or "") for d, t, *_ in rows])})
    assert kept == sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())


def test_stages_keep_the_columns(spark):
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs.limit(60), folder)
        assert docs.columns[: len(columns)] == columns, name
        assert number == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
