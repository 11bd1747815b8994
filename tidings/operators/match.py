"""Matching items to topics by keywords and by outside verdicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidings.functions import text as tx
from tidings.session import row_blocks

BLOCK_TERMS = 50_000
TEXTS = 200
KEYWORD_SCORE, VERDICT_SCORE = 10, 7


def topic_terms(topics: DataFrame) -> DataFrame:
    """(topic_id, pos, term, folded, original, exclude) of every keyword and exclusion."""
    raw = topics.select("topic_id", F.posexplode("keywords").alias("at", "entry"), F.lit(False).alias("exclude")).unionByName(
        topics.select("topic_id", F.posexplode("exclusions").alias("at", "entry"), F.lit(True).alias("exclude"))
    )
    terms = raw.select("topic_id", "exclude", "at", F.posexplode(tx.expand_keyword(F.col("entry"))).alias("part", "term"))
    return terms.filter(F.char_length("term") >= 2).select(
        "topic_id",
        "exclude",
        F.struct("at", "part").alias("pos"),
        "term",
        tx.fold_text(F.col("term")).alias("folded"),
        tx.is_acronym(F.col("term")).alias("original"),
    )


def keyword_hits(items: DataFrame, topics: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, topic_id, words): the distinct keywords of a topic found in ``text``, in list order.

    An exclusion found in the text empties the topic. All terms of a block are looked for in one pass
    over a text; texts pass through the blocks one after the other in one worker and only hits are shuffled, so the
    number of terms and the commonness of a word make no difference to the plan's joins.
    """
    terms = topic_terms(topics).select("topic_id", "exclude", F.col("pos.at").alias("at"), F.col("pos.part").alias("part"), "term", "folded", "original")
    hit = "array<struct<topic_id: bigint, exclude: boolean, at: int, part: int, term: string>>"
    state = items.select("item_id", "text", tx.fold_text(F.col("text")).alias("folded"), F.lit(None).cast(hit).alias("found"))
    finders = [_finder(rows) for rows in row_blocks(terms, "term", block_terms)]
    state = state.mapInArrow(_in_turn(finders), state.select("item_id", "found").schema)
    hits = state.select("item_id", F.explode("found").alias("h")).select("item_id", "h.*")
    pos = F.struct("at", "part")
    per_topic = hits.groupBy("item_id", "topic_id").agg(F.max("exclude").alias("blocked"), F.array_sort(F.collect_set(F.when(~F.col("exclude"), F.struct(pos.alias("pos"), "term")))).alias("found"))
    return per_topic.filter(~F.col("blocked")).select("item_id", "topic_id", F.array_distinct(F.col("found.term")).alias("words"))


def _in_turn(finders: list):
    """All blocks of terms one after the other in one worker; of a long batch ``TEXTS`` texts at a time
    are held as words of Python."""

    def find(batches):
        parts = (batch.slice(a, TEXTS) for batch in batches for a in range(0, batch.num_rows, TEXTS))
        for finder in finders:
            parts = finder(parts)
        for part in parts:
            yield part.select(["item_id", "found"])

    return find


def _finder(rows: list):
    """Adds the terms of one block found in each text to its hits."""
    by_text: list[dict] = [{}, {}]
    for r in rows:
        by_text[0 if r["original"] else 1].setdefault(r["term"] if r["original"] else r["folded"], []).append({k: r[k] for k in ("topic_id", "exclude", "at", "part", "term")})

    def find(batches):
        import ahocorasick

        machines = []
        for own in by_text:
            machine = ahocorasick.Automaton()
            for needle, terms in own.items():
                if needle:
                    machine.add_word(needle, (needle, terms))
            if len(machine):
                machine.make_automaton()
            machines.append(machine if len(machine) else None)

        def found(text: str, machine, whole: bool) -> dict:
            hits = {}
            for end, (needle, terms) in machine.iter(text):
                start = end - len(needle) + 1
                # A term begins a word; a term in its original spelling also ends one.
                if needle not in hits and not (start and text[start - 1].isalnum()) and not (whole and end + 1 < len(text) and text[end + 1].isalnum()):
                    hits[needle] = terms
            return hits

        for batch in batches:
            out = []
            for text, folded, held in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                hits = list(held or [])
                for side, machine, whole in ((text, machines[0], True), (folded, machines[1], False)):
                    if side and machine is not None:
                        hits.extend(x for terms in found(side, machine, whole).values() for x in terms)
                out.append(hits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, batch.schema.field(3).type)], names=batch.schema.names)

    return find


def decode_verdicts(answers: DataFrame, item_index: DataFrame, topic_index: DataFrame) -> DataFrame:
    """(item_id, topic_id) from answers (batch_no, i, t array) by position in the batch.

    Positions outside the batch or the topic list are ignored.
    """
    flat = answers.select("batch_no", F.col("i").alias("idx"), F.explode("t").alias("topic_idx"))
    return (
        flat.join(item_index.select("batch_no", "idx", "item_id"), ["batch_no", "idx"])
        .join(topic_index.select(F.col("idx").alias("topic_idx"), "topic_id"), "topic_idx")
        .select("item_id", "topic_id")
        .distinct()
    )


def combine_matches(items: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item_id, topic_id, score, reason) from items (item_id, batch_ok), hits and verdict pairs.

    A verdict decides; the keywords found are noted with it. Where the item's batch failed, the
    keywords alone count.
    """
    listed = F.array_join("words", ", ")
    judged = (
        verdicts.join(items.filter("batch_ok").select("item_id"), "item_id", "left_semi")
        .join(hits, ["item_id", "topic_id"], "left")
        .select(
            "item_id",
            "topic_id",
            F.when(F.col("words").isNotNull(), F.lit(KEYWORD_SCORE)).otherwise(F.lit(VERDICT_SCORE)).cast("bigint").alias("score"),
            F.when(F.col("words").isNotNull(), F.concat(F.lit("ai; keywords: "), listed)).otherwise(F.lit("ai")).alias("reason"),
        )
    )
    fallback = hits.join(items.filter(~F.col("batch_ok")).select("item_id"), "item_id", "left_semi").select(
        "item_id", "topic_id", F.lit(KEYWORD_SCORE).cast("bigint").alias("score"), F.concat(F.lit("keywords (AI unavailable): "), listed).alias("reason")
    )
    return judged.unionByName(fallback)


def match_status(items: DataFrame, matches: DataFrame) -> DataFrame:
    """(item_id, status): matched items are scored, the rest not relevant, or still new when their
    batch failed."""
    matched = matches.select("item_id", F.lit(True).alias("matched")).distinct()
    return items.join(matched, "item_id", "left").select(
        "item_id",
        F.when(F.col("matched"), F.lit("scored")).when(F.col("batch_ok"), F.lit("not_relevant")).otherwise(F.lit("new")).alias("status"),
    )


def topic_backfill(matches: DataFrame, items: DataFrame, story_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effects of matching new topics over stored items (item_id, status).

    Returns the items that go back to 'scored' and the (story_id, topic_id) tags of items that
    already belong to a story.
    """
    pairs = matches.select("item_id", "topic_id").distinct()
    reopened = items.filter("status = 'not_relevant'").join(pairs, "item_id", "left_semi").withColumn("status", F.lit("scored"))
    tags = pairs.join(story_items, "item_id").select("story_id", "topic_id").distinct()
    return reopened, tags


def topic_keyword_list(topics: DataFrame) -> DataFrame:
    """Keyword list per topic: its name and the generated words, trimmed, distinct, in order.

    Without generated words the kept list stays, or the name alone.
    """
    cleaned = F.filter(F.transform(F.concat(F.array("name"), F.col("generated")), lambda k: F.trim(k)), lambda k: k != "")
    kept = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array("name"))
    return topics.withColumn("keywords", F.when(F.size(F.coalesce("generated", F.array().cast("array<string>"))) > 0, F.array_distinct(cleaned)).otherwise(kept))


def search_queries(topics: DataFrame, source_id) -> DataFrame:
    """(topic_id, query, source_id): the distinct queries of each topic for one search source. Work is
    handed out per source, so the pairs of all topics and sources are never listed."""
    queries = topics.select("topic_id", F.explode(F.array_union("queries_a", "queries_b")).alias("query"))
    return queries.select("topic_id", "query", F.lit(source_id).alias("source_id"))
