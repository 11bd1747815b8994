"""Joins of items with topics and stories by vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidings.functions import scoring, vectors as vx
from tidings.operators import neighbours
from tidings.session import checkpointed


def _matrix(flat, rows: int) -> np.ndarray:
    return np.asarray(flat).reshape(rows, -1)


def _unit_rows(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a length, with ``unit`` in its place."""
    length = vx.norm(F.col(vector))
    unit = F.transform(vector, lambda x: x.cast("double") / length)
    return df.filter(F.col(vector).isNotNull()).withColumn("unit", F.when(length > 0, unit)).filter("unit is not null").drop(vector)


def similar_pairs(items: DataFrame, topics: DataFrame, threshold: float, block: int = neighbours.BLOCK) -> DataFrame:
    """(item_id, topic_id, cosine) of items and topics at least ``threshold`` (above 0) alike.

    Blocks of items meet blocks of topics, a matrix product each, and only matches leave a task. At the
    low thresholds asked for here vectors have no cells that would spare comparisons.
    """
    left = neighbours.packed(_unit_rows(items.select("item_id", "embedding"), "embedding"), ["item_id"], "unit", rows=block).withColumnRenamed("units", "item_units")
    right = neighbours.packed(_unit_rows(topics.select("topic_id", "embedding"), "embedding"), ["topic_id"], "unit", rows=block).withColumnRenamed("units", "topic_units")
    schema = T.StructType([items.schema["item_id"], topics.schema["topic_id"], T.StructField("cosine", T.DoubleType())])

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, units, topic_ids, topic_units in part.itertuples(index=False):
                scores = _matrix(units, len(ids)) @ _matrix(topic_units, len(topic_ids)).T
                row, column = np.nonzero(scores >= threshold)
                yield pd.DataFrame({"item_id": np.asarray(ids)[row], "topic_id": np.asarray(topic_ids)[column], "cosine": scores[row, column]})

    return neighbours.every_meeting(left, right).select("item_ids", "item_units", "topic_ids", "topic_units").mapInPandas(compare, schema)


def relevance_scores(batch_items: DataFrame, verdicts: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores and outcomes of relevance batches.

    ``batch_items`` (item_id, topic_id, batch_ok) lists what was asked; ``verdicts`` (item_id,
    topic_id, score, reason) what came back. A missing answer or a failed batch is a failure, never
    a low score. Returns (item_id, topic_id, score, reason) and (item_id, outcome).
    """
    answered = (
        batch_items.join(verdicts, ["item_id", "topic_id"], "left")
        .join(topics.select("topic_id", "relevance_threshold"), "topic_id")
        .withColumn("scored", F.col("batch_ok") & F.col("score").isNotNull())
    )
    scores = answered.filter("scored").select("item_id", "topic_id", "score", "reason")
    outcome = answered.groupBy("item_id").agg(
        F.bool_or(F.col("scored") & (F.col("score") >= F.col("relevance_threshold"))).alias("cleared"),
        F.bool_or(~F.col("scored")).alias("failed"),
    )
    return scores, outcome.select("item_id", scoring.relevance_outcome(F.col("cleared"), F.col("failed")).alias("outcome"))


def best_stories(items: DataFrame, stories: DataFrame, high: float, low: float, window_hours: int = 72, block: int = neighbours.BLOCK) -> DataFrame:
    """(item_id, story_id, cosine, action): the most alike story last touched within the window.

    'attach' from ``high`` up, 'confirm' from ``low`` (above 0) up, else 'new' with no story. Equal
    similarities go to the lower story id. Stories lie in the cell of their centroid and the time slot
    of their last update; an item looks in the slots of its window and the cells that ``low`` leaves
    open. What shares cell and slot meets in blocks, and each meeting sends an item's best story.
    """
    window = window_hours * 3600 * 1_000_000
    at = lambda column: F.unix_micros(F.col(column).cast("timestamp")).alias("at")
    slot = F.floor(F.col("at") / window).cast("bigint")
    usable = items.filter(F.col("embedding").isNotNull()).select("item_id", "embedding", at("published_at"))
    radius = neighbours.chord(low)
    placed = neighbours.place(checkpointed(_unit_rows(stories.select("story_id", "centroid", at("last_updated_at")), "centroid")), "story_id", "unit", radius)
    lying = placed.rows.withColumn("slot", slot).withColumnRenamed("home", "cell")
    looking = _unit_rows(usable, "embedding").withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).withColumn("cell", F.explode(placed.reach(F.col("unit"), radius)))
    right = neighbours.packed(lying, ["story_id", "at"], "unit", ["slot", "cell"], block).withColumnsRenamed({"ats": "story_ats", "units": "story_units"})
    left = neighbours.packed(looking, ["item_id", "at"], "unit", ["slot", "cell"], block)
    met = left.join(right, ["slot", "cell"]).select("item_ids", "ats", "units", "story_ids", "story_ats", "story_units")
    schema = T.StructType([items.schema["item_id"], stories.schema["story_id"], T.StructField("cosine", T.DoubleType())])
    found = met.mapInPandas(_best(low, window), schema).groupBy("item_id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "story_id")).alias("b"))
    state = usable.select("item_id").join(found.select("item_id", F.col("b.story_id").alias("story_id"), (-F.col("b.less")).alias("cosine")), "item_id", "left")
    action = F.when(F.col("cosine") >= high, F.lit("attach")).when(F.col("cosine") >= low, F.lit("confirm")).otherwise(F.lit("new"))
    return state.select("item_id", "story_id", "cosine", action.alias("action"))


def _best(low: float, window: int):
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, ats, units, story_ids, story_ats, story_units in part.itertuples(index=False):
                order = np.argsort(np.asarray(story_ids), kind="stable")
                scores = _matrix(units, len(ids)) @ _matrix(story_units, len(story_ids))[order].T
                scores[np.abs(np.asarray(ats)[:, None] - np.asarray(story_ats)[order][None, :]) > window] = -np.inf
                first = scores.argmax(axis=1)
                top = scores[np.arange(len(first)), first]
                kept = np.flatnonzero(top >= low)
                yield pd.DataFrame({"item_id": np.asarray(ids)[kept], "story_id": np.asarray(story_ids)[order][first[kept]], "cosine": top[kept]})

    return compare


def updated_centroids(stories: DataFrame, joined: DataFrame) -> DataFrame:
    """(story_id, centroid, n) after the items of ``joined`` (story_id, embedding) came in.

    The mean of old and new vectors, summed per position, so one row per story and position leaves
    each map task.
    """
    added = joined.select("story_id", F.posexplode("embedding").alias("pos", "x")).groupBy("story_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("k"))
    old = stories.select("story_id", F.col("n").cast("bigint").alias("n"), F.posexplode("centroid").alias("pos", "c"))
    both = old.join(added, ["story_id", "pos"], "left")
    k = F.coalesce(F.col("k"), F.lit(0))
    mean = (F.col("c").cast("double") * F.col("n") + F.coalesce(F.col("x"), F.lit(0.0))) / (F.col("n") + k)
    parts = both.select("story_id", (F.col("n") + k).alias("n"), F.struct("pos", mean.alias("m")).alias("p"))
    return parts.groupBy("story_id", "n").agg(F.array_sort(F.collect_list("p")).alias("p")).select("story_id", F.col("p.m").alias("centroid"), "n")


def new_story_id(leader: Column, kind: T.DataType) -> Column:
    """A digest of the leading item as a story id: 60 bits of a number, or text."""
    digest = F.sha2(F.concat(F.lit("story "), leader.cast("string")), 256)
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s"), F.substring(digest, 1, 16))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast(kind)


def cluster_batch(items: DataFrame, stories: DataFrame, same_story: DataFrame, high: float, low: float, window_hours: int = 72) -> DataFrame:
    """(item_id, story_id, is_new) for one batch of items against a snapshot of open stories.

    Confirmations come from ``same_story`` (item_id, story_id, same); a missing one means a new
    story. Items that open stories take in the batch's own time order: the earliest item leads and
    later ones near it join its story, whose id is a digest of its leader, so that it meets no id that
    is in use. Centroids move between batches, not inside one, so a batch gives the same result in any
    task layout.
    """
    from tidings.operators.dedup import Nearness, canonical_items

    decided = best_stories(items, stories, high, low, window_hours).join(same_story, ["item_id", "story_id"], "left")
    attach = (F.col("action") == "attach") | ((F.col("action") == "confirm") & F.coalesce(F.col("same"), F.lit(False)))
    decided = checkpointed(decided.withColumn("attach", attach))
    attached = decided.filter("attach").select("item_id", "story_id", F.lit(False).alias("is_new"))
    fresh = items.join(decided.filter(~F.col("attach")).select("item_id"), "item_id", "left_semi")
    led = canonical_items(fresh.select("item_id", "published_at", "embedding"), Nearness(window_hours, None, high))
    leader = F.coalesce("canonical_item_id", "item_id")
    created = led.select("item_id", new_story_id(leader, stories.schema["story_id"].dataType).alias("story_id"), F.lit(True).alias("is_new"))
    return attached.unionByName(created)
