"""Re-judging keyword-only matches and applying the difference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.operators.match import VERDICT_SCORE
from tidings.operators.stories import attach_topics

_KEY = ["item_id", "topic_id"]


def rematch_diff(keyword_only: DataFrame, verdicts: DataFrame, all_scores: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, topic_id, change, reason): keyword-only scores a verdict keeps or drops, and
    verdicts without any score, which are added."""
    listed = hits.select(*_KEY, F.array_join("words", ", ").alias("listed"))
    reason = F.coalesce(F.concat(F.lit("ai; keywords: "), F.col("listed")), F.lit("ai"))
    kept = keyword_only.select(*_KEY).join(verdicts.select(*_KEY), _KEY, "left_semi").withColumn("change", F.lit("keep"))
    dropped = keyword_only.select(*_KEY).join(verdicts.select(*_KEY), _KEY, "left_anti").withColumn("change", F.lit("drop"))
    added = verdicts.select(*_KEY).distinct().join(all_scores.select(*_KEY), _KEY, "left_anti").withColumn("change", F.lit("add"))
    both = kept.unionByName(added).join(listed, _KEY, "left").select(*_KEY, "change", reason.alias("reason"))
    return both.unionByName(dropped.withColumn("reason", F.lit(None).cast("string")))


def rematch_summary(diff: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, kept, dropped) counts."""
    named = diff.filter("change <> 'add'").join(topics.select("topic_id", F.col("name").alias("topic")), "topic_id")
    return named.groupBy("topic").pivot("change", ["keep", "drop"]).count().select("topic", F.coalesce("keep", F.lit(0)).alias("kept"), F.coalesce("drop", F.lit(0)).alias("dropped"))


def applied_scores(scores: DataFrame, diff: DataFrame) -> DataFrame:
    """Score snapshot after the difference: dropped rows gone, kept reasons renewed, added rows in."""
    kept = scores.join(diff.filter("change = 'drop'").select(*_KEY), _KEY, "left_anti").join(
        diff.filter("change = 'keep'").select(*_KEY, F.col("reason").alias("new_reason")), _KEY, "left"
    )
    renewed = kept.select(*_KEY, "score", F.coalesce("new_reason", "reason").alias("reason"))
    return renewed.unionByName(diff.filter("change = 'add'").select(*_KEY, F.lit(VERDICT_SCORE).cast("bigint").alias("score"), "reason"))


def rematch_apply(diff: DataFrame, scores_after: DataFrame, items: DataFrame, stories: DataFrame, story_items: DataFrame, story_topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(story_topics, stories, items) after a rematch.

    Stories gain the topics of added matches. In stories that lost a match, topics no article
    supports are unlinked, and a story no topic supports is closed; its unmatched articles, and
    scored articles that lost their last topic, are released.
    """
    gained = attach_topics(story_items, diff.filter("change = 'add'"))
    dropped_items = diff.filter("change = 'drop'").select("item_id").distinct()
    touched = story_items.join(dropped_items, "item_id", "left_semi").select("story_id").distinct()
    supported = attach_topics(story_items.join(touched, "story_id", "left_semi"), scores_after)
    tagged = story_topics.unionByName(gained).distinct()
    unsupported = tagged.join(touched, "story_id", "left_semi").join(supported, ["story_id", "topic_id"], "left_anti")
    topics_after = tagged.join(unsupported, ["story_id", "topic_id"], "left_anti")
    closed = touched.join(supported.select("story_id"), "story_id", "left_anti")
    stories_after = _set_status(stories, closed, "story_id", "closed")
    matched = scores_after.select("item_id").distinct()
    of_closed = story_items.join(closed, "story_id", "left_semi").select("item_id")
    alone = items.filter("status = 'scored'").select("item_id").join(dropped_items, "item_id", "left_semi")
    released = of_closed.unionByName(alone).distinct().join(matched, "item_id", "left_anti")
    return topics_after, stories_after, _set_status(items, released, "item_id", "not_relevant")


def _set_status(rows: DataFrame, changed: DataFrame, key: str, status: str) -> DataFrame:
    flagged = rows.join(changed.select(key, F.lit(True).alias("_hit")).distinct(), key, "left")
    return flagged.select(*[F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in rows.columns])
