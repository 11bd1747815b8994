"""Grouping matched items into stories, and ranking the stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from tidings.functions import scoring, text as tx
from tidings.operators.items import first_wins
from tidings.operators.ordered import most_rows, running_totals, top_rows


def primary_topic(item_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(item_id, topic_id): each item's topic of best priority, the lower id among equals."""
    rank = F.coalesce(scoring.lookup(F.col("priority"), scoring.PRIORITY_RANK), F.lit(1))
    known = item_topics.join(topics.select("topic_id", "priority"), "topic_id")
    return known.groupBy("item_id").agg(F.min(F.struct(rank.alias("r"), "topic_id"))["topic_id"].alias("topic_id"))


def orphan_items(scored: DataFrame, item_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """Matched items whose topics are all gone."""
    alive = item_topics.join(topics.select("topic_id"), "topic_id", "left_semi")
    return scored.join(alive.select("item_id"), "item_id", "left_anti")


def recent_events(story_topics: DataFrame, stories: DataFrame, as_of, window_hours: int = 48, most: int | None = None) -> DataFrame:
    """(topic_id, idx, story_id, title): the open stories of a topic touched in the window, newest
    first, numbered from 0; with ``most`` the first of them."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {window_hours} hours")
    live = stories.filter((F.col("status") == "open") & (F.col("last_updated_at") >= since))
    joined = story_topics.join(live.select("story_id", "title", "last_updated_at"), "story_id")
    taken = most_rows(joined, most, ["topic_id"], [F.col("last_updated_at").desc(), F.col("story_id")])
    aged = taken.select("topic_id", "story_id", "title", "last_updated_at", (-F.unix_micros("last_updated_at")).alias("_age"))
    numbered = running_totals(aged, ["topic_id"], ["_age", "story_id"], {"_n": F.lit(1).cast("bigint")})
    return numbered.select("topic_id", (F.col("_n") - 1).alias("idx"), "story_id", "title", "last_updated_at")


def sample_titles(story_items: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """(story_id, titles): up to ``n`` item titles of a story."""
    joined = story_items.join(items.select("item_id", "title"), "item_id")
    few = top_rows(joined, n, ["story_id"], [F.col("item_id")])
    return few.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("titles"))


def resolve_grouping(batch: DataFrame, events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Turn grouping answers into story membership: every item of a batch ends in one story.

    ``batch`` (batch_no, idx, item_id, title, standfirst); ``events`` (batch_no, idx, story_id);
    ``verdicts`` (batch_no, assign array<struct<i, e>>, new_events array<struct<items, title,
    summary, tier>>). Assignments are claimed before new events, both in answer order; the first
    claim of an item counts. Unknown indexes are dropped and unclaimed items become stories of
    their own. Returns (item_id, batch_no, story_id, new_no, title, summary, tier): ``story_id``
    for attached items, ``new_no`` and the story's fields for new ones.
    """
    assign = verdicts.select("batch_no", F.posexplode("assign").alias("at", "a")).select("batch_no", "at", F.col("a.i").alias("idx"), F.col("a.e").alias("e"))
    attach = assign.join(events.select("batch_no", F.col("idx").alias("e"), "story_id"), ["batch_no", "e"]).select(
        "batch_no", "idx", F.struct(F.lit(0).alias("kind"), F.col("at").alias("at"), F.lit(0).alias("pos")).alias("claim"), "story_id", F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("bigint").alias("tier"),
    )
    fresh = verdicts.select("batch_no", F.posexplode("new_events").alias("at", "n")).select("batch_no", "at", "n.*")
    created = fresh.select("batch_no", "at", "title", "summary", F.col("tier").cast("bigint").alias("tier"), F.posexplode("items").alias("pos", "idx")).select(
        "batch_no", F.col("idx").cast("bigint").alias("idx"), F.struct(F.lit(1).alias("kind"), "at", "pos").alias("claim"), F.lit(None).cast("bigint").alias("story_id"),
        tx.dash_clean(F.col("title")).alias("title"), tx.dash_clean(F.col("summary")).alias("summary"), "tier",
    )
    claims = attach.withColumn("idx", F.col("idx").cast("bigint")).unionByName(created)
    known = claims.join(batch.select("batch_no", "idx", "item_id", F.col("title").alias("own_title")), ["batch_no", "idx"])
    best = first_wins(known, ["batch_no", "idx"], F.col("claim"))
    lead = Window.partitionBy("batch_no", "claim.kind", "claim.at").orderBy("claim.pos")
    first_title = F.first("own_title").over(lead)
    settled = best.withColumn("title", F.when(F.col("claim.kind") == 1, F.when(F.col("title") == "", first_title).otherwise(F.col("title"))))
    settled = settled.withColumn("new_no", F.when(F.col("claim.kind") == 1, F.col("claim.at").cast("bigint")))
    rest = batch.join(settled.select("batch_no", "idx"), ["batch_no", "idx"], "left_anti").select(
        "item_id", "batch_no", F.lit(None).cast("bigint").alias("story_id"), (F.col("idx") + 1_000_000).cast("bigint").alias("new_no"), "title",
        F.coalesce("standfirst", F.col("title")).alias("summary"), F.lit(3).cast("bigint").alias("tier"),
    )
    return settled.select("item_id", "batch_no", "story_id", "new_no", "title", "summary", "tier").unionByName(rest)


def grouping_writes(resolved: DataFrame, item_topics: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(new stories, story items, story topics, touched story ids) of a run's resolved batches.

    A new story's id is a digest of its smallest item, which belongs to one story only: a repeated
    run writes the same rows, and another run never the same id.
    """
    first = resolved.filter("story_id is null").groupBy("batch_no", "new_no").agg(F.min("item_id").alias("_first"))
    new_id = F.concat(F.lit("s"), F.substring(F.sha2(F.col("_first").cast("string"), 256), 1, 16))
    joined = resolved.join(first, ["batch_no", "new_no"], "left")
    named = joined.withColumn("sid", F.coalesce(F.col("story_id").cast("string"), new_id)).drop("_first")
    stories = named.filter("story_id is null").groupBy("sid").agg(F.min("title").alias("title"), F.min("summary").alias("summary"), F.min("tier").alias("tier"))
    links = named.select(F.col("sid").alias("story_id"), "item_id").distinct()
    return stories.withColumnRenamed("sid", "story_id"), links, attach_topics(links, item_topics), named.filter("story_id is not null").select("story_id").distinct()


def attach_topics(story_items: DataFrame, item_topics: DataFrame) -> DataFrame:
    """(story_id, topic_id): a story carries every topic of its items."""
    return story_items.join(item_topics.select("item_id", "topic_id"), "item_id").select("story_id", "topic_id").distinct()


def threshold_topics(story_items: DataFrame, scores: DataFrame, topics: DataFrame) -> DataFrame:
    """(story_id, topic_id) for item scores that reach the topic's threshold."""
    passed = scores.join(topics.select("topic_id", "relevance_threshold"), "topic_id").filter(F.col("score") >= F.col("relevance_threshold"))
    return attach_topics(story_items, passed)


def source_weight(story_items: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, weight): mean weight of the sources behind a story's items."""
    joined = story_items.join(items.select("item_id", "source_id"), "item_id").join(sources.select("source_id", "weight"), "source_id")
    return joined.groupBy("story_id").agg(F.avg(F.col("weight").cast("double")).alias("weight"))


def story_priority(story_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(story_id, priority): the best priority among a story's topics; an unknown one counts as low."""
    rank = F.coalesce(scoring.lookup(F.col("priority"), scoring.PRIORITY_RANK), F.lit(2))
    best = story_topics.join(topics.select("topic_id", "priority"), "topic_id").groupBy("story_id").agg(F.min(rank).alias("r"))
    return best.select("story_id", scoring.lookup(F.col("r"), {v: k for k, v in scoring.PRIORITY_RANK.items()}).alias("priority"))


def rank_stories(stories: DataFrame, verdicts: DataFrame, story_items: DataFrame, items: DataFrame, sources: DataFrame, story_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(story_id, tier, novelty, rank_score, status) for judged stories; repetitions are closed."""
    count = story_items.groupBy("story_id").agg(F.count("*").alias("item_count"))
    joined = (
        stories.select("story_id")
        .join(verdicts, "story_id")
        .join(count, "story_id")
        .join(source_weight(story_items, items, sources), "story_id", "left")
        .join(story_priority(story_topics, topics), "story_id", "left")
    )
    score = scoring.rank_score(F.col("tier"), F.col("novelty"), F.col("priority"), F.col("weight"), F.col("item_count"))
    return joined.select("story_id", "tier", "novelty", score.alias("rank_score"), F.when(F.col("novelty") == "repetition", F.lit("closed")).otherwise(F.lit("open")).alias("status"))


def story_context(story_items: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, item_id, title, language, source_name, perspective_group): what an outside writer
    is shown of a story, one row per article; '?' for an unknown source."""
    return (
        story_items.join(items.select("item_id", "title", "language", "source_id"), "item_id")
        .join(sources.select("source_id", "perspective_group"), "source_id", "left")
        .select("story_id", "item_id", "title", "language", F.coalesce("source_id", F.lit("?")).alias("source_name"), "perspective_group")
    )


def source_counts(story_items: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """(story_id, sources, perspectives): distinct sources and perspective groups."""
    joined = story_items.join(items.select("item_id", "source_id"), "item_id", "left").join(sources.select("source_id", "perspective_group"), "source_id", "left")
    return joined.groupBy("story_id").agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("perspective_group").alias("perspectives"))


def framing_gate(counts: DataFrame, framing: DataFrame) -> DataFrame:
    """(story_id, show): framing is shown when it has entries and two perspective groups report."""
    n = F.coalesce(F.size("framing"), F.lit(0))
    return counts.join(framing, "story_id", "left").select("story_id", ((F.col("perspectives") >= 2) & (n > 0)).alias("show"))


def why_matched(story_items: DataFrame, scores: DataFrame, topics: DataFrame, most: int | None = None) -> DataFrame:
    """(story_id, topic, articles, verdicts, keywords): why a story sits under each topic.

    Keywords are distinct over the story's articles, in alphabetical order; with ``most`` the first.
    """
    joined = story_items.join(scores, "item_id").join(topics.select("topic_id", "name"), "topic_id")
    counted = joined.groupBy("story_id", F.col("name").alias("topic")).agg(
        F.count("*").alias("articles"), F.count_if(F.startswith("reason", F.lit("ai"))).alias("verdicts")
    )
    words = joined.select("story_id", F.col("name").alias("topic"), F.explode(tx.keywords_from_reason(F.coalesce("reason", F.lit("")))).alias("word")).distinct()
    first = most_rows(words, most, ["story_id", "topic"], [F.col("word")]).groupBy("story_id", "topic").agg(F.array_sort(F.collect_list("word")).alias("keywords"))
    return counted.join(first, ["story_id", "topic"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def apply_verdicts(due: DataFrame, verdicts: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fill ``columns`` of due rows from verdict rows; returns the snapshot and (done, failed)."""
    joined = due.join(verdicts.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_seen")), key, "left")
    filled = joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in due.columns])
    return filled, joined.agg(F.count_if(F.col("_seen").isNotNull()).alias("done"), F.count_if(F.col("_seen").isNull()).alias("failed"))


def topic_timeline(story_topics: DataFrame, stories: DataFrame) -> DataFrame:
    """A topic's stories, newest first."""
    return story_topics.join(stories, "story_id").select("topic_id", "story_id", "title", "tier", "first_seen_at").orderBy("topic_id", F.col("first_seen_at").desc(), "story_id")
