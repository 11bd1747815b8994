"""The daily brief as data: sections, topic lines, headline, references, and the live view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidings.functions import scoring, urls
from tidings.operators.ordered import newest_rows, running_totals, top_rows

# The texts of an edition.
EMPTY_HEADLINE = "Son 24 saatte takip ettiğin konularda yeni bir gelişme yok."
LIVE_HEADLINE = "Son 24 saatte {} gelişme."
DEFAULT_NOTE = "No new evidence was linked to this edition yet."
BANNED_PATTERNS = (
    ("—|–", "em/en dash"),
    ("(?iu)günümüzün hızla değişen dünyasında", "hype filler opener"),
    ("(?iu)içinde bulunduğumuz çağda", "hype filler opener"),
    ("(?iu)büyük önem taşımaktadır", "hype phrase"),
)


def day_of(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def brief_stories(stories: DataFrame, story_items: DataFrame) -> DataFrame:
    """Open, tiered stories with their item count, on the day of their last update."""
    counts = story_items.groupBy("story_id").agg(F.count("*").alias("source_count"))
    live = stories.filter((F.col("status") == "open") & F.col("tier").isNotNull())
    return live.join(counts, "story_id", "left").select(
        day_of(F.col("last_updated_at")).alias("day"), "story_id", "title", F.coalesce("summary", F.lit("")).alias("summary"), "tier",
        F.coalesce("source_count", F.lit(0)).alias("source_count"), "last_updated_at",
    )


def brief_sections(ranked: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(day, section, position, story_id, title, summary): each section's stories with most items
    first, numbered through the edition from 0. ``caps`` names the most stories a section takes."""
    section = scoring.lookup(F.col("tier"), scoring.SECTION_BY_TIER)
    placed = ranked.withColumn("section", section).filter(F.col("section").isNotNull())
    if caps is not None:
        widest = top_rows(placed, max(caps.values()), ["day", "section"], [F.col("source_count").desc(), F.col("story_id")])
        placed = widest.filter(F.col("rank") <= scoring.lookup(F.col("section"), caps, 0))
    order = scoring.lookup(F.col("section"), scoring.SECTION_ORDER)
    keyed = placed.select("day", "section", "story_id", "title", "summary", order.alias("_section"), (-F.col("source_count")).alias("_fewer"))
    numbered = running_totals(keyed, ["day"], ["_section", "_fewer", "story_id"], {"_n": F.lit(1).cast("bigint")})
    return numbered.select("day", "section", (F.col("_n") - 1).alias("position"), "story_id", "title", "summary")


def topic_counts(ranked: DataFrame, story_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(day, topic, stories) of an edition."""
    named = ranked.join(story_topics, "story_id").join(topics.select("topic_id", F.col("name").alias("topic")), "topic_id")
    return named.groupBy("day", "topic").agg(F.count("*").alias("stories"))


def topic_lines(ranked: DataFrame, story_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(day, line, topic, story_id, title, events): one line per topic and day.

    Topics with most events come first, then those whose best story ranks earlier, then by name.
    Each takes its best story that no earlier line shows, else its best one. The n-th topic can be
    refused at most n-1 stories, so only its first n ranked stories reach the ordered pass: a day
    has at most topics squared rows there, however many events it has.
    """
    named = ranked.join(story_topics, "story_id").join(topics.select("topic_id", F.col("name").alias("topic")), "topic_id")
    rank = F.struct("tier", (-F.col("source_count")).alias("c"), "story_id")
    order = named.groupBy("day", "topic").agg(F.count("*").alias("events"), F.min(rank).alias("best"))
    by_busy = Window.partitionBy("day").orderBy(F.col("events").desc(), "best", "topic")
    order = order.withColumn("line", F.row_number().over(by_busy).cast("bigint")).drop("best")
    first = top_rows(named, max(1, topics.count()), ["day", "topic"], [F.col("tier"), F.col("source_count").desc(), F.col("story_id")])
    numbered = first.join(order, ["day", "topic"])
    needed = numbered.filter(F.col("rank") <= F.col("line")).select("day", "line", "topic", "events", "rank", "story_id", "title")

    def pick(day: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for line, options in day.sort_values(["line", "rank"]).groupby("line", sort=True):
            free = options[~options["story_id"].isin(used)]
            chosen = (free if len(free) else options).iloc[0]
            used.add(chosen["story_id"])
            rows.append((chosen["day"], line, chosen["topic"], chosen["story_id"], chosen["title"], chosen["events"]))
        return pd.DataFrame(rows, columns=["day", "line", "topic", "story_id", "title", "events"])

    return needed.groupBy("day").applyInPandas(pick, "day string, line bigint, topic string, story_id bigint, title string, events bigint")


def headlines(days: DataFrame, lines: DataFrame) -> DataFrame:
    """(day, headline): the first three topic lines, or the fixed text for a day without any."""
    text = F.concat("topic", F.lit(": "), "title")
    first = lines.filter(F.col("line") <= 3).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))).alias("l"))
    return days.join(first, "day", "left").select("day", F.coalesce(F.array_join(F.col("l.t"), " · "), F.lit(EMPTY_HEADLINE)).alias("headline"))


def unused_research(research: DataFrame, shown: DataFrame, newest: int | None = None, most: int | None = None) -> DataFrame:
    """Summarised research not shown before. ``newest`` looks only at so many of the newest, before
    the shown ones are left out; ``most`` takes the newest of what is left."""
    order = [F.col("created_at").desc(), F.col("item_id")]
    recent = newest_rows(research.filter(F.col("argument").isNotNull()), newest, order)
    return newest_rows(recent.join(shown.select("item_id"), "item_id", "left_anti"), most, order)


def watch_feed(watch_items: DataFrame, items: DataFrame, newest: int | None = None, since=None) -> DataFrame:
    """(watch_id, item_id, title, url, source, created_at): watch items with their publication, or the
    host of the link; with ``newest`` the newest that still exist."""
    rows = watch_items if since is None else watch_items.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    known = rows.join(items.select("item_id", "title", "url", "source_id"), "item_id")
    return newest_rows(known, newest, [F.col("created_at").desc(), F.col("item_id"), F.col("watch_id")]).select(
        "watch_id", "item_id", "title", "url", F.coalesce("source_id", urls.host_label(F.col("url"))).alias("source"), "created_at"
    )


def content_refs(research: DataFrame, watched: DataFrame) -> DataFrame:
    """(content_type, ref_id) of everything an edition shows besides stories."""
    return research.select(F.lit("research_item").alias("content_type"), F.col("item_id").alias("ref_id")).unionByName(
        watched.select(F.lit("watchlist_item").alias("content_type"), F.col("item_id").alias("ref_id"))
    )


def brief_documents(sections: DataFrame, lines: DataFrame, counts: DataFrame, heads: DataFrame, existing: DataFrame) -> DataFrame:
    """(day, content): one JSON document per day that has no edition yet, as long as the day's
    sections; cap those for a short one."""
    parts = sections.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("position", "section", "story_id", "title", "summary"))).alias("stories"))
    shown = lines.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("line", "topic", "story_id", "title", "events"))).alias("topicLines"))
    per_topic = counts.groupBy("day").agg(F.array_sort(F.collect_list(F.struct((-F.col("stories")).alias("order"), "topic", "stories"))).alias("topicCounts"))
    content = F.to_json(F.struct("headline", "topicLines", F.col("stories").alias("sections"), F.transform("topicCounts", lambda c: F.struct(c["topic"].alias("name"), c["stories"].alias("stories"))).alias("topicCounts")))
    fresh = heads.join(existing.select("day"), "day", "left_anti")
    return fresh.join(parts, "day", "left").join(shown, "day", "left").join(per_topic, "day", "left").select("day", content.alias("content"))


def write_briefs(documents: DataFrame, path: str) -> None:
    """Write editions by day. Only the days of this run are replaced, each in one commit, so a
    repeated or broken run leaves one edition per day."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def validate_briefs(headline: DataFrame, references: DataFrame, story_ids: DataFrame, research_ids: DataFrame) -> DataFrame:
    """(day, error) for every fault of an edition: banned wording in the headline, ids that do not
    exist (research ids for the research section), ids used twice."""
    wording = F.array_compact(F.array(*[F.when(F.col("headline").rlike(p), F.lit(f"headline contains banned pattern: {r}")) for p, r in BANNED_PATTERNS]))
    banned = headline.select("day", F.explode(wording).alias("error"))
    is_research = F.col("section") == "new_research"
    valid = story_ids.select(F.lit(False).alias("research"), F.col("story_id").alias("ref_id")).unionByName(research_ids.select(F.lit(True).alias("research"), F.col("item_id").alias("ref_id")))
    unknown = references.withColumn("research", is_research).join(valid, ["research", "ref_id"], "left_anti").select(
        "day", F.concat(F.lit('section "'), "section", F.lit('" references unknown id '), F.col("ref_id").cast("string")).alias("error")
    )
    repeats = references.groupBy("day", "ref_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = repeats.select("day", F.explode(F.array_repeat(F.concat(F.lit("id "), F.col("ref_id").cast("string"), F.lit(" appears in more than one section")), (F.col("n") - 1).cast("int"))).alias("error"))
    return banned.unionByName(unknown).unionByName(repeated)


def live_stories(stories: DataFrame, counts: DataFrame, as_of, hours: int = 24, newest: int | None = None) -> DataFrame:
    """Open, tiered, summarised stories of the last day in page order, with distinct sources."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours")
    ready = stories.filter((F.col("status") == "open") & F.col("tier").isNotNull() & F.col("summary").isNotNull() & (F.col("last_updated_at") >= since))
    recent = newest_rows(ready, newest, [F.col("last_updated_at").desc(), F.col("story_id")])
    n = F.coalesce("sources", F.lit(0))
    return recent.join(counts, "story_id", "left").withColumn("sources", n).orderBy("tier", F.col("sources").desc(), "story_id")


def last_two_runs(runs: DataFrame, stage: str) -> DataFrame:
    """(last_updated_at, fresh_since): the last two finished runs of a stage; null when missing."""
    recent = runs.filter((F.col("stage") == stage) & F.col("finished_at").isNotNull()).select("finished_at", "run_id").orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(2)
    times = F.reverse(F.array_sort(F.collect_list("finished_at")))
    return recent.agg(times.alias("t")).select(F.try_element_at("t", F.lit(1)).alias("last_updated_at"), F.try_element_at("t", F.lit(2)).alias("fresh_since"))


def story_freshness(stories: DataFrame, runs: DataFrame, stage: str) -> DataFrame:
    """(story_id, label) against the run before the latest."""
    since = last_two_runs(runs, stage).select("fresh_since")
    label = scoring.freshness(F.col("first_seen_at"), F.col("last_updated_at"), F.col("fresh_since"))
    return stories.join(F.broadcast(since)).select("story_id", label.alias("label"))


def saved_flags(rows: DataFrame, reading_list: DataFrame, key: str) -> DataFrame:
    """``rows`` with a ``saved`` flag for ids on the reading list."""
    saved = reading_list.filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("_saved")).distinct()
    return rows.join(saved, key, "left").select(*rows.columns, F.coalesce("_saved", F.lit(False)).alias("saved"))


def brief_by_edition(sections: DataFrame, stories: DataFrame, story_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(day, position, section, story_id, title, tier, topics): an edition as saved."""
    names = story_topics.join(topics.select("topic_id", "name"), "topic_id").groupBy("story_id").agg(F.array_sort(F.collect_set("name")).alias("topics"))
    return sections.select("day", "position", "section", "story_id").join(stories.select("story_id", "title", "tier"), "story_id").join(names, "story_id", "left").select(
        "day", "position", "section", "story_id", "title", "tier", F.coalesce("topics", F.array().cast("array<string>")).alias("topics")
    )


def latest_brief(briefs: DataFrame, live: DataFrame, today: str) -> DataFrame:
    """(period_date, headline): the live page's date and headline; the edition's own headline only
    when it is today's."""
    last = briefs.agg(F.max_by(F.struct("day", "headline"), "day").alias("b"))
    count = live.agg(F.count("*").alias("n"))
    before, after = LIVE_HEADLINE.split("{}")
    fallback = F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after))
    return last.join(F.broadcast(count)).select(F.lit(today).alias("period_date"), F.when(F.col("b.day") == today, F.col("b.headline")).otherwise(fallback).alias("headline"))


def brief_history(briefs: DataFrame) -> DataFrame:
    """(briefs, sent, latest_day, latest_status)."""
    return briefs.agg(F.count("*").alias("briefs"), F.count_if(F.col("status") == "sent").alias("sent"), F.max("day").alias("latest_day"), F.max_by("status", "day").alias("latest_status"))


def reading_list_feed(reading_list: DataFrame, stories: DataFrame, items: DataFrame) -> DataFrame:
    """(entry_id, title, href, is_read, created_at), newest first."""
    s = stories.select("story_id", F.col("title").alias("story_title"))
    i = items.select("item_id", F.col("title").alias("item_title"), "url")
    return (
        reading_list.join(s, "story_id", "left")
        .join(i, "item_id", "left")
        .select(
            "entry_id",
            F.coalesce("story_title", "item_title", F.lit("(untitled)")).alias("title"),
            F.when(F.col("story_title").isNotNull(), F.concat(F.lit("/story/"), F.col("story_id").cast("string"))).otherwise(F.coalesce("url", F.lit("#"))).alias("href"),
            "is_read",
            "created_at",
        )
        .orderBy(F.col("created_at").desc(), "entry_id")
    )


def reading_list_markdown(reading_list: DataFrame, stories: DataFrame, items: DataFrame) -> DataFrame:
    """(entry_id, created_at, block): one Markdown block per saved row, with its tags and notes."""
    s = stories.select("story_id", F.col("title").alias("story_title"), "summary")
    i = items.select("item_id", F.col("title").alias("item_title"), "url")
    joined = reading_list.join(s, "story_id", "left").join(i, "item_id", "left")
    title = F.coalesce("story_title", "item_title", F.lit("(untitled)"))
    lines = [
        F.concat(F.lit("## "), title),
        F.col("url"),
        F.concat(F.lit("\n"), F.col("summary")),
        F.when(F.size("tags") > 0, F.concat(F.lit("\nEtiketler: "), F.array_join("tags", ", "))),
        F.concat(F.lit("\nNot: "), F.col("notes")),
        F.concat(F.lit("\n"), F.when(F.col("is_read"), F.lit("Okundu")).otherwise(F.lit("Okunmadı"))),
        F.lit("\n---\n"),
    ]
    return joined.select("entry_id", "created_at", F.concat_ws("\n", *lines).alias("block"))


def write_reading_list(blocks: DataFrame, path: str) -> None:
    """Write the list newest first; the text files read in name order make one document."""
    blocks.repartitionByRange(F.col("created_at").desc(), "entry_id").sortWithinPartitions(F.col("created_at").desc(), "entry_id").select("block").write.mode("overwrite").text(path)
