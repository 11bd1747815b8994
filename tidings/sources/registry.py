"""The source registry, followed watches and suggested sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.functions import urls
from tidings.operators.items import first_wins, insert_absent
from tidings.operators.ordered import most_rows, newest_rows

_CONTENT = ["type", "url_or_query", "language", "perspective_group", "paywalled", "link_pattern"]


def seed_registry(seed: DataFrame, registry: DataFrame) -> DataFrame:
    """New registry snapshot: unknown seed rows come in with their weight, known ones get their
    content refreshed; weight and activity belong to the owner once a row exists."""
    query = F.when(F.col("type") == "api_openalex", F.col("issn")).otherwise(F.col("url"))
    fresh = seed.withColumn("url_or_query", query).select(F.col("name"), *[F.col(c).alias(f"s_{c}") for c in _CONTENT], F.col("weight").alias("s_weight"), F.lit(True).alias("seeded"))
    joined = registry.withColumn("held", F.lit(True)).join(fresh, "name", "full_outer")
    content = [F.when(F.col("seeded"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in _CONTENT]
    return joined.select("name", *content, F.when(F.col("held"), F.col("weight")).otherwise(F.col("s_weight")).alias("weight"), F.when(F.col("held"), F.col("active")).otherwise(F.lit(True)).alias("active"))


def seed_gaps(seed: DataFrame) -> DataFrame:
    """(missing_url, missing_issn) counts of seed rows that cannot be fetched."""
    return seed.agg(
        F.count_if((F.col("type") == "rss") & (F.coalesce("url", F.lit("")) == "")).alias("missing_url"),
        F.count_if((F.col("type") == "api_openalex") & (F.coalesce("issn", F.lit("")) == "")).alias("missing_issn"),
    )


def watch_queries(watches: DataFrame) -> DataFrame:
    """(watch_id, query): the query kept in the identifiers, else the watch's name."""
    return watches.filter("active").select("watch_id", F.coalesce(F.get_json_object("identifiers", "$.query"), "name").alias("query"))


def watch_arrivals(results: DataFrame, items: DataFrame, per_watch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(new items, links) of watch results (watch_id, pos, url, title) against items
    (item_id, canonical_url). A link is (watch_id, canonical_url)."""
    taken = most_rows(results, per_watch, ["watch_id"], [F.col("pos")])
    usable = taken.withColumn("canonical_url", urls.canonical_url(F.col("url"))).filter(F.col("canonical_url").isNotNull())
    single = first_wins(usable.select("canonical_url", "watch_id", "pos", "url", "title"), ["canonical_url"], F.struct("watch_id", "pos"))
    fresh = single.join(items.select("canonical_url"), "canonical_url", "left_anti").select("canonical_url", "url", "title", F.lit("new").alias("status"))
    return fresh, usable.select("watch_id", "canonical_url").distinct()


def fresh_suggestions(suggestions: DataFrame, sources: DataFrame, decided: DataFrame, most: int | None = None) -> DataFrame:
    """Suggested sources (topic_id, pos, name, homepage) not followed by name or host; a name already
    suggested for the topic keeps its earlier row. ``most`` takes the first of each topic only."""
    hosted = suggestions.withColumn("host", urls.host_key(F.col("homepage"))).filter(F.col("host").isNotNull()).withColumn("_lower", F.lower("name"))
    names = sources.select(F.lower("name").alias("_lower"))
    hosts = sources.select(urls.host_key(F.col("url_or_query")).alias("host")).filter("host is not null")
    unknown = hosted.join(names, "_lower", "left_anti").join(hosts, "host", "left_anti").drop("_lower")
    first = most_rows(unknown, most, ["topic_id"], [F.col("pos")])
    return insert_absent(decided, first_wins(first, ["topic_id", "name"], F.col("pos")), ["topic_id", "name"])


def topics_due(topics: DataFrame, most: int | None = None) -> DataFrame:
    """Active topics without suggestions; with ``most`` the newest of them."""
    due = topics.filter(F.col("active") & F.col("sources_suggested_at").isNull())
    return newest_rows(due, most, [F.col("created_at").desc(), F.col("topic_id")])
