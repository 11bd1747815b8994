"""Feeds, and finding a publication's feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidings.functions import markup as mk, text as tx, urls
from tidings.sources.robots import allowed_urls

CONVENTIONAL_PATHS = ("/feed/", "/rss.xml", "/rss", "/feed.xml")


def rss_items(feeds: DataFrame) -> DataFrame:
    """(source_id, pos, url, title, standfirst, author, published_at) of feeds (source_id, body).

    RSS items and Atom entries; entries without a link or title are left out. The summary is the
    plain text of the description or content, else the summary element.
    """
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = feeds.select("source_id", F.posexplode(blocks).alias("pos", "block"))
    block = F.col("block")
    link = F.coalesce(
        F.nullif(mk.tag_text(block, "link"), F.lit("")),
        tx.decode_entities(mk.found(block, r"(?i)<link(?=[^>]*rel=[\"']alternate)[^>]*href=[\"']([^\"']+)[\"']")),
        tx.decode_entities(mk.found(block, r"(?i)<link[^>]*href=[\"']([^\"']+)[\"']")),
    )
    snippet = tx.one_space(tx.decode_entities(mk.strip_tags(F.coalesce(mk.tag_text(block, "description"), mk.tag_text(block, "content")))))
    author = mk.found(block, r"(?is)<author(?:\s[^>]*)?>(.*?)</author>")
    parsed = rows.select(
        "source_id",
        F.col("pos").cast("bigint").alias("pos"),
        link.alias("url"),
        tx.one_space(mk.tag_text(block, "title")).alias("title"),
        F.coalesce(snippet, tx.one_space(mk.tag_text(block, "summary"))).alias("standfirst"),
        F.coalesce(mk.tag_text(block, "dc:creator"), mk.tag_text(author, "name"), tx.decode_entities(author)).alias("author"),
        tx.parse_date(F.coalesce(*[mk.tag_text(block, t) for t in ("pubDate", "published", "updated", "dc:date")])).alias("published_at"),
    )
    return parsed.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def feed_links(pages: DataFrame) -> DataFrame:
    """(url, pos, feed_url) of the feeds that pages (url, html) advertise."""
    return pages.select("url", F.posexplode(mk.feed_link_list(F.col("html"), F.col("url"))).alias("pos", "feed_url"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, pos, sitemap_url) of robots files (host, body), news sitemaps first."""
    return robots.select("host", F.posexplode(mk.robots_sitemap_list(F.col("body"))).alias("pos", "sitemap_url"))


def discover_sources(homepages: DataFrame, feed_entries: DataFrame, robots: DataFrame, sitemap_counts: DataFrame, as_of, fresh_days: int = 14, candidates: int | None = None) -> DataFrame:
    """(homepage, status, source_type, feed_url, recent_items) by the first candidate that works.

    ``homepages`` (homepage, html, error); ``feed_entries`` (feed_url, published_at) of the feeds
    that answered; ``robots`` (host, body); ``sitemap_counts`` (sitemap_url, recent). A fresh feed
    wins over a fresh sitemap, that over a stale feed, that over a feed robots.txt forbids.
    """
    refused = ~urls.is_public_url(F.col("homepage")) | F.coalesce(F.col("error").rlike("40[13]|429"), F.lit(False))
    pages = homepages.withColumn("refused", refused).withColumn("host", urls.authority(F.col("homepage")))
    open_pages = pages.filter(~F.col("refused"))
    advertised = mk.feed_link_list(F.coalesce("html", F.lit("")), F.col("homepage"))
    first = lambda listed: listed if candidates is None else F.slice(listed, 1, candidates)
    usual = F.transform(F.array(*[F.lit(p) for p in CONVENTIONAL_PATHS]), lambda p: urls.absolute_url(p, F.col("homepage")))
    tried = open_pages.select("homepage", F.posexplode(first(tx.let(advertised, lambda found: F.when(F.size(found) > 0, found).otherwise(usual)))).alias("pos", "url"))
    permitted = allowed_urls(tried.select("url").distinct(), robots).select("url", F.lit(True).alias("permitted"))
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {fresh_days} days")
    counts = feed_entries.groupBy(F.col("feed_url").alias("url")).agg(F.count("*").alias("entries"), F.count_if(F.col("published_at") >= since).alias("recent"))
    facts = tried.join(permitted, "url", "left").join(counts, "url", "left")
    state = (
        F.when(F.col("permitted").isNull(), F.lit("blocked"))
        .when(F.coalesce("entries", F.lit(0)) == 0, F.lit("no_feed"))
        .when(F.col("recent") > 0, F.lit("ok"))
        .otherwise(F.lit("stale"))
    )
    by_feed = facts.select("homepage", state.alias("status"), F.lit("rss").alias("source_type"), F.col("url").alias("feed_url"), F.coalesce("recent", F.lit(0)).alias("recent_items"), "pos")
    maps = open_pages.select("homepage", "host").join(robots.select("host", F.col("body").alias("robots")), "host")
    listed = maps.select("homepage", F.posexplode(first(mk.robots_sitemap_list(F.col("robots")))).alias("pos", "sitemap_url"))
    by_map = listed.join(sitemap_counts.filter("recent > 0"), "sitemap_url").select(
        "homepage", F.lit("ok").alias("status"), F.lit("sitemap").alias("source_type"), F.col("sitemap_url").alias("feed_url"), F.col("recent").alias("recent_items"), "pos"
    )
    nothing = pages.select("homepage", F.when(F.col("refused"), F.lit("blocked")).otherwise(F.lit("no_feed")).alias("status"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("feed_url"), F.lit(None).cast("bigint").alias("recent_items"), F.lit(0).alias("pos"))
    every = by_feed.unionByName(by_map).unionByName(nothing)
    rank = F.when((F.col("status") == "ok") & (F.col("source_type") == "rss"), 0).when(F.col("status") == "ok", 1).when(F.col("status") == "stale", 2).when((F.col("status") == "blocked"), 3).otherwise(4)
    usable = F.col("status").isin("ok", "stale")
    kept = lambda c: F.when(usable, F.col(c)).alias(c)
    best = every.groupBy("homepage").agg(F.min_by(F.struct("status", "source_type", "feed_url", "recent_items"), F.struct(rank.alias("r"), "pos")).alias("b")).select("homepage", "b.*")
    return best.select("homepage", "status", kept("source_type"), kept("feed_url"), kept("recent_items"))
