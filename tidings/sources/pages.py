"""Web pages: metadata, readable text, listing links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from tidings.functions import markup as mk, text as tx, urls
from tidings.operators.items import unknown_urls
from tidings.operators.ordered import most_rows


def page_metadata(pages: DataFrame) -> DataFrame:
    """(url, title, description, published) of pages (url, html)."""
    html = F.col("html")
    return pages.select("url", mk.page_title(html).alias("title"), mk.page_description(html).alias("description"), mk.page_published(html).alias("published"))


def extracted_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(item_id, text, language, text_hash) from items (item_id, url, title, language, paywalled)
    and pages; paywalled items keep their metadata only, a missing page gives a null text."""
    joined = items.join(pages.select("url", "html"), "url", "left")
    text = F.when(~F.col("paywalled"), mk.page_text(F.col("html")))
    rows = joined.select("item_id", "title", "language", "paywalled", text.alias("text"))
    language = F.when(F.col("paywalled"), F.col("language")).otherwise(F.coalesce("language", tx.detect_language(F.coalesce("text", "title"), "en")))
    return rows.select("item_id", "text", language.alias("language"), tx.content_hash(F.col("text")).alias("text_hash"))


def listing_links(listings: DataFrame, most: int | None = None) -> DataFrame:
    """(source_id, rank, url, text) of listing pages (source_id, url, html, link_pattern).

    Links of the same host whose path fits the source's pattern, in page order; of repeated links
    the longest text counts.
    """
    base = F.col("url")
    links = listings.select("source_id", base.alias("base"), "link_pattern", F.posexplode(mk.page_links(F.col("html"), base)).alias("pos", "link"))
    link = F.col("link.url")
    fitting = links.filter((urls.authority(link) == urls.authority(F.col("base"))) & F.regexp_like(urls.path(link), F.col("link_pattern")))
    longest = F.struct(F.char_length("link.text").alias("n"), (-F.col("pos")).alias("p"))
    single = fitting.groupBy("source_id", link.alias("url")).agg(F.min("pos").alias("pos"), F.max_by(F.col("link.text"), longest).alias("text"))
    # A page is one row, so its links fit one task.
    ranked = single.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("pos")).cast("bigint"))
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("source_id", "rank", "url", "text")


def listing_items(links: DataFrame, stored: DataFrame, pages: DataFrame, most: int | None = None, min_text: int = 10) -> DataFrame:
    """(source_id, url, title, standfirst, published) of listed links not stored yet; the page adds
    summary and date, and the title when the link text is too short."""
    fresh = most_rows(unknown_urls(links.withColumnRenamed("rank", "place"), stored), most, ["source_id"], [F.col("place")])
    joined = fresh.join(pages.select("url", F.col("title").alias("page_title"), "description", "published"), "url", "left")
    title = F.when(F.char_length("text") >= min_text, F.col("text")).otherwise(tx.clean_title(F.col("page_title")))
    summary = F.when(F.col("description") != F.coalesce("page_title", F.lit("")), F.col("description"))
    return joined.select("source_id", "url", title.alias("title"), summary.alias("standfirst"), "published").filter(F.coalesce("title", F.lit("")) != "")

