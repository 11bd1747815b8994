"""Sitemaps: entries, the child sitemaps worth reading, new entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tidings.functions import markup as mk, text as tx, urls
from tidings.operators.items import first_wins, unknown_urls
from tidings.operators.ordered import most_rows
from tidings.session import checkpointed

# Fixed value: children that list site furniture rather than publications.
FURNITURE = r"(?i)[/_-](page|event|events|person|people|author|authors|project|center|centre|collection|category|tag|taxonomy|video|videos|podcast|landing|map|gallery)s?[-_.\d]"


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, kind, pos, url, date, title) of sitemaps (sitemap, body): index children and url
    entries. An entry's date is its news date, else the date in its path, else lastmod."""
    def blocks(name: str) -> Column:
        return F.regexp_extract_all("body", F.lit(rf"(?is)<{name}>(.*?)</{name}>"), F.lit(1))

    block = F.col("block")
    url, lastmod = mk.tag_text(block, "loc"), mk.tag_text(block, "lastmod")
    children = sitemaps.select("sitemap", F.lit("child").alias("kind"), F.posexplode(blocks("sitemap")).alias("pos", "block")).select(
        "sitemap", "kind", "pos", url.alias("url"), lastmod.alias("date"), F.lit(None).cast("string").alias("title")
    )
    raw = sitemaps.select("sitemap", F.lit("entry").alias("kind"), F.posexplode(blocks("url")).alias("pos", "block")).select(
        "sitemap", "kind", "pos", url.alias("url"), lastmod.alias("lastmod"), mk.tag_text(block, "news:publication_date").alias("news"), mk.tag_text(block, "news:title").alias("title")
    )
    entries = raw.select("sitemap", "kind", "pos", "url", F.coalesce("news", urls.path_date(F.col("url"), F.col("lastmod")), "lastmod").alias("date"), "title")
    return children.unionByName(entries).filter(F.coalesce("url", F.lit("")) != "")


def picked_children(entries: DataFrame, since, most: int | None = None) -> DataFrame:
    """(sitemap, url, rank): the children of an index to read next: recent ones newest first, or, when
    none is recent, undated ones by highest page number; with ``most`` the first of them."""
    content = entries.filter((F.col("kind") == "child") & ~urls.path(F.col("url")).rlike(FURNITURE)).withColumn("at", tx.parse_date(F.col("date")))
    recent = F.coalesce(F.col("at") >= F.lit(since).cast("timestamp"), F.lit(False))
    undated = F.col("date").isNull()
    page = F.coalesce(mk.found(F.col("url"), r"(?i)(\d+)\.xml$").cast("bigint"), F.lit(0))
    usable = content.withColumn("recent", recent).filter(F.col("recent") | undated).withColumn("page", page)
    number = F.when(~F.col("recent"), F.col("page"))
    # An index file is one row, so its children fit one task.
    order = Window.partitionBy("sitemap").orderBy(F.col("recent").desc(), F.col("at").desc(), number.desc(), F.col("pos"))
    ranked = usable.withColumn("rank", F.row_number().over(order).cast("bigint"))
    first = ranked if most is None else ranked.filter(F.col("rank") <= most)
    has_recent = first.groupBy("sitemap").agg(F.max("recent").alias("any_recent"))
    return first.join(has_recent, "sitemap").filter(F.col("recent") | ~F.col("any_recent")).select("sitemap", "url", "rank")


def recent_entries(entries: DataFrame, since, undated: int | None = None) -> DataFrame:
    """Entries dated inside the window, and those of a sitemap without any date; ``undated`` takes only
    its first ones."""
    rows = entries.filter(F.col("kind") == "entry").withColumn("at", tx.parse_date(F.col("date")))
    dated = rows.filter(F.col("at") >= F.lit(since).cast("timestamp"))
    datable = rows.filter(F.col("at").isNotNull()).select("sitemap").distinct()
    plain = most_rows(rows.filter(F.col("at").isNull()).join(datable, "sitemap", "left_anti"), undated, ["sitemap"], [F.col("pos")])
    return dated.unionByName(plain).drop("at")


def collected_entries(roots: DataFrame, sitemaps: DataFrame, since) -> DataFrame:
    """(source_id, url, date, title, order, pos) over a source's sitemap and two levels of
    children. ``roots`` (source_id, sitemap, link_pattern); ``sitemaps`` (sitemap, body).

    The source's pattern, when set, is tested on the entry's path. ``order`` holds the ranks on the
    way down to the entry's sitemap.
    """
    parsed = checkpointed(sitemap_entries(sitemaps))
    is_index = parsed.filter("kind = 'child'").select("sitemap").distinct()
    leaves = parsed.filter("kind = 'entry'").join(is_index, "sitemap", "left_anti")
    nexts = picked_children(parsed, since).select("sitemap", F.col("url").alias("child"), "rank")
    level = roots.select("source_id", "sitemap", "link_pattern", F.array().cast("array<bigint>").alias("order"))
    reached = level
    for _ in range(2):
        level = level.join(nexts, "sitemap").select("source_id", F.col("child").alias("sitemap"), "link_pattern", F.array_append("order", F.col("rank")).alias("order"))
        reached = reached.unionByName(level)
    wanted = F.col("link_pattern").isNull() | F.regexp_like(urls.path(F.col("url")), F.coalesce("link_pattern", F.lit("")))
    fitting = reached.join(leaves, "sitemap").filter(wanted)
    windowed = recent_entries(fitting.select(F.struct("source_id", "order", "sitemap").alias("sitemap"), "kind", "pos", "url", "date", "title"), since)
    return windowed.select("sitemap.source_id", "url", "date", "title", F.col("sitemap.order").alias("order"), "pos")


def recent_count(entries: DataFrame) -> DataFrame:
    """(source_id, recent): distinct urls among collected entries."""
    return entries.groupBy("source_id").agg(F.countDistinct("url").alias("recent"))


def new_entries(entries: DataFrame, stored: DataFrame, pages: DataFrame, most: int | None = None) -> DataFrame:
    """(source_id, url, title, standfirst, published) of entries not stored yet.

    A url listed twice keeps its first place and its last values. An entry without a title takes
    title, summary and missing date from its page; without a readable page it is left out.
    """
    place = F.struct("order", "pos")
    single = entries.groupBy("source_id", "url").agg(F.min(place).alias("place"), F.max_by(F.struct("date", "title"), place).alias("v")).select("source_id", "url", "place", "v.*")
    fresh = most_rows(unknown_urls(single, stored), most, ["source_id"], [F.col("place")])
    page = first_wins(pages, ["url"], F.col("title")).select("url", F.col("title").alias("page_title"), F.col("description").alias("page_description"), F.col("published").alias("page_published"))
    joined = fresh.join(page, "url", "left")
    own = F.coalesce("title", F.lit("")) != ""
    return joined.filter(own | F.col("page_title").isNotNull()).select(
        "source_id",
        "url",
        F.when(own, F.col("title")).otherwise(tx.clean_title(F.col("page_title"))).alias("title"),
        F.when(~own, F.col("page_description")).alias("standfirst"),
        F.when(own, F.col("date")).otherwise(F.coalesce("date", "page_published")).alias("published"),
    )
