"""Queries over the source parsers.

Feeds, sitemaps, robots files and API answers are composed from the documents and pages tables by
Spark, so parsing work grows with them and the expected rows are known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import markup as mk, text as tx, urls
from tidings.plans.registry import query, sql_stamp, stamp
from tidings.plans.scalar_queries import CANONICAL_SQL
from tidings.plans.views import AS_OF
from tidings.sources import apis, feeds, pages as pg, registry as rg, robots as rb, sitemaps as sm


def _escaped(column):
    return F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _joined(df, key, line, order, before, after):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return df.groupBy(key).agg(F.concat(F.lit(before), lines, F.lit(after)).alias("body"))


ONE_SPACE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _feed_bodies(v):
    """One feed for ten documents; every other one is Atom."""
    rows = v.items().withColumn("feed", F.floor(F.col("item_id") / 10).cast("bigint"))
    link = F.concat(F.lit("https://"), "source_id", F.lit(".example.org/a?x=1&amp;id="), F.col("item_id").cast("string"))
    title = _escaped(F.col("title"))
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description><![CDATA[<p>About <b>"), "source_id", F.lit("</b></p>]]></description><dc:creator>"), "language",
        F.lit("</dc:creator><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    atom = F.concat(
        F.lit("<entry><title type=\"text\">"), title, F.lit("</title><link rel=\"alternate\" href=\""), link, F.lit("\"/><summary>About "), "source_id", F.lit("</summary><author><name>"), "language",
        F.lit("</name></author><published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"),
    )
    return _joined(rows, "feed", F.when(F.col("feed") % 2 == 0, rss).otherwise(atom), F.col("item_id"), "<feed><title>Site</title>\n", "</feed>").withColumnRenamed("feed", "source_id")


FEED_ITEMS = {
    "feed_items": f"""SELECT item_id // 10 AS source_id, item_id % 10 AS pos, 'https://' || source_id || '.example.org/a?x=1&id=' || item_id AS url, {ONE_SPACE.format('title')} AS title, 'About ' || source_id AS standfirst,
        language AS author, {sql_stamp('published_at')} AS published_at FROM items WHERE {ONE_SPACE.format('title')} <> ''"""
}


@query("rss_items", "SELECT * FROM feed_items", FEED_ITEMS)
def rss_items(v):
    return feeds.rss_items(_feed_bodies(v)).withColumn("published_at", stamp("published_at"))


def _sitemaps(v):
    """One sitemap for 25 documents, an index for four of them, a root for all indexes of a part."""
    rows = v.items().withColumn("part", F.floor(F.col("item_id") / 25).cast("bigint"))
    day = F.date_format("published_at", "yyyy-MM-dd")
    loc = F.concat(F.lit("https://s.example.org/"), "language", F.lit("/"), F.col("item_id").cast("string"))
    dated = F.when(F.col("part") % 5 == 4, F.lit("")).when(F.col("item_id") % 6 == 5, F.lit("")).otherwise(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")))
    news = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("<news:news><news:publication_date>"), day, F.lit("T06:00:00Z</news:publication_date><news:title><![CDATA[T "), F.col("item_id").cast("string"), F.lit("]]></news:title></news:news>")))
    entry = F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), dated, F.when(F.col("part") % 5 == 4, F.lit("")).otherwise(F.coalesce(news, F.lit(""))), F.lit("</url>"))
    leaf_name = lambda p: F.concat(F.lit("https://s.example.org/posts-"), p.cast("string"), F.lit(".xml"))
    leaves = _joined(rows, "part", entry, F.col("item_id"), "<urlset>", "</urlset>").select(leaf_name(F.col("part")).alias("sitemap"), "body")
    parts = rows.select("part").distinct().withColumn("block", F.floor(F.col("part") / 4).cast("bigint"))
    child = F.concat(F.lit("<sitemap><loc>"), leaf_name(F.col("part")), F.lit("</loc>"), F.when(F.col("block") % 2 == 0, F.lit("<lastmod>2024-01-30</lastmod>")).otherwise(F.lit("")), F.lit("</sitemap><sitemap><loc>https://s.example.org/tags-1.xml</loc></sitemap>"))
    index_name = F.concat(F.lit("https://s.example.org/index-"), F.col("block").cast("string"), F.lit(".xml"))
    indexes = _joined(parts, "block", child, F.col("part"), "<sitemapindex>", "</sitemapindex>").select(index_name.alias("sitemap"), "body")
    return leaves.unionByName(indexes)


SITEMAP_VIEWS = {
    "leaf_rows": """SELECT item_id, language, item_id // 25 AS part, item_id // 100 AS block, item_id % 25 AS pos, strftime(published_at, '%Y-%m-%d') AS day, item_id // 25 % 5 = 4 AS bare FROM items""",
    "sitemap_rows": """SELECT 'https://s.example.org/posts-' || part || '.xml' AS sitemap, 'entry' AS kind, pos, 'https://s.example.org/' || language || '/' || item_id AS url,
        CASE WHEN bare THEN NULL WHEN item_id % 3 = 0 THEN day || 'T06:00:00Z' WHEN item_id % 6 = 5 THEN NULL ELSE day END AS date, CASE WHEN NOT bare AND item_id % 3 = 0 THEN 'T ' || item_id END AS title, block, language, part, item_id FROM leaf_rows""",
    "child_rows": """SELECT 'https://s.example.org/index-' || part // 4 || '.xml' AS sitemap, 'child' AS kind, part % 4 * 2 AS pos, 'https://s.example.org/posts-' || part || '.xml' AS url, CASE WHEN part // 4 % 2 = 0 THEN '2024-01-30' END AS date, NULL AS title
        FROM (SELECT DISTINCT part FROM leaf_rows) UNION ALL SELECT 'https://s.example.org/index-' || part // 4 || '.xml', 'child', part % 4 * 2 + 1, 'https://s.example.org/tags-1.xml', NULL, NULL FROM (SELECT DISTINCT part FROM leaf_rows)""",
    "kept_rows": """SELECT block, url, date, title, part, pos FROM (SELECT *, bool_or(date IS NOT NULL) OVER (PARTITION BY part) AS datable FROM sitemap_rows WHERE language <> 'de')
        WHERE date >= '2024-01-10' OR (date IS NULL AND NOT datable)""",
}
SINCE = "2024-01-10 00:00:00"


@query("sitemap_entries", "SELECT sitemap, kind, pos, url, date, title FROM sitemap_rows UNION ALL SELECT * FROM child_rows", SITEMAP_VIEWS)
def sitemap_entries(v):
    return sm.sitemap_entries(_sitemaps(v)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "picked_children",
    "SELECT sitemap, url, row_number() OVER (PARTITION BY sitemap ORDER BY CASE WHEN date IS NULL THEN -CAST(regexp_extract(url, '([0-9]+)[.]xml', 1) AS BIGINT) ELSE pos END) AS rank FROM child_rows WHERE url NOT LIKE '%tags%'",
    SITEMAP_VIEWS,
)
def picked_children(v):
    return sm.picked_children(sm.sitemap_entries(_sitemaps(v)), SINCE)


def _collected(v):
    roots = v.items().select(F.floor(F.col("item_id") / 100).cast("bigint").alias("source_id")).distinct()
    roots = roots.select("source_id", F.concat(F.lit("https://s.example.org/index-"), F.col("source_id").cast("string"), F.lit(".xml")).alias("sitemap"), F.lit("^/(en|fr|es)/").alias("link_pattern"))
    return sm.collected_entries(roots, _sitemaps(v), SINCE)


@query("collected_entries", "SELECT block AS source_id, url, date, title FROM kept_rows", SITEMAP_VIEWS)
def collected_entries(v):
    return _collected(v).select("source_id", "url", "date", "title")


@query("recent_sitemap_counts", "SELECT block AS source_id, count(DISTINCT url) AS recent FROM kept_rows GROUP BY 1", SITEMAP_VIEWS)
def recent_sitemap_counts(v):
    return sm.recent_count(_collected(v))


@query(
    "new_sitemap_entries",
    """SELECT block AS source_id, url, CASE WHEN title IS NOT NULL THEN title ELSE 'Page of the item number ' || id END AS title, CASE WHEN title IS NULL THEN 'D' || id END AS standfirst,
    CASE WHEN title IS NOT NULL THEN date ELSE coalesce(date, '2024-01-20') END AS published FROM (
    SELECT *, row_number() OVER (PARTITION BY block ORDER BY CASE WHEN block % 2 = 0 THEN part ELSE -part END, pos) AS n FROM (SELECT *, CAST(string_split(url, '/')[5] AS BIGINT) AS id FROM kept_rows)
    WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE title IS NOT NULL OR id % 4 <> 0""",
    SITEMAP_VIEWS,
)
def new_sitemap_entries(v):
    name = F.col("item_id").cast("string")
    link = F.concat(F.lit("https://s.example.org/"), "language", F.lit("/"), name)
    stored = v.items().join(v.table("labels").filter("quality = 1").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").select(urls.canonical_url(link).alias("canonical_url"))
    html = F.concat(F.lit("<html><head><title>Page of the item number "), name, F.lit(" | Site</title><meta name=\"description\" content=\"D"), name, F.lit("\"></head><time datetime=\"2024-01-20\"></time></html>"))
    fetched = v.items().filter(F.col("item_id") % 4 != 0).select(link.alias("url"), html.alias("html"))
    return sm.new_entries(_collected(v), stored, pg.page_metadata(fetched))


@query(
    "page_metadata",
    """SELECT url, trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&')) AS title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS published FROM pages""",
)
def page_metadata(v):
    return pg.page_metadata(v.pages())


@query(
    "article_metadata",
    """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Og ' WHEN 1 THEN 'Tw ' ELSE 'Plain ' END || item_id || ' & co' AS title, CASE WHEN item_id % 2 = 0 THEN 'About ' || source_id ELSE 'Meta ' || language END AS description,
    CASE item_id % 4 WHEN 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(published_at, '%Y-%m-%d') WHEN 2 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') END AS published FROM items""",
)
def article_metadata(v):
    """Pages with every kind of title, description and date tag, one per document."""
    n, kind = F.col("item_id").cast("string"), F.col("item_id") % 3
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("<html><head><title>Plain "), n, F.lit(" &amp; co</title>"),
        F.when(kind == 0, F.concat(F.lit('<meta property="og:title" content="Og '), n, F.lit(' &amp; co">'))).when(kind == 1, F.concat(F.lit("<meta name='twitter:title' content='Tw "), n, F.lit(" &#38; co' />"))).otherwise(F.lit("")),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('<meta property="og:description" content="About '), "source_id", F.lit('">'))).otherwise(F.lit("")),
        F.lit('<meta name="description" content="Meta '), "language", F.lit('">'),
        F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('<meta property="article:published_time" content="'), iso, F.lit('">')))
        .when(F.col("item_id") % 4 == 1, F.concat(F.lit('<script type="application/ld+json">{"datePublished": "'), F.substring(iso, 1, 10), F.lit('"}</script>')))
        .when(F.col("item_id") % 4 == 2, F.concat(F.lit('</head><body><time class="x" datetime="'), iso, F.lit('">now</time>')))
        .otherwise(F.lit('<meta property="article:published_time" content="not a date">')),
    )
    made = v.items().select(n.alias("url"), head.alias("html"))
    return pg.page_metadata(made).select(F.col("url").cast("bigint").alias("item_id"), "title", "description", "published")


_BLOCK = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
PAGE_TEXT_SQL = f"""SELECT page_id, CASE WHEN t <> '' THEN t END AS text FROM (
    SELECT page_id, html_chars, array_to_string(list_filter(list_transform(list_filter(blocks, lambda b: NOT length({_BLOCK.format("regexp_replace(b, '(?is)<a\\s[^>]*>.*?</a>', ' ', 'g')")}) * 2 < length({_BLOCK.format('b')})),
    lambda b: {_BLOCK.format('b')}), lambda b: b <> ''), chr(10)) AS t FROM (
    SELECT page_id, length(html) AS html_chars, string_split(regexp_replace(CASE WHEN regexp_matches(c, '(?is)<article(?:\\s[^>]*)?>.*</article>') THEN regexp_extract(c, '(?is)<article(?:\\s[^>]*)?>(.*)</article>', 1)
    WHEN regexp_matches(c, '(?is)<main(?:\\s[^>]*)?>.*</main>') THEN regexp_extract(c, '(?is)<main(?:\\s[^>]*)?>(.*)</main>', 1)
    WHEN regexp_matches(c, '(?is)<body(?:\\s[^>]*)?>.*</body>') THEN regexp_extract(c, '(?is)<body(?:\\s[^>]*)?>(.*)</body>', 1) ELSE c END,
    '(?i)<br\\s*/?>|</(p|div|h[1-6]|li|ul|ol|table|tr|td|section|blockquote|article)>', chr(1), 'g'), chr(1)) AS blocks, html FROM (
    SELECT page_id, html, {{clean}} AS c FROM pages)))"""


def _clean_sql() -> str:
    clean = "regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
    for name in mk.FURNITURE:
        clean = f"regexp_replace({clean}, '(?is)<{name}(?:\\s[^>]*)?>.*?</{name}>', ' ', 'g')"
    return clean


@query("page_texts", f"SELECT page_id, length(text) AS chars, sha256(text) AS digest FROM ({PAGE_TEXT_SQL.format(clean=_clean_sql())})")
def page_texts(v):
    texts = v.pages().select("page_id", mk.page_text(F.col("html")).alias("text"))
    return texts.select("page_id", F.char_length("text").cast("bigint").alias("chars"), tx.content_hash(F.col("text")).alias("digest"))


@query(
    "extracted_items",
    f"""SELECT page_id AS item_id, page_id % 6 = 5 OR text IS NULL AS without_text, CASE WHEN page_id % 6 <> 5 THEN sha256(text) END AS text_hash FROM ({PAGE_TEXT_SQL.format(clean=_clean_sql())})""",
)
def extracted_items(v):
    items = v.pages().select(F.col("page_id").alias("item_id"), F.concat(F.col("page_id").cast("string"), F.lit(":"), "url").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("language"), (F.col("page_id") % 6 == 5).alias("paywalled"))
    fetched = v.pages().select(F.concat(F.col("page_id").cast("string"), F.lit(":"), "url").alias("url"), "html")
    return pg.extracted_items(items, fetched).select("item_id", F.col("text").isNull().alias("without_text"), "text_hash")


def _listings(v):
    """Listing pages of 50 documents each, linking to relative paths, other sites and sections."""
    rows = v.items().withColumn("page", F.floor(F.col("item_id") / 50).cast("bigint"))
    n = F.col("item_id").cast("string")
    line = F.concat(
        F.lit('<a class="x" href="/'), "language", F.lit("/"), n, F.lit('"><img src="i.png"></a><a href="/'), "language", F.lit("/"), n, F.lit('#top">Go</a><a href=\'/'), "language", F.lit("/"), n,
        F.lit("'> <b>»</b> Story &quot;"), n, F.lit("&quot; of "), "source_id", F.lit('</a><a href="https://other.example.net/en/'), n, F.lit('">Elsewhere</a><a href="/about">About us</a>'),
    )
    bodies = _joined(rows, "page", line, F.col("item_id"), "<html>", "</html>")
    return bodies.select(F.col("page").alias("source_id"), F.concat(F.lit("https://list"), F.col("page").cast("string"), F.lit(".example.org/news/")).alias("url"), F.col("body").alias("html"), F.lit("^/(en|fr|es|de)/[0-9]+$").alias("link_pattern"))


LIST_VIEWS = {
    "listed": "SELECT item_id // 50 AS source_id, item_id % 50 + 1 AS rank, 'https://list' || item_id // 50 || '.example.org/' || language || '/' || item_id AS url, 'Story \"' || item_id || '\" of ' || source_id AS text, item_id, language FROM items",
}


@query("listing_links", "SELECT source_id, rank, url, text FROM listed", LIST_VIEWS)
def listing_links(v):
    return pg.listing_links(_listings(v))


@query(
    "listing_items",
    """SELECT source_id, url, CASE WHEN item_id % 5 = 0 THEN 'A longer title of the page ' || item_id ELSE text END AS title, CASE WHEN item_id % 3 <> 0 THEN 'D' || item_id END AS standfirst, '2024-01-20' AS published FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS n FROM listed WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1))""",
    LIST_VIEWS,
)
def listing_items(v):
    n = F.col("item_id").cast("string")
    link = F.concat(F.lit("https://list"), F.floor(F.col("item_id") / 50).cast("string"), F.lit(".example.org/"), "language", F.lit("/"), n)
    links = pg.listing_links(_listings(v))
    number = F.regexp_extract("url", r"/(\d+)$", 1).cast("bigint")
    links = links.withColumn("text", F.when(number % 5 == 0, F.lit("more")).otherwise(F.col("text")))
    stored = v.items().join(v.table("labels").filter("quality = 1").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").select(link.alias("canonical_url"))
    title = F.concat(F.lit("A longer title of the page "), n)
    head = F.concat(F.lit("<title>"), title, F.lit(" | Site</title><meta name=\"description\" content=\""), F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("D"), n)).otherwise(F.concat(title, F.lit(" | Site"))), F.lit("\"><time datetime=\"2024-01-20\">"))
    return pg.listing_items(links, stored, pg.page_metadata(v.items().select(link.alias("url"), head.alias("html"))))


@query(
    "page_links",
    """SELECT page_id, pos, 'http' || CASE WHEN url LIKE 'https%' THEN 's' ELSE '' END || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || array_to_string(list_transform(string_split(split_part(href, '?', 1), '/'), lambda s: replace(url_encode(s), '%2C', ',')), '/') || CASE WHEN contains(href, '?') THEN '?' || split_part(href, '?', 2) ELSE '' END AS link_url FROM (
    SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, url, list_filter(list_transform(
    regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), lambda x: split_part(x, '#', 1)), lambda x: x <> '') AS h FROM pages)) WHERE href LIKE '/%'""",
)
def page_links(v):
    rows = v.pages().select("page_id", F.posexplode(mk.page_links(F.col("html"), F.col("url"))).alias("pos", "link"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), F.col("link.url").alias("link_url"))


# --- robots and discovery --------------------------------------------------------------------


def _hosts(v):
    return v.pages().select(urls.host(F.col("url")).alias("host")).distinct()


def _robots(v):
    """A robots file per host: a named crawler, the generic group in two shapes, a second crawler."""
    body = F.concat(
        F.lit("User-agent: OneBot\nDisallow: /\n\n"),
        F.when(F.char_length("host") % 2 == 0, F.lit("User-Agent: TwoBot\nUser-agent: *\r\n")).otherwise(F.lit("user-agent: *  # all\n")),
        F.lit("Disallow: /fr/\nDisallow: /*.html$ # pages\nDisallow:\nAllow: /x\nDisallow: /en/4\n\nUser-agent: ThreeBot\nDisallow: /es/\n"),
        F.lit("Sitemap: https://"), "host", F.lit("/sitemap.xml\nsitemap: https://"), "host", F.lit("/news-sitemap.xml\nSitemap: https://"), "host", F.lit("/sitemap.xml\n"),
    )
    return _hosts(v).select("host", body.alias("body"))


HOST_VIEWS = {"hosts": "SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages"}


@query("robots_rules", "SELECT host, unnest([0, 1, 2])::BIGINT AS pos, unnest(['/fr/', '/*.html$', '/en/4']) AS rule FROM hosts", HOST_VIEWS)
def robots_rules(v):
    return rb.robots_disallows(_robots(v)).withColumn("pos", F.col("pos").cast("bigint"))


@query("robots_sitemaps", "SELECT host, unnest([0, 1])::BIGINT AS pos, unnest(['https://' || host || '/news-sitemap.xml', 'https://' || host || '/sitemap.xml']) AS sitemap_url FROM hosts", HOST_VIEWS)
def robots_sitemaps(v):
    return feeds.robots_sitemaps(_robots(v)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "allowed_urls",
    """SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS p FROM pages) WHERE NOT (p LIKE '/fr/%' OR regexp_matches(p, '^/.*[.]html$') OR p LIKE '/en/4%')""",
)
def allowed_urls(v):
    return rb.allowed_urls(v.pages().select("page_id", "url"), _robots(v)).select("page_id")


@query(
    "feed_links",
    """SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN [0] ELSE [0, 1] END)::BIGINT AS pos, unnest(CASE WHEN page_id % 3 = 0 THEN [o || '/rss?a=1&b=2'] ELSE ['https://x.example.org/atom.xml', o || '/rss?a=1&b=2'] END) AS feed_url
    FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS o FROM pages)""",
)
def feed_links(v):
    made = _with_feed_links(v.pages())
    return made.select("page_id", F.posexplode(mk.feed_link_list(F.col("html"), F.col("url"))).alias("pos", "feed_url")).withColumn("pos", F.col("pos").cast("bigint"))


def _with_feed_links(pages):
    links = F.concat(
        F.lit('<link rel="stylesheet" href="/s.css"><link rel="alternate" type="application/rss+xml" href="/comments/feed/">'),
        F.when(F.col("page_id") % 3 != 0, F.lit('<link href="https://x.example.org/atom.xml" type="application/atom+xml" rel="alternate">')).otherwise(F.lit("")),
        F.lit("<link type='application/rss+xml' rel='alternate' href='/rss?a=1&amp;b=2'>"),
        F.lit('<link type="application/rss+xml" rel="alternate" href="/rss?a=1&amp;b=2">'),
    )
    return pages.withColumn("html", F.concat(links, "html"))


@query(
    "discovered_sources",
    """SELECT homepage, status, CASE WHEN status IN ('ok', 'stale') THEN CASE WHEN k = 2 THEN 'sitemap' ELSE 'rss' END END AS source_type, CASE WHEN status IN ('ok', 'stale') THEN CASE WHEN k = 2 THEN o || '/news-sitemap.xml' ELSE o || '/feed/' END END AS feed_url,
    CASE WHEN status = 'ok' THEN CASE WHEN k = 2 THEN 5 ELSE 1 END WHEN status = 'stale' THEN 0 END::BIGINT AS recent_items FROM (
    SELECT 'https://' || host || '/' AS homepage, 'https://' || host AS o, length(host) % 6 AS k, CASE length(host) % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'stale' WHEN 2 THEN 'ok' WHEN 3 THEN 'blocked' ELSE 'no_feed' END AS status FROM hosts)""",
    HOST_VIEWS,
)
def discovered_sources(v):
    """Hosts whose usual feed is fresh, old or missing, whose sitemap is fresh, or that refuse."""
    kind, root = F.char_length("host") % 6, F.concat(F.lit("https://"), "host")
    hosts = _hosts(v)
    homepages = hosts.select(F.concat(root, F.lit("/")).alias("homepage"), F.lit("<html></html>").alias("html"), F.when(kind == 3, F.lit("fetch failed: 403 Forbidden")).alias("error"))
    at = F.when(kind == 0, F.lit("2024-01-30 00:00:00")).otherwise(F.lit("2023-06-01 00:00:00")).cast("timestamp")
    entries = hosts.filter(kind.isin(0, 1)).select(F.concat(root, F.lit("/feed/")).alias("feed_url"), at.alias("published_at"))
    counts = hosts.select(F.concat(root, F.lit("/news-sitemap.xml")).alias("sitemap_url"), F.when(kind == 2, F.lit(5)).otherwise(F.lit(0)).cast("bigint").alias("recent"))
    return feeds.discover_sources(homepages, entries, _robots(v), counts, AS_OF)


# --- API answers -----------------------------------------------------------------------------


def _answers(v, name, fields):
    """One JSON answer for 20 documents; every ninth is cut off by a plain-text notice."""
    rows = v.items().withColumn("query_id", F.floor(F.col("item_id") / 20).cast("bigint"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("o"), F.struct(*fields).alias("r"))))
    body = F.to_json(F.struct(F.transform(listed, lambda x: x["r"]).alias(name)))
    return rows.groupBy("query_id").agg(body.alias("body")).withColumn("body", F.when(F.col("query_id") % 9 == 8, F.lit("Please limit requests to one every 5 seconds")).otherwise(F.col("body")))


def _link():
    return F.concat(F.lit("https://"), "source_id", F.lit(".example.org/"), F.col("item_id").cast("string"))


@query(
    "news_articles",
    f"""SELECT item_id // 20 AS query_id, item_id % 20 AS pos, title, 'https://' || source_id || '.example.org/' || item_id AS url, {sql_stamp('published_at')} AS published_at, language, source_id AS source_country FROM items WHERE item_id // 20 % 9 <> 8""",
)
def news_articles(v):
    fields = [F.col("title"), _link().alias("url"), F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("language"), F.col("source_id").alias("sourcecountry")]
    rows = apis.news_articles(_answers(v, "articles", fields))[0]
    return rows.withColumn("published_at", stamp("published_at")).withColumn("pos", F.col("pos").cast("bigint"))


@query("news_rejects", "SELECT DISTINCT item_id // 20 AS query_id, 'Please limit requests to one every 5 seconds' AS error FROM items WHERE item_id // 20 % 9 = 8")
def news_rejects(v):
    return apis.news_articles(_answers(v, "articles", [F.col("title")]))[1]


@query(
    "web_results",
    f"""SELECT item_id // 20 AS query_id, item_id % 20 AS pos, CASE WHEN item_id % 7 = 0 THEN '(untitled)' ELSE title END AS title, 'https://' || source_id || '.example.org/' || item_id AS url, {sql_stamp('published_at')} AS published_at, language AS author FROM items WHERE item_id // 20 % 9 <> 8""",
)
def web_results(v):
    fields = [F.when(F.col("item_id") % 7 != 0, F.col("title")).alias("title"), _link().alias("url"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedDate"), F.col("language").alias("author")]
    rows = apis.search_results(_answers(v, "results", fields))[0]
    return rows.withColumn("published_at", stamp("published_at")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "works",
    """SELECT item_id AS work_id, CASE WHEN item_id % 2 = 0 THEN 'https://doi.org/10.1/' || item_id ELSE 'https://works.example.org/W' || item_id END AS url, source_id AS journal, 'A ' || language || '; B ' || language AS authors,
    sha256(array_to_string(list_filter(regexp_split_to_array(text, ' '), lambda w: w <> ''), ' ')) AS abstract_digest, strftime(published_at, '%Y-%m-%d') AS published_at FROM items WHERE item_id % 9 <> 8""",
)
def works(v):
    """Whole texts as inverted indexes, rebuilt; every ninth body is no JSON."""
    words = F.split("text", " ")
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("bigint").alias("p")))
    dealt = v.items().repartition("item_id")  # words stay with their text
    positions = dealt.select("item_id", F.explode(numbered).alias("x")).filter("x.w <> ''").groupBy("item_id", "x.w").agg(F.array_sort(F.collect_list("x.p")).alias("ps"))
    index = positions.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    rows = dealt.join(index, "item_id", "left").withColumn("query_id", F.floor(F.col("item_id") / 20).cast("bigint"))
    n = F.col("item_id").cast("string")
    work = F.struct(
        F.concat(F.lit("https://works.example.org/W"), n).alias("id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), n)).alias("doi"), F.col("title"),
        F.date_format("published_at", "yyyy-MM-dd").alias("publication_date"), F.struct(F.struct(F.col("source_id").alias("display_name")).alias("source")).alias("primary_location"),
        F.array(F.struct(F.struct(F.concat(F.lit("A "), "language").alias("display_name")).alias("author")), F.struct(F.struct(F.concat(F.lit("B "), "language").alias("display_name")).alias("author"))).alias("authorships"),
        F.col("index").alias("abstract_inverted_index"),
    )
    body = F.when(F.col("item_id") % 9 == 8, F.lit("<html>gateway timeout</html>")).otherwise(F.to_json(F.struct(F.array(work).alias("results"))))
    parsed = apis.works(rows.select(F.col("item_id").alias("query_id"), body.alias("body")))[0]
    return parsed.select(
        F.regexp_extract("work_id", r"W(\d+)$", 1).cast("bigint").alias("work_id"), "url", "journal", F.array_join("authors", "; ").alias("authors"),
        F.sha2(F.coalesce("abstract", F.lit("")), 256).alias("abstract_digest"), F.date_format("published_at", "yyyy-MM-dd").alias("published_at"),
    )


# --- registry and watches --------------------------------------------------------------------


def _seed(v):
    kind = F.when(F.col("n") % 4 == 3, F.lit("api_openalex")).otherwise(F.lit("rss"))
    name = F.concat("source_id", F.lit("-"), "language")
    base = v.items().select("source_id", "language").distinct().join(v.sources().select("source_id", "n", "weight"), "source_id")
    return base.select(
        name.alias("name"), kind.alias("type"), F.when((F.col("n") % 4 != 3) & (F.col("n") % 5 != 0), F.concat(F.lit("https://"), "source_id")).alias("url"), F.when(kind == "api_openalex", F.lit("1234-5678")).alias("issn"), "language",
        F.lit("g").alias("perspective_group"), F.lit(False).alias("paywalled"), F.lit(None).cast("string").alias("link_pattern"), F.col("weight").cast("double").alias("weight"),
    )


def _registry(v):
    return v.items().filter("language in ('en', 'fr') and item_id % 2 = 0").select("source_id", "language").distinct().select(
        F.concat("source_id", F.lit("-"), "language").alias("name"), F.lit("old").alias("type"), F.lit("old").alias("url_or_query"), "language", F.lit("h").alias("perspective_group"), F.lit(True).alias("paywalled"),
        F.lit("^/a").alias("link_pattern"), F.lit(0.33).alias("weight"), F.lit(False).alias("active"),
    )


SEED_VIEWS = {
    "seed": """SELECT DISTINCT i.source_id || '-' || language AS name, CASE WHEN n % 4 = 3 THEN 'api_openalex' ELSE 'rss' END AS type, CASE WHEN n % 4 = 3 THEN '1234-5678' WHEN n % 5 <> 0 THEN 'https://' || i.source_id END AS url_or_query,
        weight::DOUBLE AS weight FROM items i JOIN sources USING (source_id)""",
    "held": "SELECT DISTINCT source_id || '-' || language AS name FROM items WHERE language IN ('en', 'fr') AND item_id % 2 = 0",
}


@query(
    "seeded_registry",
    "SELECT name, type, url_or_query, CASE WHEN name IN (SELECT name FROM held) THEN 0.33 ELSE weight END::DOUBLE AS weight, name NOT IN (SELECT name FROM held) AS active FROM seed",
    SEED_VIEWS,
)
def seeded_registry(v):
    return rg.seed_registry(_seed(v), _registry(v)).select("name", "type", "url_or_query", "weight", "active")


@query("seed_gaps", "SELECT count(*) FILTER (type = 'rss' AND url_or_query IS NULL) AS missing_url, 0::BIGINT AS missing_issn FROM seed", SEED_VIEWS)
def seed_gaps(v):
    return rg.seed_gaps(_seed(v))


@query("watch_queries", "SELECT item_id AS watch_id, CASE WHEN item_id % 2 = 0 THEN 'q ' || source_id ELSE title END AS query FROM items WHERE item_id % 5 <> 0")
def watch_queries(v):
    held = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('{"query": "q '), "source_id", F.lit('"}'))).otherwise(F.lit("{}"))
    return rg.watch_queries(v.items().select(F.col("item_id").alias("watch_id"), F.col("title").alias("name"), held.alias("identifiers"), (F.col("item_id") % 5 != 0).alias("active")))


WATCH_VIEWS = {"page_urls": CANONICAL_SQL, "found": "SELECT page_id % 4 AS watch_id, page_id, canonical_url FROM page_urls "}


def _watched(v):
    results = v.pages().select((F.col("page_id") % 4).alias("watch_id"), F.col("page_id").alias("pos"), "url", F.col("page_id").cast("string").alias("title"))
    stored = v.pages().join(v.table("labels").filter("quality = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(urls.canonical_url(F.col("url")).alias("canonical_url"))
    return rg.watch_arrivals(results, stored)


@query(
    "watch_new_items",
    "SELECT canonical_url, arg_min(page_id, (watch_id, page_id))::VARCHAR AS title FROM found WHERE canonical_url NOT IN (SELECT canonical_url FROM page_urls JOIN labels ON doc_id = page_id WHERE quality = 1) GROUP BY 1",
    WATCH_VIEWS,
)
def watch_new_items(v):
    return _watched(v)[0].select("canonical_url", "title")


@query("watch_links", "SELECT DISTINCT watch_id, canonical_url FROM found", WATCH_VIEWS)
def watch_links(v):
    return _watched(v)[1]


@query(
    "fresh_suggestions",
    """SELECT topic_id, name, host FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY page_id) AS n FROM (SELECT page_id % 8 AS topic_id, page_id, 'Site ' || page_id // 4 AS name,
    regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www[.]', '') AS host FROM pages) WHERE lower(name) NOT IN (SELECT 'site ' || doc_id FROM labels WHERE toxic = 1) AND host NOT LIKE '%.net') WHERE topic_id <> 3
    QUALIFY row_number() OVER (PARTITION BY topic_id, name ORDER BY page_id) = 1""",
)
def fresh_suggestions(v):
    suggestions = v.pages().select((F.col("page_id") % 8).alias("topic_id"), F.col("page_id").alias("pos"), F.concat(F.lit("Site "), F.floor(F.col("page_id") / 4).cast("string")).alias("name"), F.col("url").alias("homepage"))
    by_name = v.table("labels").filter("toxic = 1").select(F.concat(F.lit("SITE "), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("url_or_query"))
    by_host = v.pages().filter(F.endswith(urls.host(F.col("url")), F.lit(".net"))).select(F.lit("x").alias("name"), F.col("url").alias("url_or_query"))
    decided = suggestions.filter("topic_id = 3").select("topic_id", "name")
    return rg.fresh_suggestions(suggestions, by_name.unionByName(by_host), decided).select("topic_id", "name", "host")


@query("topics_due", "SELECT item_id AS topic_id FROM items WHERE language = 'en' AND item_id NOT IN (SELECT doc_id FROM labels) ")
def topics_due(v):
    done = v.table("labels").select(F.col("doc_id").alias("topic_id"), F.lit("2024-01-01").alias("sources_suggested_at"))
    topics = v.items().select(F.col("item_id").alias("topic_id"), (F.col("language") == "en").alias("active"), "created_at").join(done, "topic_id", "left")
    return rg.topics_due(topics).select("topic_id")
