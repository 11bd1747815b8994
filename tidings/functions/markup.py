"""Regular expressions over markup. None of them fails on broken input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidings.functions import text as tx, urls


def found(column: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def tag_text(block: Column, name: str) -> Column:
    """Decoded content of the first element of that name."""
    return tx.decode_entities(found(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>"))


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, r"<[^>]+>", " ")


def strip_stylesheets(html: Column) -> Column:
    """Drop style elements and stylesheet links."""
    kept = F.regexp_replace(html, r"(?is)<style\b.*?</style\s*>", "")
    sheets = F.filter(tags(html, "link"), lambda tag: F.contains(F.lower(attribute(tag, "rel")), F.lit("stylesheet")))
    return F.aggregate(sheets, kept, lambda text, tag: F.replace(text, tag))


def tags(html: Column, name: str) -> Column:
    """The opening tags of that name, in page order. A quoted value may hold a '>'."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)<{name}\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def attributes(tag: Column) -> Column:
    """Array of (name, value) of a tag: names in lower case, values as written, quoted or not."""
    pair = F.lit(r"""([\w:.-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
    names, values = F.regexp_extract_all(tag, pair, F.lit(1)), F.regexp_extract_all(tag, pair, F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))


def value_of(pairs: Column, name: str) -> Column:
    """Decoded value of the first attribute of that name; null without one."""
    raw = F.get(F.filter(pairs, lambda a: a["name"] == name), F.lit(0))["value"]
    plain = lambda v: F.when(F.substring(v, 1, 1).isin('"', "'"), F.substring(v, F.lit(2), F.char_length(v) - 2)).otherwise(v)
    return tx.decode_entities(tx.let(raw, plain))


def attribute(tag: Column, name: str) -> Column:
    return value_of(attributes(tag), name)


def first_value(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def meta_content(html: Column, name: str, value: str) -> Column:
    """Content of the first meta tag whose attribute ``name`` is ``value``."""
    fitting = F.filter(tags(html, "meta"), lambda tag: F.lower(attribute(tag, name)) == value)
    return first_value(F.transform(fitting, lambda tag: attribute(tag, "content")))


def page_title(html: Column) -> Column:
    title = F.coalesce(meta_content(html, "property", "og:title"), meta_content(html, "name", "twitter:title"), tag_text(html, "title"))
    return F.nullif(title, F.lit(""))


def page_description(html: Column) -> Column:
    return F.nullif(F.coalesce(meta_content(html, "property", "og:description"), meta_content(html, "name", "description")), F.lit(""))


def page_published(html: Column) -> Column:
    """Publication date as written, null when it is not a date. Linked data names it as a JSON key,
    wherever in the page that stands."""
    after_key = F.try_element_at(F.split(html, '"datePublished"', 2), F.lit(2))
    linked = F.when(F.ltrim(after_key).startswith(":"), F.try_element_at(F.split(after_key, '"', 3), F.lit(2)))
    timed = first_value(F.transform(tags(html, "time"), lambda tag: attribute(tag, "datetime")))
    written = F.coalesce(meta_content(html, "property", "article:published_time"), F.nullif(linked, F.lit("")), timed)
    return tx.let(written, lambda text: F.when(tx.parse_date(text).isNotNull(), text))


# Elements that hold no article text, and elements that end a block of text.
FURNITURE = ("script", "noscript", "nav", "header", "footer", "aside", "form")
BLOCK_ENDS = r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|ul|ol|table|tr|td|section|blockquote|article)>"


def page_text(html: Column) -> Column:
    """Readable text of a page: the article element, else main, else body, without furniture.

    Blocks made mostly of link text are dropped. A page without readable text gives null.
    """
    clean = F.regexp_replace(strip_stylesheets(html), r"(?s)<!--.*?-->", " ")
    for name in FURNITURE:
        clean = F.regexp_replace(clean, rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}>", " ")
    part = tx.let(clean, lambda c: F.coalesce(*[found(c, rf"(?is)<{name}(?:\s[^>]*)?>(.*)</{name}>") for name in ("article", "main", "body")], c))
    blocks = F.split(F.regexp_replace(part, BLOCK_ENDS, "\u0001"), "\u0001")

    def plain(block: Column) -> Column:
        return tx.one_space(tx.decode_entities(strip_tags(block)))

    def own(block: Column) -> Column:
        """The block's plain text, empty when links make up more than half of it."""
        without = plain(F.regexp_replace(block, r"(?is)<a\s[^>]*>.*?</a>", " "))
        return tx.let(plain(block), lambda text: F.when(F.char_length(without) * 2 < F.char_length(text), F.lit("")).otherwise(text))

    kept = F.filter(F.transform(blocks, lambda b: own(b)), lambda b: b != "")
    whole = tx.sanitize_text(F.array_join(kept, "\n"))
    return F.nullif(whole, F.lit(""))


def link_text(inner: Column) -> Column:
    """Visible text of a link without the arrows, dashes and bullets it begins with."""
    plain = tx.decode_entities(strip_tags(inner))
    return tx.one_space(F.regexp_replace(plain, r"(?U)^[\s\p{S}\p{Pd}»›•·]+", ""))


def page_links(html: Column, base: Column) -> Column:
    """Array of (url, text) of the links of a page, in page order. A link loses its fragment; one that
    is only a fragment points into the page and is left out."""
    element = F.lit(r"""(?is)(<a\b(?:[^>"']|"[^"]*"|'[^']*')*>)(.*?)</a\s*>""")
    opened, inner = (F.regexp_extract_all(html, element, F.lit(g)) for g in (1, 2))
    found = F.zip_with(opened, inner, lambda tag, text: F.struct(F.split(attribute(tag, "href"), "#", 2)[0].alias("href"), text.alias("text")))
    linking = F.filter(found, lambda x: F.coalesce(F.trim(x["href"]), F.lit("")) != "")
    return F.transform(linking, lambda x: F.struct(urls.absolute_url(x["href"], base).alias("url"), link_text(x["text"]).alias("text")))


def feed_link_list(html: Column, base: Column) -> Column:
    """Distinct advertised feed urls of a page; comment feeds are not publications."""

    def feed_url(tag: Column) -> Column:
        pairs = attributes(tag)
        kind, relation = F.lower(value_of(pairs, "type")), F.lower(value_of(pairs, "rel"))
        offered = F.array_contains(F.split(relation, r"\s+"), F.lit("alternate")) & kind.isin("application/rss+xml", "application/atom+xml")
        return F.when(offered, value_of(pairs, "href"))

    hrefs = F.filter(F.transform(tags(html, "link"), feed_url), lambda h: (h != "") & ~F.contains(F.lower(h), F.lit("comments")))
    return F.array_distinct(F.array_compact(F.transform(hrefs, lambda h: urls.absolute_url(h, base))))


def robots_lines(robots: Column) -> Column:
    """Array of (key, value) of a robots file, without comments and lines that are no rule."""

    def rule(line: Column) -> Column:
        parts = F.split(F.split(line, "#", 2)[0], ":", 2)
        return F.struct(F.lower(F.trim(parts[0])).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value"))

    return F.filter(F.transform(F.split(F.translate(robots, "\r\t", "\n "), "\n"), rule), lambda r: r["value"].isNotNull() & (r["key"] != ""))


def robots_sitemap_list(robots: Column) -> Column:
    """Distinct sitemap urls of a robots file, those with 'news' first."""
    maps = F.filter(robots_lines(robots), lambda r: (r["key"] == "sitemap") & (r["value"] != ""))
    listed = F.array_distinct(F.transform(maps, lambda r: r["value"]))
    is_news = lambda u: F.contains(F.lower(u), F.lit("news"))
    return F.concat(F.filter(listed, is_news), F.filter(listed, lambda u: ~is_news(u)))


def robots_rules(robots: Column) -> Column:
    """Disallow rules of the generic group, in file order.

    A group begins with an agent line that follows another kind of line; the file is cut there, and
    the groups that name the generic agent are kept. Sitemap lines belong to no group.
    """

    def cut(lines: Column) -> Column:
        agent = lambda r: r["key"] == "user-agent"
        starts = F.transform(lines, lambda r, i: agent(r) & ((i == 0) | ~agent(F.get(lines, i - 1))))
        begins = F.filter(F.transform(starts, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(lines)))
        groups = F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, F.greatest(F.coalesce(e - b, F.lit(0)), F.lit(0))))
        generic = F.filter(groups, lambda g: F.exists(g, lambda r: agent(r) & (r["value"] == "*")))
        barred = F.filter(F.flatten(generic), lambda r: (r["key"] == "disallow") & (r["value"] != ""))
        return F.transform(barred, lambda r: r["value"])

    grouped = F.filter(robots_lines(robots), lambda r: r["key"] != "sitemap")
    return tx.let(grouped, lambda lines: F.when(F.exists(lines, lambda r: r["key"] == "user-agent"), cut(lines)).otherwise(F.array().cast("array<string>")))
