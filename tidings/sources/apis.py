"""Search and scholarly API answers held as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidings.functions import text as tx

ARTICLES = "struct<articles: array<struct<title: string, url: string, seendate: string, language: string, sourcecountry: string>>>"
RESULTS = "struct<results: array<struct<title: string, url: string, publishedDate: string, author: string>>>"
WORKS = (
    "struct<results: array<struct<id: string, doi: string, title: string, display_name: string, publication_date: string,"
    " primary_location: struct<source: struct<display_name: string>>, authorships: array<struct<author: struct<display_name: string>>>,"
    " abstract_inverted_index: map<string, array<bigint>>>>>"
)


def _split(bodies: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, rejects): a body that is not a JSON object goes to the rejects."""
    parsed = bodies.withColumn("value", F.when(F.col("body").rlike(r"^\s*\{"), F.from_json("body", schema, {"mode": "PERMISSIVE"})))
    good = parsed.filter(F.col("value").isNotNull() & F.try_parse_json("body").isNotNull())
    bad = parsed.filter(F.col("value").isNull() | F.try_parse_json("body").isNull())
    return good, bad.select("query_id", F.col("body").alias("error"))


def news_articles(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of news search answers (query_id, body); no article list means no rows."""
    good, bad = _split(bodies, ARTICLES)
    rows = good.select("query_id", F.posexplode(F.coalesce("value.articles", F.array().cast("array<struct<title: string, url: string, seendate: string, language: string, sourcecountry: string>>"))).alias("pos", "a"))
    return rows.select("query_id", "pos", "a.title", "a.url", tx.parse_date(F.col("a.seendate")).alias("published_at"), "a.language", F.col("a.sourcecountry").alias("source_country")), bad


def search_results(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of web search answers (query_id, body)."""
    good, bad = _split(bodies, RESULTS)
    rows = good.select("query_id", F.posexplode("value.results").alias("pos", "r"))
    return rows.select("query_id", "pos", F.coalesce("r.title", F.lit("(untitled)")).alias("title"), "r.url", tx.parse_date(F.col("r.publishedDate")).alias("published_at"), "r.author"), bad


def abstract_text(index: Column) -> Column:
    """Text of an inverted index (word -> positions); the last word listed keeps a position."""
    entries = F.map_entries(index)
    placed = F.flatten(F.transform(entries, lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))

    def joined(ordered: Column) -> Column:
        following = F.concat(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.array(F.lit(None)))
        pairs = F.zip_with(ordered, following, lambda x, y: F.struct(x["w"].alias("w"), (F.coalesce(x["p"] != y["p"], F.lit(True)) & (x["w"] != "")).alias("last")))
        return F.array_join(F.transform(F.filter(pairs, lambda x: x["last"]), lambda x: x["w"]), " ")

    return F.nullif(tx.let(F.array_sort(placed), joined), F.lit(""))


def works(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of scholarly answers (query_id, body): url is the DOI, else the work's id."""
    good, bad = _split(bodies, WORKS)
    rows = good.select("query_id", F.posexplode("value.results").alias("pos", "w"))
    return rows.select(
        "query_id",
        "pos",
        F.col("w.id").alias("work_id"),
        "w.doi",
        F.coalesce("w.title", "w.display_name", F.lit("(untitled)")).alias("title"),
        F.coalesce("w.doi", "w.id").alias("url"),
        F.col("w.primary_location.source.display_name").alias("journal"),
        F.coalesce(F.transform("w.authorships", lambda a: a["author"]["display_name"]), F.array().cast("array<string>")).alias("authors"),
        abstract_text(F.col("w.abstract_inverted_index")).alias("abstract"),
        tx.parse_date(F.col("w.publication_date")).alias("published_at"),
    ), bad
