"""Language of texts by trigram profiles that are learnt from labelled texts.

A profile holds, per trigram and language, the log-odds of the trigram in texts of the language against
texts of all. Profiles are rows, one per trigram with an array over the languages, and a text is judged
by the sum over its trigrams: an explode, a join and a partial aggregate, whatever the length of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidings.operators.ordered import top_rows

PER_LANGUAGE = 200
LEAST_SEEN = 5
MAX_GRAMS = 200_000


def trigrams(text: Column) -> Column:
    """All three-letter pieces of the lower-case text, where runs of other characters than letters, its
    beginning and its end are one blank each. One pass over the text, however long it is."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.regexp_extract_all(plain, F.lit("(?=(...))"), F.lit(1))


def language_profiles(labelled: DataFrame, per_language: int = PER_LANGUAGE, least: int = LEAST_SEEN) -> tuple[list[str], DataFrame]:
    """(languages in alphabetical order, rows (gram, odds array<double>)) of labelled texts (item_id,
    language, text).

    Learns from the ``per_language`` lowest item ids of each language, so the profiles are bounded;
    trigrams seen fewer than ``least`` times are left out. Every count is raised by one half.
    """
    known = labelled.filter(F.col("language").isNotNull() & F.col("text").isNotNull()).select("item_id", "language", "text")
    sample = top_rows(known, per_language, ["language"], [F.col("item_id")], "_n")
    counts = sample.select("language", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("language", "gram").agg(F.count("*").alias("n"))
    sizes = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], labelled.sparkSession.createDataFrame([], "gram string, odds array<double>")
    all_grams = sum(sizes.values())
    each = [F.sum(F.when(F.col("language") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(languages)]
    table = counts.groupBy("gram").agg(F.sum("n").alias("n"), *each).filter(F.col("n") >= least)
    odds = [F.log((F.col(f"n{i}") + 0.5) / (sizes[name] + 0.5)) - F.log((F.col("n") + 0.5) / (all_grams + 0.5)) for i, name in enumerate(languages)]
    return languages, table.select("gram", F.array(*odds).alias("odds")).orderBy(F.desc("n"), "gram").limit(MAX_GRAMS)


def by_trigrams(items: DataFrame, languages: list[str], profiles: DataFrame, fallback: str | None = None) -> DataFrame:
    """(item_id, detected, margin): the language with the highest sum of log-odds, and how far it is
    ahead of the second, per known trigram.

    ``fallback`` stands where a text is null or has no known trigram; the margin is null there. Equal
    sums go to the language first in alphabetical order. Items that share an id are judged together.
    """
    ids = items.select("item_id").distinct()
    if not languages:
        return ids.select("item_id", F.lit(fallback).cast("string").alias("detected"), F.lit(None).cast("double").alias("margin"))
    grams = items.select("item_id", F.explode(trigrams(F.col("text"))).alias("gram"))
    # At most MAX_GRAMS rows of one number per language.
    sums = grams.join(F.broadcast(profiles), "gram").groupBy("item_id").agg(F.count("*").alias("n"), *[F.sum(F.col("odds")[i]).alias(f"s{i}") for i in range(len(languages))])
    scores = F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, name in enumerate(languages)])
    ordered = F.sort_array(scores, asc=False)
    second = F.try_element_at(ordered, F.lit(2))["s"] if len(languages) > 1 else F.lit(0.0)
    judged = sums.select("item_id", ordered[0]["name"].alias("detected"), ((ordered[0]["s"] - second) / F.col("n")).alias("margin"))
    return ids.join(judged, "item_id", "left").select("item_id", F.coalesce("detected", F.lit(fallback)).alias("detected"), "margin")


def agreement(judged: DataFrame, labelled: DataFrame) -> DataFrame:
    """(language, texts, agreeing) of judged items against their labels."""
    both = judged.join(labelled.filter(F.col("language").isNotNull()).select("item_id", "language"), "item_id")
    same = F.coalesce(F.col("detected") == F.col("language"), F.lit(False))
    return both.groupBy("language").agg(F.count("*").alias("texts"), F.sum(same.cast("bigint")).alias("agreeing"))
