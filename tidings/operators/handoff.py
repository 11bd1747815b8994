"""Rows handed to an outside model, and checks on what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidings.functions import text as tx

MATCH_ANSWER = "struct<matches: array<struct<i: bigint, t: array<bigint>>>>"
GROUP_ANSWER = "struct<assign: array<struct<i: bigint, e: bigint>>, new_events: array<struct<items: array<bigint>, title: string, summary: string, tier: bigint>>>"
RELEVANCE_ANSWER = "struct<results: array<struct<id: string, score: double, reason: string>>>"


def item_lines(batch: DataFrame, source: str | None = None) -> DataFrame:
    """(batch_no, items): one numbered line per article, in batch order. Batches are of fixed size."""
    summary = F.when(F.coalesce("standfirst", F.lit("")) != "", F.concat(F.lit(" | "), "standfirst")).otherwise(F.lit(""))
    label = F.lit("") if source is None else F.concat(F.lit("["), F.coalesce(source, F.lit("?")), F.lit("] "))
    line = F.concat(F.col("idx").cast("string"), F.lit(". "), label, "title", summary)
    rows = batch.select("batch_no", F.struct(F.col("idx"), line.alias("line")).alias("l"))
    return rows.groupBy("batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("items"))


def match_requests(batch: DataFrame, topics: DataFrame) -> DataFrame:
    """(batch_no, request): topics and articles of a matching batch as text.

    Every request lists all topics, so they are folded once, on the driver, into a constant.
    """
    line = F.concat(F.lit("T"), F.col("idx").cast("string"), F.lit(": "), "name")
    listed = topics.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("topics"))
    head = F.lit("Topics:\n" + listed.first()["topics"] + "\n\nArticles:\n")
    return item_lines(batch).select("batch_no", F.concat(head, "items").alias("request"))


def group_requests(batch: DataFrame, events: DataFrame) -> DataFrame:
    """(batch_no, request): known events and articles of a grouping batch as text."""
    line = F.concat(F.lit("E"), F.col("idx").cast("string"), F.lit(": "), "title")
    listed = events.select("batch_no", F.struct("idx", line.alias("line")).alias("l")).groupBy("batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("events"))
    return item_lines(batch, "source").join(listed, "batch_no", "left").select(
        "batch_no", F.concat(F.lit("Events:\n"), F.coalesce("events", F.lit("(none yet)")), F.lit("\n\nArticles:\n"), "items").alias("request")
    )


def relevance_requests(batch: DataFrame, topics: DataFrame, examples: DataFrame) -> DataFrame:
    """(topic_id, batch_no, request): one topic's wording, feedback examples and articles."""
    line = F.concat(F.lit("- id: "), F.col("item_id").cast("string"), F.lit("\n  language: "), F.coalesce("language", F.lit("unknown")), F.lit("\n  title: "), "title", F.lit("\n  standfirst: "), F.coalesce("standfirst", F.lit("(none)")))
    listed = batch.select("topic_id", "batch_no", F.struct("idx", line.alias("line")).alias("l")).groupBy("topic_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("items"))
    quoted = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(c, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", "), F.lit("")), F.lit("(none)"))
    joined = listed.join(topics.select("topic_id", "name", "exclusions"), "topic_id").join(examples, "topic_id", "left")
    excluded = F.coalesce(F.nullif(F.array_join("exclusions", ", "), F.lit("")), F.lit("(none)"))
    text = F.concat(F.lit("Topic: "), "name", F.lit("\nExcluded: "), excluded, F.lit("\nRelevant: "), quoted(F.col("positive")), F.lit("\nNot relevant: "), quoted(F.col("negative")), F.lit("\nItems:\n"), "items")
    return joined.select("topic_id", "batch_no", text.alias("request"))


def json_body(answer: Column) -> Column:
    """The part between the first '{' and the last '}', or the trimmed answer."""
    inner = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(F.trim(answer))


def parsed_answers(answers: DataFrame, schema: str, valid) -> tuple[DataFrame, DataFrame]:
    """(good, bad) answers (batch_no, answer). Good rows have ``value`` parsed by ``schema`` and
    accepted by the column test ``valid``; a bad answer is a failed batch."""
    parsed = answers.withColumn("value", F.from_json(json_body(F.col("answer")), schema))
    fine = F.coalesce(valid(F.col("value")), F.lit(False))
    return parsed.filter(fine).drop("answer"), parsed.filter(~fine).select("batch_no")


def match_valid(value: Column) -> Column:
    return value["matches"].isNotNull() & F.forall(value["matches"], lambda m: m["i"].isNotNull() & m["t"].isNotNull())


def group_valid(value: Column) -> Column:
    events_fine = F.forall(value["new_events"], lambda e: (F.size(e["items"]) >= 1) & e["title"].isNotNull() & e["summary"].isNotNull() & e["tier"].between(1, 3))
    return value["assign"].isNotNull() & F.forall(value["assign"], lambda a: a["i"].isNotNull() & a["e"].isNotNull()) & events_fine


def relevance_valid(value: Column) -> Column:
    return value["results"].isNotNull() & F.forall(value["results"], lambda r: r["id"].isNotNull() & r["score"].between(0, 10) & r["reason"].isNotNull())


def few_shot(feedback: DataFrame, story_topics: DataFrame, story_items: DataFrame, items: DataFrame, signals: tuple, most: int | None = None) -> DataFrame:
    """(topic_id, titles): titles of the stories behind the signals of one polarity on each topic, the
    newest first, one title per story (its item with the lowest id).

    Of the signals on one story the newest counts. ``most`` keeps that many stories of a topic.
    """
    recent = feedback.filter((F.col("target_type") == "story") & F.col("signal").isin(*signals))
    of_topic = recent.select(F.col("target_id").alias("story_id"), "created_at", "feedback_id").join(story_topics, "story_id")
    from tidings.operators.ordered import most_rows

    newest = of_topic.groupBy("topic_id", "story_id").agg(F.min(F.struct((-F.unix_micros("created_at")).alias("before"), "feedback_id")).alias("rank"))
    first = most_rows(newest, most, ["topic_id"], [F.col("rank")])
    titles = story_items.join(first.select("story_id").distinct(), "story_id", "left_semi").join(items.filter(F.coalesce("title", F.lit("")) != "").select("item_id", "title"), "item_id").groupBy("story_id").agg(F.min_by("title", "item_id").alias("title"))
    return first.join(titles, "story_id").groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: t["title"]).alias("titles"))


def eval_assertions(cases: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per case, totals) of expected and forbidden terms and the number of framing entries.

    ``cases`` (case_id, must_contain, must_not_contain, min_framing, max_framing); ``outputs``
    (case_id, texts array, framing array). A case without output fails.
    """
    joined = cases.join(outputs, "case_id", "left")
    text = F.lower(F.array_join(F.concat("texts", "framing"), " "))
    has = lambda t: tx.contains_term(F.col("text"), t)
    n = F.size("framing")
    checked = joined.withColumn("text", text).select(
        "case_id",
        F.size(F.filter("must_contain", lambda t: ~has(t))).cast("bigint").alias("missing"),
        F.size(F.filter("must_not_contain", has)).cast("bigint").alias("forbidden"),
        (F.coalesce(n < F.col("min_framing"), F.lit(False)) | F.coalesce(n > F.col("max_framing"), F.lit(False))).alias("framing_off"),
        F.col("text").isNotNull().alias("answered"),
    )
    passed = F.col("answered") & (F.col("missing") == 0) & (F.col("forbidden") == 0) & ~F.col("framing_off")
    per_case = checked.withColumn("passed", passed)
    return per_case, per_case.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
