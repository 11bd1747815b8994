"""Tracked questions: pairs to judge, evidence, weekly updates, the front-page widget."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.functions import urls
from tidings.operators.brief import DEFAULT_NOTE
from tidings.operators.ordered import newest_rows, top_rows

# Fixed value: the text of a week without evidence.
NO_EVIDENCE = "Bu hafta bu soruyla ilgili yeni kanıt kaydedilmedi. Soru aktif olarak izlenmeye devam ediyor."
CITATIONS = "array<struct<index: double, id: string, title: string, url: string, publishedAt: string>>"


def stories_to_judge(question_id, stories: DataFrame, judged: DataFrame) -> DataFrame:
    """(question_id, story_id) one question still has to meet: open, summarised stories it was not
    judged against. Work is handed out per question, so the pairs of all questions are never listed."""
    ready = stories.filter((F.col("status") == "open") & F.col("summary").isNotNull()).select("story_id")
    done = judged.filter(F.col("question_id") == question_id).select("story_id")
    return ready.join(done, "story_id", "left_anti").select(F.lit(question_id).alias("question_id"), "story_id")


def open_pair_counts(questions: DataFrame, stories: DataFrame, judged: DataFrame) -> DataFrame:
    """(question_id, open_stories): how many stories a question still has to meet, without listing
    the pairs."""
    asked = questions.filter("active").select("question_id")
    ready = stories.filter((F.col("status") == "open") & F.col("summary").isNotNull()).select("story_id")
    total = ready.agg(F.count("*").alias("total"))
    done = judged.select("question_id", "story_id").distinct().join(ready, "story_id", "left_semi").groupBy("question_id").agg(F.count("*").alias("done"))
    return asked.join(done, "question_id", "left").join(F.broadcast(total)).select("question_id", (F.col("total") - F.coalesce("done", F.lit(0))).alias("open_stories"))


def evidence_rows(verdicts: DataFrame) -> DataFrame:
    """All verdicts are kept; stance and note only for relevant ones."""
    only = lambda c: F.when(F.col("relevant"), F.col(c)).alias(c)
    return verdicts.select(*[only(c) if c in ("stance", "note") else F.col(c) for c in verdicts.columns])


def evidence_counts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, evidence): relevant evidence per question, also zero."""
    found = evidence.filter("relevant").groupBy("question_id").agg(F.count("*").alias("evidence"))
    return questions.select("question_id").join(found, "question_id", "left").fillna(0, ["evidence"])


def latest_updates(updates: DataFrame) -> DataFrame:
    return updates.groupBy("question_id").agg(F.max("created_at").alias("last_update"))


def weekly_evidence(questions: DataFrame, evidence: DataFrame, updates: DataFrame, date: str) -> DataFrame:
    """(question_id, period_start, period_end, stance, note, story_id, text): the evidence of the
    week that ends on ``date``, one row per piece; a question without any has one row with the
    fixed text. Questions that already have this week's update are left out."""
    end = F.to_date(F.lit(date))
    start = F.date_sub(end, 6)
    done = updates.filter((F.col("update_type") == "weekly") & (F.col("period_start") == start) & (F.col("period_end") == end))
    due = questions.filter("active").select("question_id").join(done.select("question_id"), "question_id", "left_anti")
    week = evidence.filter(F.col("relevant") & (F.col("created_at") >= start.cast("timestamp")) & (F.col("created_at") < F.date_add(end, 1).cast("timestamp")))
    joined = due.join(week.select("question_id", "stance", "note", "story_id", F.lit(True).alias("found")), "question_id", "left")
    return joined.select("question_id", start.alias("period_start"), end.alias("period_end"), "stance", "note", "story_id", F.when(F.col("found").isNull(), F.lit(NO_EVIDENCE)).alias("text"))


def first_assessments(updates: DataFrame) -> DataFrame:
    """One first assessment per question, the earliest."""
    return top_rows(updates.filter("update_type = 'initial'"), 1, ["question_id"], [F.col("created_at")]).drop("rank")


def question_history(questions: DataFrame, evidence: DataFrame, stories: DataFrame) -> DataFrame:
    """(question_id, pos, stance, note, story_title): relevant evidence, newest first."""
    from tidings.operators.ordered import running_totals

    seen = evidence.filter("relevant").join(questions.select("question_id"), "question_id", "left_semi").join(stories.select("story_id", F.col("title").alias("story_title")), "story_id", "left")
    ordered = running_totals(seen.withColumn("age", -F.unix_micros("created_at")), ["question_id"], ["age", "turn"], {"pos": F.lit(1).cast("bigint")})
    return ordered.select("question_id", "pos", "stance", "note", "story_title")


def question_widget(questions: DataFrame, evidence: DataFrame, stories: DataFrame, newest: int | None = None) -> DataFrame:
    """(question_id, text, note, story_id): of the active questions the newest with noted evidence,
    shown with its latest note; otherwise the newest question with the fixed note. ``newest`` looks at
    so many of them only."""
    recent = newest_rows(questions.filter("active").select("question_id", "text", "updated_at"), newest, [F.col("updated_at").desc(), F.col("question_id")])
    noted = evidence.filter(F.col("note").isNotNull()).join(recent.select("question_id"), "question_id", "left_semi")
    last = noted.groupBy("question_id").agg(F.max_by(F.struct("note", "story_id"), F.struct("created_at", "turn")).alias("e"))
    shown = last.join(stories.select(F.col("story_id").alias("e_story")), F.col("e.story_id") == F.col("e_story"), "left_semi")
    order = F.struct(F.col("e").isNull().alias("none"), (-F.unix_micros("updated_at")).alias("age"), "question_id")
    pick = recent.join(shown, "question_id", "left").agg(F.min_by(F.struct("question_id", "text", "e"), order).alias("q"))
    return pick.filter("q is not null").select("q.question_id", "q.text", F.coalesce("q.e.note", F.lit(DEFAULT_NOTE)).alias("note"), F.col("q.e.story_id").alias("story_id"))


def cited_items(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, item_id, rank) cited by an answer (query_id, has_evidence, indices); an answer
    without evidence cites nothing."""
    cited = answers.filter("has_evidence").select("query_id", F.explode(F.array_distinct("indices")).alias("rank"))
    return candidates.join(cited, ["query_id", "rank"]).select("query_id", "item_id", "rank")


def valid_citations(column):
    """Array of the well-typed entries of a citation list that link to a web page."""
    listed = F.from_json(column, CITATIONS)
    complete = lambda c: c["index"].isNotNull() & c["id"].isNotNull() & c["title"].isNotNull() & urls.scheme(c["url"]).isin("http", "https")
    return F.filter(listed, lambda c: F.coalesce(complete(c), F.lit(False)))
