"""The library's input tables, derived from the given Parquet tables.

``Views`` builds them with DataFrames; ``VIEW_SQL`` holds the same rules as common table
expressions for the SQL engine that checks results. Times are UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

AS_OF = "2024-01-31 00:00:00"
START = "2024-01-01 00:00:00"

# Topics over the invented words of the documents.
TOPICS = (
    (0, "attion", ("attion", "retion / ertion"), ("nicht",), "high", True),
    (1, "erble", ("erble", "thanedble"), (), "normal", True),
    (2, "mente", ("mente", "mentou"), ("thanedble",), "low", True),
    (3, "nicht", ("nicht", "auch die"), (), "normal", True),
    (4, "éon", ("éon (EO)", "ouè"), (), "high", True),
    (5, "quiet topic", ("zzyzx quorum",), (), "low", True),
    (6, "ción", ("ción", "para los"), ("mente",), "normal", True),
    (7, "closed", ("the",), (), "high", False),
)

TOPIC_SCHEMA = "topic_id bigint, name string, keywords array<string>, exclusions array<string>, priority string, active boolean"


def hours_after(hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), F.lit(START).cast("timestamp"))


def _story_of(doc: Column) -> Column:
    return F.floor(doc / 3).cast("bigint")


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def items(self) -> DataFrame:
        published = hours_after(F.col("doc_id") * 37 % 720)
        return self.table("documents").select(
            F.col("doc_id").alias("item_id"),
            F.col("source").alias("source_id"),
            F.col("lang").alias("language"),
            F.regexp_extract("text", r"^[^.\n]*", 0).alias("title"),
            "text",
            published.alias("published_at"),
            F.timestamp_add("HOUR", F.lit(1), published).alias("created_at"),
        )

    def sources(self) -> DataFrame:
        n = F.substring("source", 4, 10).cast("int")
        return (
            self.table("documents")
            .select("source")
            .distinct()
            .select(
                F.col("source").alias("source_id"),
                n.alias("n"),
                ((n % 9 + 1) / F.lit(10)).cast("decimal(3,2)").alias("weight"),
                (n % 7 == 0).alias("weight_locked"),
                (n != 13).alias("active"),
                F.concat(F.lit("g"), (n % 5).cast("string")).alias("perspective_group"),
                F.when(n % 4 == 3, F.lit("sitemap")).otherwise(F.lit("rss")).alias("type"),
            )
        )

    def topics(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n, list(k), list(e), p, a) for i, n, k, e, p, a in TOPICS], TOPIC_SCHEMA)

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("item_id"),
            "embedding",
            F.col("label").cast("bigint").alias("label"),
            hours_after(F.col("vec_id") * 13 % 720).alias("published_at"),
        )

    def topic_vectors(self) -> DataFrame:
        """Mean vector per label."""
        spread = self.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
        means = spread.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
            F.col("label").cast("bigint").alias("topic_id"), F.col("v.x").alias("embedding")
        )

    def story_items(self) -> DataFrame:
        """Three documents make a story."""
        return self.table("documents").select(_story_of(F.col("doc_id")).alias("story_id"), F.col("doc_id").alias("item_id"))

    def stories(self) -> DataFrame:
        story = F.col("story_id")
        seen = self.items().groupBy(_story_of(F.col("item_id")).alias("story_id")).agg(
            F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_updated_at")
        )
        return seen.select(
            "story_id",
            F.concat(F.lit("story "), story.cast("string")).alias("title"),
            (story % 3 + 1).alias("tier"),
            F.when(story % 10 == 9, F.lit("closed")).otherwise(F.lit("open")).alias("status"),
            F.when(story % 10 != 4, F.concat(F.lit("summary of story "), story.cast("string"))).alias("summary"),
            "first_seen_at",
            "last_updated_at",
        )

    def story_topics(self) -> DataFrame:
        story = _story_of(F.col("doc_id"))
        pairs = self.table("documents").select(story.alias("story_id")).distinct()
        return pairs.select("story_id", F.explode(F.array_distinct(F.array(F.col("story_id") % 8, (F.col("story_id") * 3 + 1) % 8))).alias("topic_id"))

    def verdicts(self) -> DataFrame:
        return self.table("labels").select(
            F.col("doc_id").alias("item_id"),
            (F.col("doc_id") % 8).alias("topic_id"),
            (F.col("quality") == 1).alias("picked"),
            (F.col("toxic") == 0).alias("batch_ok"),
        )

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def feedback(self) -> DataFrame:
        signal = (
            F.when(F.col("event_type") == "click", "relevant")
            .when(F.col("event_type") == "purchase", "saved")
            .when(F.col("event_type") == "error", "not_relevant")
            .when(F.col("event_type") == "signup", "less_like_this")
            .otherwise("opened")
        )
        return self.events().select(
            F.col("event_id").alias("feedback_id"),
            F.lit("story").alias("target_type"),
            (F.col("event_id") % 997).alias("target_id"),
            signal.alias("signal"),
            F.col("ts").alias("created_at"),
        )

    def calls(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("call_id"),
            F.when(F.col("event_id") % 10 != 0, F.col("event_type")).alias("stage"),
            F.concat(F.lit("prompt_"), F.col("event_type")).alias("prompt_name"),
            (F.col("value") / 1000).alias("cost_usd"),
            (F.col("event_type") != "error").alias("ok"),
            F.col("ts").alias("created_at"),
        )

    def runs(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("run_id"),
            F.col("event_type").alias("stage"),
            F.col("ts").alias("started_at"),
            F.when(F.col("event_id") % 50 != 0, F.timestamp_add("MINUTE", F.lit(1), F.col("ts"))).alias("finished_at"),
        )

    def questions(self) -> DataFrame:
        """The first user turn of a conversation."""
        return (
            self.table("conversations")
            .filter((F.col("turn") == 0) & (F.col("role") == "user"))
            .select(
                F.col("conv_id").alias("question_id"),
                F.col("text"),
                (F.col("conv_id") % 6 != 5).alias("active"),
                hours_after(F.col("conv_id") * 29 % 720).alias("updated_at"),
            )
        )

    def evidence(self) -> DataFrame:
        """Assistant turns as evidence notes on the conversation's question."""
        turn = F.col("turn")
        stance = F.when(turn % 3 == 0, "supports").when(turn % 3 == 1, "complicates").otherwise("neutral")
        return (
            self.table("conversations")
            .filter(F.col("role") == "assistant")
            .select(
                F.col("conv_id").alias("question_id"),
                turn.alias("turn"),
                (F.col("conv_id") * 3 + turn).alias("story_id"),
                ((F.col("conv_id") + turn) % 4 != 0).alias("relevant"),
                stance.alias("stance"),
                F.col("text").alias("note"),
                hours_after((F.col("conv_id") * 29 + turn * 7) % 720).alias("created_at"),
            )
        )

    def watch_items(self) -> DataFrame:
        """Labelled documents found by one of four watches."""
        doc = F.col("doc_id")
        return self.table("labels").select((doc % 4).alias("watch_id"), doc.alias("item_id"), hours_after((doc * 37 + 5) % 720).alias("created_at"))

    def reading_list(self) -> DataFrame:
        """Documents of good quality, saved as an article or as its story."""
        doc = F.col("doc_id")
        return self.table("labels").filter("quality = 1").select(
            doc.alias("entry_id"),
            F.when(doc % 2 == 0, doc).alias("item_id"),
            F.when(doc % 2 == 1, _story_of(doc)).alias("story_id"),
            (doc % 3 == 0).alias("is_read"),
            hours_after((doc * 37 + 9) % 720).alias("created_at"),
        )

    def scores(self) -> DataFrame:
        """Item scores under one or two topics; topic 8 no longer exists."""
        doc = F.col("doc_id")
        pairs = self.table("documents").select(doc, "source", "lang", F.explode(F.array_distinct(F.array(doc % 8, (doc * 5 + 3) % 9))).alias("topic_id"))
        words = F.concat_ws(", ", "source", "lang")
        reason = (
            F.when(doc % 4 == 0, F.concat(F.lit("ai; keywords: "), words))
            .when(doc % 4 == 1, F.lit("ai"))
            .when(doc % 4 == 2, F.concat(F.lit("keywords (AI unavailable): "), F.col("source")))
            .otherwise(F.lit("keyword"))
        )
        return pairs.select(doc.alias("item_id"), "topic_id", ((doc * 3 + F.col("topic_id")) % 11).alias("score"), reason.alias("reason"))

    def statuses(self) -> DataFrame:
        """Items with the status an earlier run left them in."""
        status = F.element_at(F.array(F.lit("not_relevant"), F.lit("scored"), F.lit("grouped"), F.lit("new"), F.lit("embedded")), (F.col("item_id") % 5 + 1).cast("int"))
        return self.items().withColumn("status", status)

    def linked_items(self) -> DataFrame:
        """Items with a link; every third has no registered source."""
        kept = F.when(F.col("item_id") % 3 != 0, F.col("source_id"))
        link = F.concat(F.lit("https://www."), "source_id", F.lit(".example.org/"), F.col("item_id").cast("string"))
        return self.items().select("item_id", "title", link.alias("url"), kept.alias("source_id"))

    def pages(self) -> DataFrame:
        return self.table("pages")


_HOUR = f"(TIMESTAMP '{START}' + to_hours(CAST({{}} AS BIGINT)))"


def _hour(expression: str) -> str:
    return _HOUR.format(expression)


def _array(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::VARCHAR[]"


VIEW_SQL = {
    "items": f"""SELECT doc_id AS item_id, source AS source_id, lang AS language,
        regexp_extract(text, '^[^.\\n]*') AS title, text,
        {_hour('doc_id * 37 % 720')} AS published_at, {_hour('doc_id * 37 % 720 + 1')} AS created_at FROM documents""",
    "sources": """SELECT source_id, n, CAST((n % 9 + 1) / 10.0 AS DECIMAL(3,2)) AS weight, n % 7 = 0 AS weight_locked, n <> 13 AS active,
        'g' || CAST(n % 5 AS VARCHAR) AS perspective_group, CASE WHEN n % 4 = 3 THEN 'sitemap' ELSE 'rss' END AS type
        FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)""",
    "topics": "SELECT * FROM (VALUES "
    + ", ".join(f"(CAST({i} AS BIGINT), '{n}', {_array(k)}, {_array(e)}, '{p}', {str(a).lower()})" for i, n, k, e, p, a in TOPICS)
    + ") t(topic_id, name, keywords, exclusions, priority, active)",
    "vectors": f"SELECT vec_id AS item_id, embedding, CAST(label AS BIGINT) AS label, {_hour('vec_id * 13 % 720')} AS published_at FROM embeddings",
    "topic_vectors": """SELECT CAST(label AS BIGINT) AS topic_id, list(x ORDER BY pos) AS embedding FROM (
        SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
        GROUP BY label, pos) GROUP BY label""",
    "story_items": "SELECT doc_id // 3 AS story_id, doc_id AS item_id FROM documents",
    "stories": """SELECT story_id, 'story ' || story_id AS title, story_id % 3 + 1 AS tier, CASE WHEN story_id % 10 = 9 THEN 'closed' ELSE 'open' END AS status,
        CASE WHEN story_id % 10 <> 4 THEN 'summary of story ' || story_id END AS summary, first_seen_at, last_updated_at
        FROM (SELECT item_id // 3 AS story_id, min(published_at) AS first_seen_at, max(published_at) AS last_updated_at FROM items GROUP BY 1)""",
    "story_topics": "SELECT DISTINCT doc_id // 3 AS story_id, unnest([doc_id // 3 % 8, (doc_id // 3 * 3 + 1) % 8]) AS topic_id FROM documents",
    "verdicts": "SELECT doc_id AS item_id, doc_id % 8 AS topic_id, quality = 1 AS picked, toxic = 0 AS batch_ok FROM labels",
    "feedback": """SELECT event_id AS feedback_id, 'story' AS target_type, event_id % 997 AS target_id, CASE event_type WHEN 'click' THEN 'relevant'
        WHEN 'purchase' THEN 'saved' WHEN 'error' THEN 'not_relevant' WHEN 'signup' THEN 'less_like_this' ELSE 'opened' END AS signal,
        ts AS created_at FROM events""",
    "calls": """SELECT event_id AS call_id, CASE WHEN event_id % 10 <> 0 THEN event_type END AS stage, 'prompt_' || event_type AS prompt_name,
        value / 1000 AS cost_usd, event_type <> 'error' AS ok, ts AS created_at FROM events""",
    "runs": "SELECT event_id AS run_id, event_type AS stage, ts AS started_at, CASE WHEN event_id % 50 <> 0 THEN ts + INTERVAL 1 MINUTE END AS finished_at FROM events",
    "questions": f"""SELECT conv_id AS question_id, text, conv_id % 6 <> 5 AS active, {_hour('conv_id * 29 % 720')} AS updated_at
        FROM conversations WHERE turn = 0 AND role = 'user'""",
    "evidence": f"""SELECT conv_id AS question_id, turn, conv_id * 3 + turn AS story_id, (conv_id + turn) % 4 <> 0 AS relevant,
        CASE turn % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'complicates' ELSE 'neutral' END AS stance, text AS note,
        {_hour('(conv_id * 29 + turn * 7) % 720')} AS created_at FROM conversations WHERE role = 'assistant'""",
    "watch_items": f"SELECT doc_id % 4 AS watch_id, doc_id AS item_id, {_hour('(doc_id * 37 + 5) % 720')} AS created_at FROM labels",
    "reading_list": f"""SELECT doc_id AS entry_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS item_id, CASE WHEN doc_id % 2 = 1 THEN doc_id // 3 END AS story_id,
        doc_id % 3 = 0 AS is_read, {_hour('(doc_id * 37 + 9) % 720')} AS created_at FROM labels WHERE quality = 1""",
    "scores": """SELECT doc_id AS item_id, topic_id, (doc_id * 3 + topic_id) % 11 AS score, CASE doc_id % 4 WHEN 0 THEN 'ai; keywords: ' || source || ', ' || lang
        WHEN 1 THEN 'ai' WHEN 2 THEN 'keywords (AI unavailable): ' || source ELSE 'keyword' END AS reason
        FROM (SELECT *, unnest(list_distinct([doc_id % 8, (doc_id * 5 + 3) % 9])) AS topic_id FROM documents)""",
    "statuses": "SELECT *, ['not_relevant', 'scored', 'grouped', 'new', 'embedded'][item_id % 5 + 1] AS status FROM items",
    "linked_items": """SELECT item_id, title, 'https://www.' || source_id || '.example.org/' || item_id AS url,
        CASE WHEN item_id % 3 <> 0 THEN source_id END AS source_id FROM items""",
}


def _definition(name: str, sql: str) -> str:
    kept = sql.startswith("MATERIALIZED ")
    return f"{name} AS {'MATERIALIZED ' if kept else ''}({sql.removeprefix('MATERIALIZED ')})"


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it names, directly or through other views."""
    known = {**VIEW_SQL, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text) and text is not known[name]:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    prefix = ", ".join(_definition(name, known[name]) for name in needed)
    return f"WITH RECURSIVE {prefix} {body}" if prefix else body
