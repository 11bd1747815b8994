"""Queries that run the streaming jobs over the given tables read as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators import brief, dedup, ordered
from tidings.plans.matching_queries import CANONICAL_VECTORS_SQL, VECTOR_VIEWS
from tidings.plans.registry import query, sql_stamp, stamp
from tidings.streaming import jobs, linking
from tidings.streaming.store import run_folder


PARTS = 3
WRITERS = 4


def _stream(v, table, part):
    """A table as a stream of ``PARTS`` micro-batches of ``WRITERS`` files. ``part`` numbers a row's batch."""
    folder = run_folder(v.spark, "arriving")
    for n in range(PARTS):
        table.filter(part == n).repartition(WRITERS).write.mode("append").parquet(folder)
    return v.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", WRITERS).parquet(folder)


def _in_turn(at):
    """Files in the order of time, ten days each."""
    return F.least(F.lit(PARTS - 1), F.floor(F.datediff(at.cast("date"), F.lit("2024-01-01").cast("date")) / 10))


def _events(v):
    """Events in the order of their time."""
    return _stream(v, v.events(), _in_turn(F.col("ts")))


def _late_events(v):
    """Events dealt out by number, so that most come weeks after later ones, and every hundredth
    comes twice."""
    events = v.events().withColumn("file", F.col("event_id") % PARTS)
    again = events.filter(F.col("event_id") % 100 == 0).withColumn("file", F.lit(PARTS - 1).cast("bigint"))
    return _stream(v, events.unionByName(again), F.col("file"))


@query(
    "stream_request_counts",
    f"SELECT user_id AS owner, event_type AS bucket, {sql_stamp('to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP')} AS window_start, count(*) AS hits FROM events GROUP BY 1, 2, 3",
)
def stream_request_counts(v):
    requests = _events(v).select(F.col("user_id").alias("owner"), F.col("event_type").alias("bucket"), "ts")
    counts = jobs.collect_counts(jobs.request_counts(requests, 3600), run_folder(v.spark, "requests"), ["owner", "bucket", "window_start"])
    return counts.withColumn("window_start", stamp("window_start"))


@query(
    "stream_live_counts",
    f"""SELECT event_type, {sql_stamp('to_timestamp((floor(epoch(ts) / 3600) + k) * 3600)::TIMESTAMP')} AS window_end, count(*) AS n FROM events, (SELECT unnest(range(1, 25)) AS k) GROUP BY 1, 2""",
)
def stream_live_counts(v):
    counts = jobs.collect_counts(jobs.live_counts(_events(v).select("event_type", "ts"), "event_type"), run_folder(v.spark, "live"), ["event_type", "window_end"])
    return counts.withColumn("window_end", stamp("window_end"))


@query("stream_late_days", f"SELECT event_type, {sql_stamp('ts::DATE')} AS day, count(*) AS n FROM events GROUP BY 1, 2")
def stream_late_days(v):
    counts = jobs.collect_counts(jobs.late_day_counts(_events(v).select("event_type", "ts"), "event_type"), run_folder(v.spark, "late"), ["event_type", "day"])
    return counts.withColumn("day", stamp("day"))


@query("stream_arrivals_once", "SELECT DISTINCT user_id * 100 + length(event_type) AS arrival FROM events")
def stream_arrivals_once(v):
    arrivals = _late_events(v).select((F.col("user_id") * 100 + F.char_length("event_type")).alias("arrival"), "ts")
    return jobs.arrivals_once(arrivals, run_folder(v.spark, "arrivals"), "arrival").select("arrival")


@query(
    "stream_feedback_once",
    """SELECT source_id, sum(CASE WHEN signal IN ('relevant', 'saved') THEN 1 WHEN signal IN ('not_relevant', 'less_like_this') THEN -1 ELSE 0 END)::BIGINT AS net
    FROM feedback f JOIN story_items s ON s.story_id = f.target_id JOIN items USING (item_id) GROUP BY 1""",
)
def stream_feedback_once(v):
    static = v.feedback().schema
    named = _events(v).select(
        F.col("event_id").alias("feedback_id"), F.lit("story").alias("target_type"), (F.col("event_id") % 997).alias("target_id"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("click", "relevant", "purchase", "saved", "error", "not_relevant", "signup", "less_like_this", "view", "opened")]), F.col("event_type")).alias("signal"),
        F.col("ts").alias("created_at"),
    )
    return jobs.feedback_once(named.select(*static.fieldNames()), run_folder(v.spark, "feedback"), v.story_items(), v.items())


@query("stream_daily_briefs", "SELECT strftime(ts, '%Y-%m-%d') AS day, arg_min('edition ' || lpad(event_id::VARCHAR, 12, '0'), (event_id % 3, event_id)) AS headline FROM events GROUP BY 1")
def stream_daily_briefs(v):
    editions = _late_events(v).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("edition "), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("headline"))
    return jobs.one_brief_a_day(editions, run_folder(v.spark, "briefs"))


def _vectors(v):
    """Items with vectors in the order of their time."""
    return _stream(v, v.vectors().select("item_id", "published_at", "embedding"), _in_turn(F.col("published_at")))


@query("stream_canonical_vectors", CANONICAL_VECTORS_SQL, VECTOR_VIEWS)
def stream_canonical_vectors(v):
    return linking.linked_stream(_vectors(v), run_folder(v.spark, "links"), dedup.Nearness(48, None, 0.35), keep_hours=24 * 365)


LATE_VECTORS = {
    # Files by number; what is in one file is taken in the order of time, near in both directions.
    "timeline": """MATERIALIZED SELECT row_number() OVER (ORDER BY item_id % 3, published_at, item_id) AS rn, item_id, epoch(published_at)::BIGINT AS tm, embedding::DOUBLE[] AS sig FROM vectors""",
    "kept_list": """SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, tm BIGINT, sig DOUBLE[])[] AS kept UNION ALL
        SELECT o.rn, CASE WHEN len(list_filter(kept, lambda c: abs(o.tm - c.tm) <= 172800 AND list_dot_product(c.sig, o.sig) >= 0.35)) > 0 THEN kept
        ELSE list_append(kept, {'id': o.item_id, 'tm': o.tm, 'sig': o.sig}) END FROM kept_list JOIN timeline o ON o.rn = kept_list.rn + 1""",
    "originals": "SELECT unnest(kept, recursive := true) FROM (SELECT kept FROM kept_list ORDER BY rn DESC LIMIT 1)",
}


@query(
    "stream_late_links",
    """SELECT t.item_id, arg_min(c.id, (c.id % 3 = t.item_id % 3, c.tm, c.id)) AS canonical_item_id FROM timeline t LEFT JOIN originals c
    ON t.item_id NOT IN (SELECT id FROM originals) AND (t.item_id % 3, t.tm, t.item_id) > (c.id % 3, c.tm, c.id) AND abs(t.tm - c.tm) <= 172800
    AND list_dot_product(c.sig, t.sig) >= 0.35 AND (c.id % 3 < t.item_id % 3 OR c.tm <= t.tm) GROUP BY t.item_id""",
    LATE_VECTORS,
)
def stream_late_links(v):
    """Files dealt out by number, so that most items come after later ones; every tenth comes twice."""
    vectors = v.vectors().select("item_id", "published_at", "embedding").withColumn("file", F.col("item_id") % PARTS)
    again = vectors.filter(F.col("item_id") % 10 == 0).withColumn("file", F.lit(PARTS - 1).cast("bigint"))
    stream = _stream(v, vectors.unionByName(again), F.col("file")).select("item_id", "published_at", "embedding")
    return linking.linked_stream(stream, run_folder(v.spark, "links"), dedup.Nearness(48, None, 0.35), keep_hours=24 * 365)


@query(
    "stream_closed_stories",
    f"""SELECT label AS story_id, {sql_stamp('min(published_at)')} AS first_seen_at, {sql_stamp('max(published_at)')} AS last_updated_at, count(*) AS n, round(list_sum(any_value(centroid)), 6) AS centroid_sum FROM (
        SELECT *, list_transform([1], lambda x: sum(s) OVER (PARTITION BY label, episode) / count(*) OVER (PARTITION BY label, episode)) AS centroid FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY label ORDER BY published_at, item_id) AS episode FROM (
        SELECT label, item_id, published_at, list_sum(embedding::DOUBLE[]) AS s,
        CASE WHEN published_at > lag(published_at) OVER (PARTITION BY label ORDER BY published_at, item_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM vectors)))
    GROUP BY label, episode HAVING max(published_at) + INTERVAL 6 HOUR < (SELECT max(published_at) FROM vectors) - INTERVAL 24 HOUR""",
)
def stream_closed_stories(v):
    """Labels as stories that close after six silent hours."""
    vectors = v.vectors().select(F.col("label").alias("story_id"), "item_id", "published_at", "embedding")
    closed = linking.closed_stories(_stream(v, vectors, _in_turn(F.col("published_at"))), run_folder(v.spark, "closed"), 6)
    total = F.round(F.aggregate("centroid", F.lit(0.0), lambda t, x: t + x), 6)
    return closed.select("story_id", stamp("first_seen_at").alias("first_seen_at"), stamp("last_updated_at").alias("last_updated_at"), "n", total.alias("centroid_sum"))


def _cluster_views() -> dict[str, str]:
    """The batches one after the other: items join the open stories of the batch before, the others lead
    or follow in the order of time, and stories move on."""
    views = {
        "arrivals": "MATERIALIZED SELECT item_id, epoch(published_at)::BIGINT AS tm, embedding::DOUBLE[] AS sig, least(2, date_diff('day', DATE '2024-01-01', published_at::DATE) // 10) AS part FROM vectors",
        "state0": "SELECT 0::BIGINT AS story_id, []::DOUBLE[] AS centroid, 0::BIGINT AS n, 0::BIGINT AS last WHERE false",
    }
    for b in range(PARTS):
        views |= {
            f"here{b}": f"SELECT * FROM arrivals WHERE part = {b}",
            f"found{b}": f"""MATERIALIZED SELECT item_id, arg_max(story_id, (cosine, -story_id)) AS story_id FROM (SELECT item_id, story_id, list_cosine_similarity(sig, centroid) AS cosine FROM here{b} h
                JOIN (SELECT * FROM state{b} WHERE last >= (SELECT min(tm) FROM here{b}) - 259200) s ON abs(h.tm - s.last) <= 259200) WHERE cosine >= 0.20 GROUP BY item_id HAVING max(cosine) >= 0.30""",
            f"line{b}": f"MATERIALIZED SELECT row_number() OVER (ORDER BY tm, item_id) AS rn, item_id, tm, sig FROM here{b} WHERE item_id NOT IN (SELECT item_id FROM found{b})",
            f"led{b}": f"""SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, tm BIGINT, sig DOUBLE[])[] AS kept UNION ALL
                SELECT o.rn, CASE WHEN len(list_filter(kept, lambda c: o.tm - c.tm <= 259200 AND list_dot_product(c.sig, o.sig) >= 0.30)) > 0 THEN kept
                ELSE list_append(kept, {{'id': o.item_id, 'tm': o.tm, 'sig': o.sig}}) END FROM led{b} JOIN line{b} o ON o.rn = led{b}.rn + 1""",
            f"leaders{b}": f"MATERIALIZED SELECT unnest(kept, recursive := true) FROM (SELECT kept FROM led{b} ORDER BY rn DESC LIMIT 1)",
            f"joined{b}": f"""MATERIALIZED SELECT item_id, story_id FROM found{b} UNION ALL
                SELECT t.item_id, ('0x' || substr(sha256('story ' || coalesce(arg_min(c.id, (c.tm, c.id)), t.item_id)), 1, 15))::BIGINT FROM line{b} t LEFT JOIN leaders{b} c ON t.item_id NOT IN (SELECT id FROM leaders{b})
                AND (t.tm, t.item_id) > (c.tm, c.id) AND t.tm - c.tm <= 259200 AND list_dot_product(c.sig, t.sig) >= 0.30 GROUP BY t.item_id""",
            f"added{b}": f"""MATERIALIZED SELECT story_id, list(x ORDER BY pos) AS total, any_value(k) AS k, any_value(last) AS last FROM (SELECT story_id, pos, sum(x) AS x, count(*) AS k, max(tm) AS last FROM (
                SELECT story_id, tm, unnest(sig) AS x, unnest(range(len(sig))) AS pos FROM joined{b} JOIN here{b} USING (item_id)) GROUP BY story_id, pos) GROUP BY story_id""",
            f"state{b + 1}": f"""MATERIALIZED SELECT story_id, CASE WHEN a.k IS NULL THEN s.centroid ELSE list_transform(list_zip(coalesce(s.centroid, list_transform(a.total, lambda x: 0.0)), a.total), lambda p: (p[1] * coalesce(s.n, 0) + p[2]) / (coalesce(s.n, 0) + a.k)) END AS centroid,
                coalesce(s.n, 0) + coalesce(a.k, 0) AS n, greatest(coalesce(s.last, 0), coalesce(a.last, 0)) AS last FROM state{b} s FULL JOIN added{b} a USING (story_id)""",
        }
    return views


@query("stream_clusters", " UNION ALL ".join(f"SELECT item_id, story_id FROM joined{b}" for b in range(PARTS)), _cluster_views())
def stream_clusters(v):
    none = v.spark.createDataFrame([], "item_id bigint, story_id bigint, same boolean")
    return jobs.clustered_stream(_vectors(v), run_folder(v.spark, "clusters"), none, 0.30, 0.20)


@query(
    "pending_retries",
    """SELECT item_id, CASE WHEN status = 'new' THEN 'waited' ELSE 'arrived' END AS origin FROM statuses WHERE status = 'new' OR item_id % 2 = 0""",
)
def pending_retries(v):
    """Every other item arrives again while items of a failed batch still wait."""
    waiting = v.statuses().select("item_id", F.lit("waited").alias("origin"), "status")
    arrived = v.items().filter("item_id % 2 = 0").select("item_id", F.lit("arrived").alias("origin"))
    return jobs.with_pending(arrived, waiting)


@query("written_briefs", "SELECT strftime(published_at, '%Y-%m-%d') AS day, 'items ' || count(*) AS content FROM items GROUP BY 1")
def written_briefs(v):
    """Editions written twice and read back: the second run replaces the days it has."""
    day = F.date_format("published_at", "yyyy-MM-dd").alias("day")
    folder = run_folder(v.spark, "editions")
    first = v.items().filter("item_id % 2 = 0").groupBy(day).agg(F.lit("draft").alias("content"))
    brief.write_briefs(first, folder)
    brief.write_briefs(v.items().groupBy(day).agg(F.concat(F.lit("items "), F.count("*").cast("string")).alias("content")), folder)
    return v.spark.read.schema("content string, day string").parquet(folder).select("day", "content")


@query("written_reading_list", "SELECT row_number() OVER (ORDER BY created_at DESC, entry_id) AS line, 'entry ' || entry_id AS block FROM reading_list")
def written_reading_list(v):
    """The exported list, read file by file in name order."""
    folder = run_folder(v.spark, "export")
    brief.write_reading_list(v.reading_list().select("entry_id", "created_at", F.concat(F.lit("entry "), F.col("entry_id").cast("string")).alias("block")), folder)
    lines = v.spark.read.option("wholetext", True).text(folder).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("pos", "block")).filter("block <> ''")
    return ordered.running_totals(lines, [], ["file", "pos"], {"line": F.lit(1).cast("bigint")}).select("line", "block")
