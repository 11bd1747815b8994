"""Queries over the brief, measures, questions, maintenance and search."""

from __future__ import annotations

from pyspark.sql import functions as F


from tidings.functions.stems import stem_sql
from tidings.operators import brief, items as it, measures as ms, questions as qs, search, stories as st
from tidings.plans.matching_queries import HIT_VIEWS, _hits
from tidings.plans.registry import query, six, sql_stamp, stamp
from tidings.plans.scalar_queries import CANONICAL_SQL
from tidings.plans.views import AS_OF

# --- brief -----------------------------------------------------------------------------------

BRIEF_VIEWS = {
    "ranked": """SELECT strftime(last_updated_at, '%Y-%m-%d') AS day, story_id, title, coalesce(summary, '') AS summary, tier, coalesce(n, 0) AS source_count FROM stories
        LEFT JOIN (SELECT story_id, count(*) AS n FROM story_items GROUP BY 1) USING (story_id) WHERE status = 'open' AND tier IS NOT NULL""",
    "sections": """SELECT day, section, row_number() OVER (PARTITION BY day ORDER BY tier, rank) - 1 AS position, story_id, title, summary FROM (
        SELECT *, ['critical', 'follow_up', 'worth_reading'][tier] AS section, row_number() OVER (PARTITION BY day, tier ORDER BY source_count DESC, story_id) AS rank FROM ranked)""",
    "named": "SELECT day, name AS topic, r.* EXCLUDE (day) FROM ranked r JOIN story_topics USING (story_id) JOIN topics USING (topic_id)",
    "busy": "SELECT day, topic, events, row_number() OVER (PARTITION BY day ORDER BY events DESC, best, topic) AS line FROM (SELECT day, topic, count(*) AS events, min((tier, -source_count, story_id)) AS best FROM named GROUP BY day, topic)",
    "options": "MATERIALIZED SELECT day, line, topic, events, list(story_id ORDER BY tier, source_count DESC, story_id) AS ids FROM named JOIN busy USING (day, topic) GROUP BY day, line, topic, events",
    "line_walk": """SELECT day, 0::BIGINT AS line, []::BIGINT[] AS used, NULL::BIGINT AS story_id, NULL::VARCHAR AS topic, NULL::BIGINT AS events FROM (SELECT DISTINCT day FROM options)
        UNION ALL SELECT o.day, o.line, list_append(used, coalesce(list_filter(o.ids, lambda x: NOT list_contains(used, x))[1], o.ids[1])),
        coalesce(list_filter(o.ids, lambda x: NOT list_contains(used, x))[1], o.ids[1]), o.topic, o.events FROM line_walk JOIN options o ON o.day = line_walk.day AND o.line = line_walk.line + 1""",
    "lines": "SELECT w.day, w.line, w.topic, w.story_id, s.title, w.events FROM line_walk w JOIN stories s USING (story_id) WHERE w.line > 0",
    "heads": """SELECT day, coalesce(h, 'Son 24 saatte takip ettiğin konularda yeni bir gelişme yok.') AS headline FROM (SELECT DISTINCT strftime(published_at, '%Y-%m-%d') AS day FROM items)
        LEFT JOIN (SELECT day, string_agg(topic || ': ' || title, ' · ' ORDER BY line) AS h FROM lines WHERE line <= 3 GROUP BY day) USING (day)""",
}


def _ranked(v):
    return brief.brief_stories(v.stories(), v.story_items())


def _lines(v):
    return brief.topic_lines(_ranked(v), v.story_topics(), v.topics())


def _heads(v):
    days = v.items().select(brief.day_of(F.col("published_at")).alias("day")).distinct()
    return brief.headlines(days, _lines(v))


@query("brief_sections", "SELECT * FROM sections", BRIEF_VIEWS)
def brief_sections(v):
    return brief.brief_sections(_ranked(v))


@query("brief_topic_counts", "SELECT day, topic, count(*) AS stories FROM named GROUP BY day, topic", BRIEF_VIEWS)
def brief_topic_counts(v):
    return brief.topic_counts(_ranked(v), v.story_topics(), v.topics())


@query("topic_lines", "SELECT * FROM lines", BRIEF_VIEWS)
def topic_lines(v):
    return _lines(v)


@query("headlines", "SELECT * FROM heads", BRIEF_VIEWS)
def headlines(v):
    return _heads(v)


@query(
    "brief_documents",
    """SELECT day, headline, coalesce(n, 0) AS stories, coalesce(l, 0) AS lines, coalesce(t, 0) AS topics FROM heads LEFT JOIN (SELECT day, count(*) AS n FROM sections GROUP BY day) USING (day)
    LEFT JOIN (SELECT day, count(*) AS l FROM lines GROUP BY day) USING (day) LEFT JOIN (SELECT day, count(DISTINCT topic) AS t FROM named GROUP BY day) USING (day) WHERE day >= '2024-01-03'""",
    BRIEF_VIEWS,
)
def brief_documents(v):
    """The JSON of every day, read back; the first two days have editions already."""
    existing = v.items().select(brief.day_of(F.col("published_at")).alias("day")).distinct().filter("day < '2024-01-03'")
    made = brief.brief_documents(brief.brief_sections(_ranked(v)), _lines(v), brief.topic_counts(_ranked(v), v.story_topics(), v.topics()), _heads(v), existing)
    size = lambda path: F.coalesce(F.json_array_length(F.get_json_object("content", path)), F.lit(0)).cast("bigint")
    return made.select("day", F.get_json_object("content", "$.headline").alias("headline"), size("$.sections").alias("stories"), size("$.topicLines").alias("lines"), size("$.topicCounts").alias("topics"))


@query(
    "brief_editions",
    """SELECT day, position, section, s.story_id, s.title, t.tier, coalesce(names, '') AS topics FROM sections s JOIN stories t USING (story_id)
    LEFT JOIN (SELECT story_id, string_agg(name, ', ' ORDER BY name) AS names FROM story_topics JOIN topics USING (topic_id) GROUP BY 1) USING (story_id)""",
    BRIEF_VIEWS,
)
def brief_editions(v):
    return brief.brief_by_edition(brief.brief_sections(_ranked(v)), v.stories(), v.story_topics(), v.topics()).withColumn("topics", F.array_join("topics", ", "))


@query(
    "brief_faults",
    """SELECT day, 'headline contains banned pattern: em/en dash' AS error FROM heads WHERE day LIKE '%5'
    UNION ALL SELECT day, 'section "critical" references unknown id ' || (story_id + 1000000) FROM sections WHERE section = 'critical' AND position = 0
    UNION ALL SELECT day, 'id ' || story_id || ' appears in more than one section' FROM sections WHERE section = 'follow_up'""",
    BRIEF_VIEWS,
)
def brief_faults(v):
    """Editions with dashes, ids that do not exist and repeated ids put in."""
    headline = _heads(v).withColumn("headline", F.when(F.endswith("day", F.lit("5")), F.concat("headline", F.lit(" — x"))).otherwise(F.regexp_replace("headline", "—|–", "-")))
    refs = brief.brief_sections(_ranked(v)).select("day", "section", F.col("story_id").alias("ref_id"), "position")
    broken = refs.filter("section = 'critical' and position = 0").withColumn("ref_id", F.col("ref_id") + 1_000_000)
    repeated = refs.filter("section = 'follow_up'").withColumn("section", F.lit("worth_reading"))
    every = refs.unionByName(broken).unionByName(repeated).drop("position")
    return brief.validate_briefs(headline, every, v.stories(), v.items().select("item_id"))


@query(
    "unused_research",
    """SELECT item_id FROM items WHERE language = 'en' AND item_id NOT IN (SELECT item_id FROM reading_list WHERE item_id IS NOT NULL)""",
)
def unused_research(v):
    research = v.items().select("item_id", "created_at", F.when(F.col("language") == "en", F.col("title")).alias("argument"))
    return brief.unused_research(research, v.reading_list().filter("item_id is not null")).select("item_id")


_FEED_SQL = """SELECT watch_id, item_id, title, url, coalesce(source_id, regexp_extract(url, '^https://www[.]([^/]+)', 1)) AS source, {stamp} AS created_at FROM (
    SELECT * FROM watch_items {where}) w JOIN linked_items USING (item_id)"""


@query("watch_page", _FEED_SQL.format(stamp=sql_stamp("created_at"), where=""))
def watch_page(v):
    return brief.watch_feed(v.watch_items(), v.linked_items()).withColumn("created_at", stamp("created_at"))


@query("watch_brief", _FEED_SQL.format(stamp=sql_stamp("created_at"), where="WHERE created_at >= TIMESTAMP '2024-01-29 12:00:00'"))
def watch_brief(v):
    return brief.watch_feed(v.watch_items(), v.linked_items(), since="2024-01-29 12:00:00").withColumn("created_at", stamp("created_at"))


@query("content_refs", "SELECT 'research_item' AS content_type, item_id AS ref_id FROM items WHERE language = 'en' UNION ALL SELECT 'watchlist_item', item_id FROM watch_items")
def content_refs(v):
    return brief.content_refs(v.items().filter("language = 'en'"), v.watch_items())


LIVE_VIEWS = {
    "counts": "SELECT story_id, count(DISTINCT source_id) AS sources FROM story_items JOIN items USING (item_id) GROUP BY 1",
    "live": f"""SELECT s.story_id, tier, coalesce(sources, 0) AS sources FROM (SELECT * FROM stories WHERE status = 'open' AND summary IS NOT NULL AND last_updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR) s LEFT JOIN counts USING (story_id)""",
}


def _live(v):
    return brief.live_stories(v.stories(), st.source_counts(v.story_items(), v.items(), v.sources()), AS_OF, hours=72)


@query("live_stories", "SELECT * FROM live", LIVE_VIEWS)
def live_stories(v):
    return _live(v).select("story_id", "tier", "sources")


_RUNS_SQL = "SELECT max(finished_at) FILTER (n = 1) AS a, max(finished_at) FILTER (n = 2) AS b FROM (SELECT *, row_number() OVER (ORDER BY finished_at DESC, run_id DESC) AS n FROM runs WHERE stage = 'click' AND finished_at IS NOT NULL)"


@query("last_two_runs", f"SELECT {sql_stamp('a')} AS last_updated_at, {sql_stamp('b')} AS fresh_since FROM ({_RUNS_SQL})")
def last_two_runs(v):
    return brief.last_two_runs(v.runs(), "click").select(stamp("last_updated_at").alias("last_updated_at"), stamp("fresh_since").alias("fresh_since"))


@query("story_freshness", f"SELECT story_id, CASE WHEN first_seen_at > b THEN 'New' WHEN last_updated_at > b THEN 'Updated' END AS label FROM stories, ({_RUNS_SQL})")
def story_freshness(v):
    return brief.story_freshness(v.stories(), v.runs(), "click")


@query("saved_stories", "SELECT story_id, title, story_id IN (SELECT story_id FROM reading_list WHERE story_id IS NOT NULL) AS saved FROM stories")
def saved_stories(v):
    return brief.saved_flags(v.stories().select("story_id", "title"), v.reading_list(), "story_id")


@query("latest_brief", "SELECT '2024-01-31' AS period_date, 'Son 24 saatte ' || count(*) || ' gelişme.' AS headline FROM live", LIVE_VIEWS)
def latest_brief(v):
    return brief.latest_brief(_heads(v), _live(v), AS_OF[:10])


@query("brief_history", "SELECT count(*) AS briefs, count(*) FILTER (day NOT LIKE '%0') AS sent, max(day) AS latest_day, CASE WHEN max(day) LIKE '%0' THEN 'ready' ELSE 'sent' END AS latest_status FROM heads", BRIEF_VIEWS)
def brief_history(v):
    return brief.brief_history(_heads(v).select("day", F.when(F.endswith("day", F.lit("0")), F.lit("ready")).otherwise(F.lit("sent")).alias("status")))


@query(
    "reading_list_feed",
    f"""SELECT entry_id, coalesce(s.title, l.title, '(untitled)') AS title, CASE WHEN s.title IS NOT NULL THEN '/story/' || r.story_id ELSE coalesce(url, '#') END AS href, is_read,
    {sql_stamp('created_at')} AS created_at FROM reading_list r LEFT JOIN stories s ON s.story_id = r.story_id LEFT JOIN linked_items l ON l.item_id = r.item_id""",
)
def reading_list_feed(v):
    return brief.reading_list_feed(v.reading_list(), v.stories(), v.linked_items()).withColumn("created_at", stamp("created_at"))


@query(
    "reading_list_markdown",
    """SELECT entry_id, array_to_string(list_filter(['## ' || coalesce(s.title, l.title, '(untitled)'), url, chr(10) || summary, CASE WHEN entry_id % 5 = 0 THEN chr(10) || 'Etiketler: a, b' END,
    CASE WHEN entry_id % 7 = 0 THEN chr(10) || 'Not: note ' || entry_id END, chr(10) || CASE WHEN is_read THEN 'Okundu' ELSE 'Okunmadı' END, chr(10) || '---' || chr(10)], lambda x: x IS NOT NULL), chr(10)) AS block
    FROM reading_list r LEFT JOIN stories s ON s.story_id = r.story_id LEFT JOIN linked_items l ON l.item_id = r.item_id""",
)
def reading_list_markdown(v):
    tags = F.when(F.col("entry_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    note = F.when(F.col("entry_id") % 7 == 0, F.concat(F.lit("note "), F.col("entry_id").cast("string")))
    return brief.reading_list_markdown(v.reading_list().withColumn("tags", tags).withColumn("notes", note), v.stories(), v.linked_items()).select("entry_id", "block")


# --- measures --------------------------------------------------------------------------------

COVERAGE_VIEWS = {
    "coverage": f"""SELECT topic_id, source_id, count(*) AS items FROM scores JOIN (SELECT item_id, source_id, coalesce(published_at, created_at) AS t FROM items) USING (item_id)
        WHERE t >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2"""
}


def _coverage(v):
    return ms.topic_source_coverage(v.scores(), v.items(), AS_OF)


@query("topic_source_coverage", "SELECT * FROM coverage", COVERAGE_VIEWS)
def topic_source_coverage(v):
    return _coverage(v)


@query(
    "topic_coverage",
    """SELECT topic_id, name AS topic, coalesce(n, 0) AS items, coalesce(s, 0) AS sources, CASE WHEN coalesce(s, 0) < 3 OR coalesce(n, 0) < 3 THEN 'Few articles: ' || coalesce(n, 0) || ' from ' || coalesce(s, 0)
    || CASE WHEN s = 1 THEN ' source' ELSE ' sources' END || ' in the last 7 days.' END AS warning FROM topics LEFT JOIN (
    SELECT topic_id, sum(items)::BIGINT AS n, count(DISTINCT source_id) AS s FROM coverage GROUP BY 1) USING (topic_id) WHERE active""",
    COVERAGE_VIEWS,
)
def topic_coverage(v):
    return ms.topic_coverage(v.topics(), _coverage(v))


@query(
    "keyword_coverage",
    """SELECT topic_id, name AS topic, coalesce(n, 0) AS items, coalesce(s, 0) AS sources, CASE WHEN coalesce(s, 0) < 3 OR coalesce(n, 0) < 3 THEN 'Few articles: ' || coalesce(n, 0) || ' from ' || coalesce(s, 0)
    || CASE WHEN s = 1 THEN ' source' ELSE ' sources' END || ' in the last 7 days.' END AS warning FROM topics LEFT JOIN (
    SELECT topic_id, count(*) AS n, count(DISTINCT source_id) AS s FROM hits JOIN items USING (item_id) WHERE published_at >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1) USING (topic_id) WHERE active""",
    HIT_VIEWS,
)
def keyword_coverage(v):
    """From texts to coverage warnings: keyword matches of the window's items, counted per topic."""
    return ms.topic_coverage(v.topics(), ms.topic_source_coverage(_hits(v), v.items(), AS_OF))


@query(
    "topic_precision",
    """SELECT topic_id, coalesce(sum(n), 0)::BIGINT AS sample, CASE WHEN sum(n) >= 5 THEN round(sum(g) / sum(n), 6) END AS precision FROM story_topics LEFT JOIN (
    SELECT target_id AS story_id, count(*) AS n, count(*) FILTER (signal IN ('relevant', 'saved')) AS g FROM feedback WHERE signal IN ('relevant', 'saved', 'not_relevant', 'less_like_this') GROUP BY 1) USING (story_id) GROUP BY topic_id""",
)
def topic_precision(v):
    return ms.topic_precision(v.feedback(), v.story_topics()).withColumn("precision", six("precision"))


NET_VIEWS = {
    "deltas": "SELECT *, CASE WHEN signal IN ('relevant', 'saved') THEN 1 WHEN signal IN ('not_relevant', 'less_like_this') THEN -1 ELSE 0 END AS d FROM feedback WHERE feedback_id % 3 <> 0",
    "net": """SELECT source_id, sum(d)::BIGINT AS net FROM (SELECT i.source_id, d FROM deltas JOIN story_items s ON s.story_id = target_id JOIN items i USING (item_id)
        UNION ALL SELECT 'src' || event_id % 20, 1 FROM events WHERE event_type = 'purchase') GROUP BY 1""",
}


def _feedback(v):
    """Story signals not applied yet, and one direct source signal per purchase."""
    applied = v.feedback().filter("feedback_id % 3 = 0")
    stories = ms.unapplied(v.feedback(), applied).withColumn("target_id", F.col("target_id").cast("string"))
    direct = v.events().filter("event_type = 'purchase'").select(
        F.col("event_id").alias("feedback_id"), F.lit("source").alias("target_type"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("target_id"),
        F.lit("more_from_this_source").alias("signal"), F.col("ts").alias("created_at"),
    )
    return stories.unionByName(direct)


def _net(v):
    links = v.story_items().withColumn("story_id", F.col("story_id").cast("string"))
    return ms.feedback_to_sources(_feedback(v), links, v.items())


@query("feedback_by_source", "SELECT * FROM net", NET_VIEWS)
def feedback_by_source(v):
    return _net(v)


@query(
    "drifted_weights",
    """SELECT source_id, old_weight, round(m, 2) AS new_weight FROM (SELECT source_id, weight::DOUBLE AS old_weight, greatest(0, least(1, weight::DOUBLE + greatest(-0.05, least(0.05, net * 0.01)))) AS m
    FROM sources JOIN net USING (source_id) WHERE NOT weight_locked AND net <> 0) WHERE m <> old_weight""",
    NET_VIEWS,
)
def drifted_weights(v):
    return ms.drifted_weights(v.sources(), _net(v))


@query(
    "reading_list_inserts",
    f"SELECT target_id AS story_id, {sql_stamp('min(created_at)')} AS created_at FROM feedback WHERE signal = 'saved' AND target_id NOT IN (SELECT story_id FROM reading_list WHERE story_id IS NOT NULL) GROUP BY 1",
)
def reading_list_inserts(v):
    return ms.reading_list_inserts(v.feedback(), v.reading_list()).withColumn("created_at", stamp("created_at"))


@query("muted_sources", "SELECT source_id, active AND source_id NOT IN (SELECT 'src' || event_id % 40 FROM events WHERE event_type = 'error') AS active FROM sources")
def muted_sources(v):
    muted = v.events().filter("event_type = 'error'").select(F.lit("source").alias("target_type"), F.concat(F.lit("src"), (F.col("event_id") % 40).cast("string")).alias("target_id"), F.lit("mute_source").alias("signal"))
    return ms.muted_sources(v.sources(), muted).select("source_id", "active")


NOON = "2024-01-30 12:00:00"


@query(
    "usage_totals",
    f"""SELECT count(*) FILTER (t) AS today_calls, round(coalesce(sum(cost_usd) FILTER (t), 0), 6) AS today_cost, count(*) FILTER (t AND NOT ok) AS today_failed, count(*) AS period_calls,
    round(sum(cost_usd), 6) AS period_cost, count(*) FILTER (NOT ok) AS period_failed FROM (SELECT *, created_at >= TIMESTAMP '2024-01-30 00:00:00' AS t FROM calls
    WHERE created_at >= TIMESTAMP '{NOON}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{NOON}')""",
)
def usage_totals(v):
    return ms.usage_totals(v.calls(), NOON).withColumn("today_cost", six("today_cost")).withColumn("period_cost", six("period_cost"))


@query("usage_by_stage", "SELECT coalesce(stage, prompt_name) AS stage, count(*) AS calls, round(sum(cost_usd), 6) AS cost FROM calls GROUP BY 1")
def usage_by_stage(v):
    return ms.usage_by_stage(v.calls()).withColumn("cost", six("cost"))


@query(
    "budget_left",
    "SELECT round(s, 6) AS spent, round(least(greatest(0, 50.0 - s), 20.0), 6) AS remaining FROM (SELECT coalesce(sum(cost_usd), 0) AS s FROM calls WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' AND created_at < TIMESTAMP '2024-01-31 00:00:00')",
)
def budget_left(v):
    return ms.budget_left(v.calls(), NOON, 50.0, 20.0).withColumn("spent", six("spent")).withColumn("remaining", six("remaining"))


@query(
    "budget_blocked",
    """SELECT call_id, round(b::DOUBLE, 6) AS spent_before, b >= 10 AS blocked FROM (SELECT call_id, coalesce(sum(cost_usd::DECIMAL(18,9)) OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY created_at, call_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM calls)""",
)
def budget_blocked(v):
    return ms.budget_blocked(v.calls(), 10.0).select("call_id", six("spent_before").alias("spent_before"), "blocked")


@query(
    "call_costs",
    "SELECT call_id, round((call_id % 5000 * p + call_id % 700 * 2 * p) / 1000000, 9) AS cost_usd FROM (SELECT call_id, CASE prompt_name WHEN 'prompt_click' THEN 1.0 WHEN 'prompt_view' THEN 2.5 WHEN 'prompt_error' THEN 4.0 END AS p FROM calls) WHERE p IS NOT NULL",
)
def call_costs(v):
    return _costed(v)[0].select("call_id", F.round("cost_usd", 9).alias("cost_usd"))


@query("call_rejects", "SELECT call_id, prompt_name AS model FROM calls WHERE prompt_name NOT IN ('prompt_click', 'prompt_view', 'prompt_error')")
def call_rejects(v):
    return _costed(v)[1].select("call_id", "model")


def _costed(v):
    calls = v.calls().select("call_id", F.col("prompt_name").alias("model"), (F.col("call_id") % 5000).alias("input_tokens"), (F.col("call_id") % 700).alias("output_tokens"))
    prices = v.spark.createDataFrame([("prompt_click", 1.0, 2.0), ("prompt_view", 2.5, 5.0), ("prompt_error", 4.0, 8.0)], "model string, input_price double, output_price double")
    return ms.call_costs(calls, prices)


@query(
    "call_log",
    "SELECT call_id, CASE WHEN ok THEN call_id % 5000 ELSE 0 END AS input_tokens, round(CASE WHEN ok THEN cost_usd ELSE 0 END, 6) AS cost_usd, CASE WHEN NOT ok THEN 630 END::BIGINT AS error_chars FROM calls",
)
def call_log(v):
    calls = v.calls().select(
        "*", F.col("prompt_name").alias("model"), (F.col("call_id") % 5000).alias("input_tokens"), (F.col("call_id") % 700).alias("output_tokens"), F.lit(5).alias("latency_ms"), F.repeat(F.lit("failed "), 90).alias("error")
    )
    return ms.call_log(calls).select("call_id", "input_tokens", six("cost_usd").alias("cost_usd"), F.char_length("error").cast("bigint").alias("error_chars"))


@query(
    "rate_windows",
    "SELECT event_id AS request_id, n AS hit_count, n <= 3 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(epoch(ts) / 9999) ORDER BY ts, event_id) AS n FROM events)",
)
def rate_windows(v):
    requests = v.events().select(F.col("event_id").alias("request_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("bucket"), "ts")
    return ms.rate_windows(requests, 9999, 3).select("request_id", "hit_count", "allowed")


HEALTH_VIEWS = {
    "fetch_log": "SELECT event_id AS fetch_id, 'src' || user_id % 50 AS source_id, ts AS fetched_at, event_type NOT IN ('error', 'click') AS ok, event_type = 'view' AS stale, CASE WHEN user_id % 50 <> 7 THEN 'https://x' END AS url, CASE WHEN user_id % 50 % 3 = 0 THEN 'sitemap' ELSE 'rss' END AS type FROM events",
    "health": """SELECT source_id, errors AS error_count, CASE WHEN source_id = 'src7' OR errors >= 3 THEN 'broken' WHEN errors > 0 OR coalesce(stale, false) THEN 'degraded' ELSE 'ok' END AS health_status FROM (
        SELECT f.source_id, count(*) FILTER (NOT f.ok AND (l.last IS NULL OR (f.fetched_at, f.fetch_id) > l.last)) AS errors, bool_or(f.stale AND f.type = 'rss') FILTER ((f.fetched_at, f.fetch_id) = l.last) AS stale
        FROM fetch_log f LEFT JOIN (SELECT source_id, max((fetched_at, fetch_id)) AS last FROM fetch_log WHERE ok GROUP BY 1) l USING (source_id) GROUP BY 1)""",
}


def _log(v):
    return v.events().select(
        F.col("event_id").alias("fetch_id"), F.concat(F.lit("src"), (F.col("user_id") % 50).cast("string")).alias("source_id"), F.col("ts").alias("at"), (~F.col("event_type").isin("error", "click")).alias("ok"), (F.col("event_type") == "view").alias("stale"),
        F.when(F.col("user_id") % 50 != 7, F.lit("https://x")).alias("url"), F.when(F.col("user_id") % 50 % 3 == 0, F.lit("sitemap")).otherwise(F.lit("rss")).alias("type"),
    )


@query("fetch_health", "SELECT * FROM health", HEALTH_VIEWS)
def fetch_health(v):
    return ms.fetch_health(_log(v))


@query(
    "health_summary",
    "SELECT count(*) AS total, count(*) FILTER (health_status = 'ok') AS ok, count(*) FILTER (health_status <> 'ok') AS failing FROM sources JOIN health USING (source_id) WHERE active",
    HEALTH_VIEWS,
)
def health_summary(v):
    return ms.source_health_summary(v.sources().join(ms.fetch_health(_log(v)), "source_id"))


@query("failing_sources", "SELECT source_id, health_status FROM sources JOIN health USING (source_id) WHERE active AND health_status <> 'ok'", HEALTH_VIEWS)
def failing_sources(v):
    return ms.failing_sources(v.sources().join(ms.fetch_health(_log(v)), "source_id"))


FEED_VIEWS = {
    "feed_entries": "SELECT source_id || '-' || language AS source_id, CASE WHEN item_id % 10 < 9 THEN published_at - to_days(CAST(length(source_id) * 4 AS INTEGER)) END AS published_at, CASE WHEN source_id <> 'src3' THEN 'u' END AS url FROM items",
}


def _entries(v):
    at = F.col("published_at") - F.make_dt_interval(F.char_length("source_id") * 4)
    return v.items().select(F.concat("source_id", F.lit("-"), "language").alias("source_id"), F.when(F.col("item_id") % 10 < 9, at).alias("published_at"), F.when(F.col("source_id") != "src3", F.lit("u")).alias("url"))


@query(
    "feed_states",
    f"SELECT source_id, count(url) AS entries, {sql_stamp('max(published_at)')} AS newest, count(url) = 0 OR coalesce(max(published_at) < TIMESTAMP '{AS_OF}' - INTERVAL 21 DAY, false) AS stale FROM feed_entries GROUP BY 1",
    FEED_VIEWS,
)
def feed_states(v):
    return ms.feed_state(_entries(v), AS_OF).withColumn("newest", stamp("newest"))


@query(
    "feed_windows",
    """SELECT source_id, entries, round(h, 6) AS hours, coalesce(h < 400, false) AS short FROM (SELECT source_id, count(url) AS entries,
    CASE WHEN count(published_at) > 1 THEN (epoch(max(published_at)) - epoch(min(published_at))) / 3600 END AS h FROM feed_entries GROUP BY 1)""",
    FEED_VIEWS,
)
def feed_windows(v):
    return ms.feed_window(_entries(v), 400).withColumn("hours", six("hours"))


CHECK_VIEWS = {
    **FEED_VIEWS,
    "checked": f"""SELECT source_id, entries, {sql_stamp('newest')} AS newest, CASE WHEN length(source_id) = 7 AND source_id LIKE '%7-%' THEN 'ROBOTS' WHEN source_id LIKE '%9-%' THEN 'FAIL' WHEN entries = 0 THEN 'EMPTY'
        WHEN newest < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'STALE' ELSE 'ok' END AS status FROM (SELECT source_id, count(url) AS entries, max(published_at) AS newest FROM feed_entries GROUP BY 1)""",
}


def _checked(v):
    name = F.col("source_id")
    checks = _entries(v).select("source_id").distinct().select(name, (~((F.char_length(name) == 7) & F.contains(name, F.lit("7-")))).alias("allowed"), F.when(F.contains(name, F.lit("9-")), F.lit("timeout")).alias("error"))
    return ms.feed_check(checks, _entries(v), AS_OF)


@query("feed_checks", "SELECT * FROM checked", CHECK_VIEWS)
def feed_checks(v):
    return _checked(v).withColumn("newest", stamp("newest"))


@query("feed_check_totals", "SELECT status, count(*) AS feeds, sum(entries)::BIGINT AS entries FROM checked GROUP BY ROLLUP (status)", CHECK_VIEWS)
def feed_check_totals(v):
    return ms.feed_check_totals(_checked(v))


RUN_VIEWS = {
    "fetches": """SELECT strftime(created_at, '%Y-%m-%d') AS run_id, source_id, count(*) AS fetched, count(*) FILTER (language = 'en' OR length(source_id) = 4) AS inserted, bool_or(item_id % 17 <> 0) AS ok, max(published_at) AS last_fetched_at
        FROM items GROUP BY 1, 2"""
}


def _fetches(v):
    new = (F.col("language") == "en") | (F.char_length("source_id") == 4)
    return v.items().groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("run_id"), "source_id").agg(
        F.count("*").alias("fetched"), F.count_if(new).alias("inserted"), F.bool_or(F.col("item_id") % 17 != 0).alias("ok"), F.max("published_at").alias("last_fetched_at")
    )


@query("gap_suspects", "SELECT run_id, source_id FROM fetches JOIN sources USING (source_id) WHERE type = 'rss' AND inserted >= 2 AND inserted = fetched", RUN_VIEWS)
def gap_suspects(v):
    return ms.gap_suspects(_fetches(v).join(v.sources().select("source_id", "type"), "source_id"), minimum=2).select("run_id", "source_id")


@query("run_summaries", "SELECT run_id, CASE WHEN bool_and(ok) THEN 'ok' ELSE 'partial' END AS status, count(*) AS sources, sum(inserted)::BIGINT AS inserted, count(*) FILTER (NOT ok) AS failed FROM fetches GROUP BY 1", RUN_VIEWS)
def run_summaries(v):
    return ms.run_summary(_fetches(v)).drop("stats")


@query(
    "source_gaps",
    """SELECT coalesce(e.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'not in system' WHEN NOT s.active THEN 'muted' ELSE s.health_status END AS status,
    CASE WHEN e.name IS NOT NULL THEN 'blocked ' || e.name WHEN NOT s.active THEN 'Muted on this page.' WHEN s.health_status = 'degraded' THEN 'Recent fetches failed or the feed has gone quiet.' ELSE 'Fetches keep failing.' END AS reason,
    CASE WHEN e.name IS NOT NULL THEN 'ask for a licence' WHEN NOT s.active THEN 'Activate below' ELSE 'Last data ' || strftime(s.seen, '%d/%m/%Y') END AS option
    FROM (SELECT DISTINCT 'src' || doc_id % 47 AS name FROM documents WHERE doc_id % 47 % 6 = 0) e FULL JOIN
    (SELECT source_id AS name, active, health_status, seen FROM sources JOIN health USING (source_id) JOIN (SELECT source_id, max(created_at) AS seen FROM items GROUP BY 1) USING (source_id)) s ON s.name = e.name
    WHERE s.name IS NULL OR NOT s.active OR s.health_status <> 'ok'""",
    HEALTH_VIEWS,
)
def source_gaps(v):
    number = F.col("doc_id") % 47
    excluded = v.table("documents").filter(number % 6 == 0).select(F.concat(F.lit("src"), number.cast("string")).alias("name")).distinct()
    excluded = excluded.select("name", F.concat(F.lit("blocked "), "name").alias("reason"), F.lit("ask for a licence").alias("option"))
    seen = v.items().groupBy("source_id").agg(F.max("created_at").alias("last_fetched_at"))
    sources = v.sources().join(ms.fetch_health(_log(v)), "source_id").join(seen, "source_id").withColumnRenamed("source_id", "name")
    return ms.source_gaps(excluded, sources)


# --- questions -------------------------------------------------------------------------------


@query(
    "open_story_counts",
    """SELECT question_id, (SELECT count(*) FROM stories WHERE status = 'open' AND summary IS NOT NULL) - coalesce(d, 0) AS open_stories FROM questions LEFT JOIN (
    SELECT question_id, count(DISTINCT story_id) AS d FROM evidence JOIN stories USING (story_id) WHERE status = 'open' AND summary IS NOT NULL GROUP BY 1) USING (question_id) WHERE active""",
)
def open_story_counts(v):
    return qs.open_pair_counts(v.questions(), v.stories(), v.evidence())


@query("stories_to_judge", "SELECT 0::BIGINT AS question_id, story_id FROM stories WHERE status = 'open' AND summary IS NOT NULL AND story_id NOT IN (SELECT story_id FROM evidence WHERE question_id = 0)")
def stories_to_judge(v):
    return qs.stories_to_judge(0, v.stories(), v.evidence()).withColumn("question_id", F.col("question_id").cast("bigint"))


@query("evidence_rows", "SELECT question_id, turn, relevant, CASE WHEN relevant THEN stance END AS stance, CASE WHEN relevant THEN note END AS note FROM evidence")
def evidence_rows(v):
    return qs.evidence_rows(v.evidence()).select("question_id", "turn", "relevant", "stance", "note")


@query("evidence_counts", "SELECT question_id, count(*) FILTER (relevant) AS evidence FROM questions LEFT JOIN evidence USING (question_id) GROUP BY 1")
def evidence_counts(v):
    return qs.evidence_counts(v.questions(), v.evidence())


UPDATE_VIEWS = {
    "updates": """SELECT question_id, turn, CASE WHEN turn = 1 THEN 'initial' ELSE 'weekly' END AS update_type, CASE WHEN question_id % 5 = 0 THEN DATE '2024-01-22' ELSE DATE '2024-01-15' END AS period_start,
        CASE WHEN question_id % 5 = 0 THEN DATE '2024-01-28' ELSE DATE '2024-01-21' END AS period_end, created_at FROM evidence"""
}


def _updates(v):
    week = lambda a, b: F.when(F.col("question_id") % 5 == 0, F.lit(a)).otherwise(F.lit(b)).cast("date")
    return v.evidence().select(
        "question_id", "turn", F.when(F.col("turn") == 1, F.lit("initial")).otherwise(F.lit("weekly")).alias("update_type"),
        week("2024-01-22", "2024-01-15").alias("period_start"), week("2024-01-28", "2024-01-21").alias("period_end"), "created_at",
    )


@query("latest_updates", f"SELECT question_id, {sql_stamp('max(created_at)')} AS last_update FROM updates GROUP BY 1", UPDATE_VIEWS)
def latest_updates(v):
    return qs.latest_updates(_updates(v)).withColumn("last_update", stamp("last_update"))


@query("first_assessments", "SELECT question_id, turn FROM updates WHERE update_type = 'initial' QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at) = 1", UPDATE_VIEWS)
def first_assessments(v):
    return qs.first_assessments(_updates(v)).select("question_id", "turn")


@query(
    "weekly_evidence",
    """SELECT question_id, e.stance, e.note, e.story_id, CASE WHEN e.note IS NULL THEN 'Bu hafta bu soruyla ilgili yeni kanıt kaydedilmedi. Soru aktif olarak izlenmeye devam ediyor.' END AS text
    FROM questions q LEFT JOIN (SELECT * FROM evidence WHERE relevant AND created_at >= TIMESTAMP '2024-01-22 00:00:00' AND created_at < TIMESTAMP '2024-01-29 00:00:00') e USING (question_id)
    WHERE active AND question_id NOT IN (SELECT question_id FROM updates WHERE update_type = 'weekly' AND period_start = DATE '2024-01-22' AND period_end = DATE '2024-01-28')""",
    UPDATE_VIEWS,
)
def weekly_evidence(v):
    return qs.weekly_evidence(v.questions(), v.evidence(), _updates(v), "2024-01-28").drop("period_start", "period_end")


@query(
    "question_histories",
    """SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, turn) AS pos, stance, note, title AS story_title FROM evidence LEFT JOIN stories USING (story_id)
    WHERE relevant AND question_id IN (SELECT question_id FROM questions)""",
)
def question_histories(v):
    return qs.question_history(v.questions(), v.evidence(), v.stories())


@query(
    "question_widget",
    """SELECT question_id, q.text, coalesce(note, 'No new evidence was linked to this edition yet.') AS note, story_id FROM (SELECT * FROM questions WHERE active) q
    LEFT JOIN (SELECT * FROM (SELECT * FROM evidence WHERE note IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY created_at DESC, turn DESC) = 1) WHERE story_id IN (SELECT story_id FROM stories)) e USING (question_id)
    ORDER BY note IS NULL, updated_at DESC, question_id LIMIT 1""",
)
def question_widget(v):
    return qs.question_widget(v.questions(), v.evidence(), v.stories())


@query("valid_citations", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS citations FROM items")
def valid_citations(v):
    entry = F.concat(F.lit('{"index": 1, "id": "'), F.col("item_id").cast("string"), F.lit('", "title": "t", "url": "https://example.org/a"}'))
    bad = F.lit('{"index": 2, "id": "x", "title": "t", "url": "javascript:alert(1)"}, {"id": "y", "url": "https://example.org"}')
    kind = F.col("item_id") % 4
    listed = F.when(kind == 0, F.concat(F.lit("["), entry, F.lit(","), entry, F.lit("]"))).when(kind == 1, F.concat(F.lit("["), entry, F.lit(","), bad, F.lit("]"))).when(kind == 2, F.concat(F.lit("["), bad, F.lit("]"))).otherwise(F.lit("none"))
    return v.items().select("item_id", F.coalesce(F.size(qs.valid_citations(listed)), F.lit(0)).cast("bigint").alias("citations"))


# --- arrivals and maintenance ----------------------------------------------------------------

PAGE_VIEWS = {"page_urls": CANONICAL_SQL, "page_stored": "SELECT DISTINCT canonical_url FROM page_urls JOIN labels ON doc_id = page_id WHERE quality = 1"}


def _stored_pages(v):
    from tidings.functions import urls

    good = v.table("labels").filter("quality = 1").select(F.col("doc_id").alias("page_id"))
    return v.pages().join(good, "page_id", "left_semi").select(urls.canonical_url(F.col("url")).alias("canonical_url")).distinct()


@query("known_urls", "SELECT page_id FROM page_urls WHERE canonical_url IN (SELECT canonical_url FROM page_stored)", PAGE_VIEWS)
def known_urls(v):
    return it.known_urls(v.pages().select("page_id", "url"), _stored_pages(v)).select("page_id")


@query(
    "new_items",
    f"""SELECT canonical_url, min(page_id) AS page_id, CASE WHEN min(page_id) * 7 % 30 >= 7 THEN 'not_relevant' ELSE 'new' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id) AS n
    FROM (SELECT *, split_part(canonical_url, '/', 3)[-4:] AS h FROM page_urls)) WHERE page_id % 13 <> 0 AND canonical_url NOT IN (SELECT canonical_url FROM page_stored) GROUP BY 1""",
    PAGE_VIEWS,
)
def new_items(v):
    """Pages as one run's arrivals per top-level domain; some come without a title."""
    from tidings.functions import urls

    at = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("page_id") * 7 % 30).cast("int"), F.lit(1))
    arrived = v.pages().select(
        F.substring(urls.host(F.col("url")), -4, 4).alias("source_id"), F.col("page_id").alias("pos"), "url", F.when(F.col("page_id") % 13 != 0, F.lit("t")).alias("title"), at.alias("published_at"), "page_id"
    )
    one = it.first_wins(arrived.withColumn("source_id", F.col("source_id")), ["page_id"], F.col("pos"))
    return it.new_items(one, _stored_pages(v), AS_OF).select("canonical_url", "page_id", "status")


@query("research_links", "SELECT p.page_id AS item_id, w.last AS work_id FROM page_urls p JOIN (SELECT canonical_url, max(page_id) AS last FROM page_urls GROUP BY 1) w USING (canonical_url)", PAGE_VIEWS)
def research_links(v):
    from tidings.functions import urls

    inserted = v.pages().select(F.col("page_id").alias("item_id"), urls.canonical_url(F.col("url")).alias("canonical_url"))
    works = v.pages().select("url", F.col("page_id").alias("pos"), F.col("page_id").alias("work_id"), F.lit(None).cast("string").alias("doi"), F.lit("j").alias("journal"), F.array().cast("array<string>").alias("authors"))
    return it.research_links(inserted, works).select("item_id", "work_id")


@query("upserted_scores", "SELECT item_id, topic_id, coalesce(new_score, score) AS score FROM (SELECT item_id, topic_id, s.score, CASE WHEN picked THEN 7 END AS new_score FROM scores s FULL JOIN verdicts v USING (item_id, topic_id)) WHERE coalesce(new_score, score) IS NOT NULL")
def upserted_scores(v):
    changes = v.verdicts().filter("picked").select("item_id", "topic_id", F.lit(7).cast("bigint").alias("score"))
    return it.upsert_last(v.scores().select("item_id", "topic_id", "score"), changes, ["item_id", "topic_id"])


_OLD = f"status = 'not_relevant' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND item_id NOT IN (SELECT item_id FROM reading_list WHERE item_id IS NOT NULL) AND item_id NOT IN (SELECT item_id FROM watch_items)"


@query("purge_candidates", f"SELECT item_id FROM statuses WHERE {_OLD}")
def purge_candidates(v):
    return it.purge_candidates(v.statuses(), v.reading_list(), v.watch_items(), AS_OF, 10).select("item_id")


@query("retained_items", f"SELECT item_id, status FROM statuses WHERE NOT ({_OLD})")
def retained_items(v):
    return it.retained(v.statuses(), v.reading_list(), v.watch_items(), AS_OF, 10).select("item_id", "status")


@query("closed_backlog", f"SELECT item_id, CASE WHEN status IN ('new', 'extracted', 'embedded') AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY THEN 'not_relevant' ELSE status END AS status FROM statuses")
def closed_backlog(v):
    return it.close_backlog(v.statuses(), AS_OF).select("item_id", "status")


# --- search ----------------------------------------------------------------------------------

# Search texts over the documents' words, with words that must not occur,
# alternatives and a phrase.
SEARCHES = ((0, "attion"), (1, "the and"), (2, "erble or nicht"), (3, "de -les"), (4, '"de les"'), (5, "the \"and that\" or mente"), (6, "zzyzx"))


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def _search_views(body: str, prefix: str) -> dict[str, str]:
    return {
        f"{prefix}_words": f"SELECT item_id, word, pos FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {_words_sql(body)} AS w FROM items))",
        f"{prefix}_hits": f"SELECT query_id, item_id, word, list(pos ORDER BY pos) AS ps FROM {prefix}_words JOIN asked USING (word) GROUP BY 1, 2, 3",
        f"{prefix}_any": f"SELECT query_id, item_id, sum(s) / 1.64493406685 / any_value(n) AS rank FROM (SELECT query_id, item_id, (SELECT count(*) FROM asked a WHERE a.query_id = h.query_id) AS n, list_sum(list_transform(ps, lambda p, i: 0.1 / (i * i))) AS s FROM {prefix}_hits h) GROUP BY 1, 2",
        f"{prefix}_near": f"""SELECT query_id, item_id, 1 - product(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(abs(p - q) / 1.5 - 2)))) AS rank FROM (
            SELECT a.query_id, a.item_id, a.pos AS p, b.pos AS q FROM (SELECT * FROM {prefix}_words JOIN asked USING (word)) a JOIN (SELECT * FROM {prefix}_words JOIN asked USING (word)) b
            ON a.query_id = b.query_id AND a.item_id = b.item_id AND a.word < b.word AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 100) GROUP BY 1, 2""",
        f"{prefix}_flags": f"""SELECT query_id, item_id, bool_or(word = 'attion') AS attion, bool_or(word = 'the') AS the, bool_or(word = 'and') AS a_nd, bool_or(word = 'erble') AS erble, bool_or(word = 'nicht') AS nicht, bool_or(word = 'de') AS de,
            bool_or(word = 'les') AS les, bool_or(word = 'mente') AS mente, bool_or(word = 'that') AS that FROM {prefix}_hits GROUP BY 1, 2""",
        f"{prefix}_pairs": f"SELECT DISTINCT a.item_id, a.word || ' ' || b.word AS pair FROM {prefix}_words a JOIN {prefix}_words b ON a.item_id = b.item_id AND b.pos = a.pos + 1 WHERE (a.word = 'de' AND b.word = 'les') OR (a.word = 'and' AND b.word = 'that')",
        f"{prefix}_ranks": f"""SELECT f.query_id, f.item_id, CASE WHEN f.query_id IN (1, 3, 4) THEN coalesce(r.rank, 0) ELSE o.rank END AS rank,
            CASE f.query_id WHEN 0 THEN attion WHEN 1 THEN the AND a_nd WHEN 2 THEN erble OR nicht WHEN 3 THEN de AND NOT les WHEN 4 THEN (f.item_id, 'de les') IN (SELECT (item_id, pair) FROM {prefix}_pairs)
            WHEN 5 THEN (the AND (f.item_id, 'and that') IN (SELECT (item_id, pair) FROM {prefix}_pairs)) OR mente ELSE false END AS matched
            FROM {prefix}_flags f JOIN {prefix}_any o USING (query_id, item_id) LEFT JOIN {prefix}_near r USING (query_id, item_id)""",
    }


SEARCH_VIEWS = {
    "asked": "SELECT * FROM (VALUES (0::BIGINT, 'attion'), (1, 'the'), (1, 'and'), (2, 'erble'), (2, 'nicht'), (3, 'de'), (3, 'les'), (4, 'de'), (4, 'les'), (5, 'the'), (5, 'and'), (5, 'that'), (5, 'mente'), (6, 'zzyzx')) t(query_id, word)",
    **_search_views("title || ' ' || text", "long"),
    **_search_views("title", "brief"),
    "best_ranks": "SELECT query_id, item_id, max(rank) AS rank, bool_or(matched) AS matched FROM (SELECT * FROM long_ranks UNION ALL SELECT * FROM brief_ranks) GROUP BY 1, 2",
    "scored": """SELECT query_id, item_id, 0.6 * coalesce(cosine, 0) + 0.4 * coalesce(rank, 0) AS score FROM (SELECT q.topic_id AS query_id, v.item_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding) AS cosine
        FROM (SELECT * FROM topic_vectors WHERE topic_id < 6) q, vectors v WHERE v.item_id IN (SELECT item_id FROM items)) c FULL JOIN best_ranks r USING (query_id, item_id) WHERE cosine IS NOT NULL OR matched""",
    "top_results": "SELECT query_id, rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM scored) WHERE rank <= 15",
}


def _searches(v):
    return v.spark.createDataFrame(list(SEARCHES), "query_id bigint, text string")


def _results(v):
    vectors = v.topic_vectors().filter("topic_id < 6").select(F.col("topic_id").alias("query_id"), "embedding")
    items = v.items().select("item_id", "title", "text", F.lit(None).cast("string").alias("standfirst")).join(v.vectors().select("item_id", "embedding"), "item_id", "left")
    return search.hybrid_search(items, _searches(v).join(vectors, "query_id", "left"), 15)


@query("word_counts", f"SELECT word, count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest({_words_sql('''title || ' ' || text''')}) AS word FROM items) GROUP BY word")
def word_counts(v):
    positions = search.word_positions(v.items().select("item_id", F.concat_ws(" ", "title", "text").alias("body")))
    per_item = positions.groupBy("word", "item_id").agg(F.count("*").alias("n"))
    return per_item.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("items"))


STEMS = stem_sql("word", "language")


@query(
    "stem_counts",
    f"""SELECT language, stem, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT item_id) AS items, count(DISTINCT word) AS words FROM (SELECT language, item_id, word, n, {STEMS} AS stem FROM (
    SELECT language, item_id, word, count(*) AS n FROM (SELECT language, item_id, unnest({_words_sql("title || ' ' || text")}) AS word FROM items) GROUP BY ALL)) GROUP BY language, stem""",
)
def stem_counts(v):
    """Words of title and text by their stems in the item's language."""
    return search.stem_counts(v.items().select("item_id", "language", F.concat_ws(" ", "title", "text").alias("body")))


@query("text_ranks", "SELECT query_id, item_id, matched, round(rank, 6) AS rank FROM long_ranks", SEARCH_VIEWS)
def text_ranks(v):
    docs = v.items().select("item_id", F.concat_ws(" ", "title", "text").alias("body"))
    return search.text_ranks(docs, _searches(v)).withColumn("rank", six("rank"))


@query("hybrid_search", "SELECT query_id, rank, item_id, round(score, 6) AS score FROM top_results", SEARCH_VIEWS)
def hybrid_search(v):
    return _results(v).withColumn("score", six("score"))


TITLE_SEARCHES = {
    "asked": f"SELECT DISTINCT item_id AS query_id, word FROM (SELECT item_id, unnest({_words_sql('title')}) AS word FROM items WHERE item_id % 20 = 0) WHERE word <> 'or'",
    "sizes": "SELECT query_id, count(*) AS n FROM asked GROUP BY query_id",
    "spots": f"SELECT item_id, word, pos FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {_words_sql("title || ' ' || text")} AS w FROM items)) WHERE word IN (SELECT word FROM asked)",
    "short_spots": f"SELECT item_id, word, pos FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {_words_sql("title || ' ' || source_id")} AS w FROM items)) WHERE word IN (SELECT word FROM asked)",
    "both_spots": "SELECT 0 AS kind, * FROM spots UNION ALL SELECT 1, * FROM short_spots",
    "hits": "SELECT query_id, kind, item_id, word, count(*) AS c FROM both_spots JOIN asked USING (word) GROUP BY ALL",
    "singles": "SELECT query_id, kind, item_id, any_value(n) AS n, count(*) AS held, sum(list_sum(list_transform(range(1, c + 1), lambda i: 0.1 / (i * i)))) / 1.64493406685 / any_value(n) AS rank FROM hits JOIN sizes USING (query_id) GROUP BY query_id, kind, item_id",
    "pairs": """SELECT query_id, kind, item_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(gap / 1.5 - 2)))))) AS rank FROM (
        SELECT x.query_id, a.kind, a.item_id, abs(a.pos - b.pos) AS gap FROM both_spots a JOIN both_spots b ON a.kind = b.kind AND a.item_id = b.item_id AND a.word < b.word AND abs(a.pos - b.pos) <= 100
        JOIN asked x ON x.word = a.word JOIN asked y ON y.word = b.word AND y.query_id = x.query_id) GROUP BY query_id, kind, item_id""",
    "word_ranks": """SELECT query_id, item_id, max(CASE WHEN n = 1 THEN s.rank ELSE coalesce(p.rank, 0) END) AS rank, bool_or(held = n) AS matched
        FROM singles s LEFT JOIN pairs p USING (query_id, kind, item_id) GROUP BY query_id, item_id""",
    "title_scores": """SELECT query_id, item_id, 0.6 * coalesce(cosine, 0) + 0.4 * coalesce(rank, 0) AS score FROM (SELECT q.item_id AS query_id, v.item_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS cosine
        FROM vectors q, vectors v WHERE q.item_id % 20 = 0 AND q.item_id IN (SELECT item_id FROM items) AND v.item_id IN (SELECT item_id FROM items)) c FULL JOIN word_ranks r USING (query_id, item_id) WHERE cosine IS NOT NULL OR matched""",
}


@query(
    "title_searches",
    """SELECT query_id, rank, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM title_scores) WHERE rank <= 15""",
    TITLE_SEARCHES,
)
def title_searches(v):
    """Every twentieth title as a search over all items, with the source as a summary."""
    vectors = v.vectors().select("item_id", "embedding")
    items = v.items().select("item_id", "title", "text", F.col("source_id").alias("standfirst")).join(vectors, "item_id", "left")
    plain = F.array_join(F.filter(search.words(F.col("title")), lambda w: w != "or"), " ")
    asked = items.filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), plain.alias("text"), "embedding")
    return search.hybrid_search(items, asked, 15).withColumn("score", six("score"))


@query("ask_candidates", "SELECT query_id, rank, item_id FROM top_results WHERE score >= 0.2", SEARCH_VIEWS)
def ask_candidates(v):
    return search.ask_candidates(_results(v), 0.2).select("query_id", "rank", "item_id")


@query("cited_items", "SELECT query_id, rank, item_id FROM top_results WHERE query_id % 2 = 0 AND rank IN (1, 3)", SEARCH_VIEWS)
def cited_items(v):
    answers = _searches(v).select("query_id", (F.col("query_id") % 2 == 0).alias("has_evidence"), F.array(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"), F.lit(40).cast("bigint"), F.lit(3).cast("bigint")).alias("indices"))
    return qs.cited_items(answers, _results(v))


@query(
    "faceted_items",
    """SELECT item_id FROM items JOIN sources USING (source_id) WHERE language = 'en' AND perspective_group = 'g1' AND published_at >= TIMESTAMP '2024-01-05 00:00:00' AND published_at <= TIMESTAMP '2024-01-25 00:00:00'
    AND item_id IN (SELECT item_id FROM scores WHERE topic_id = 3)""",
)
def faceted_items(v):
    return search.search_filters(v.items(), v.sources(), v.scores(), topic_id=3, language="en", perspective_group="g1", date_from="2024-01-05", date_to="2024-01-25").select("item_id")


@query(
    "similar_titles",
    """SELECT query_id, item_id, round(c / (n + m - c), 6) AS similarity FROM (SELECT a.item_id AS query_id, b.item_id, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM sized a JOIN sized b USING (gram)
    WHERE a.item_id IN (SELECT item_id FROM asked_titles) GROUP BY 1, 2) WHERE c / (n + m - c) >= 0.5""",
    {
        "asked_titles": "SELECT min(item_id) AS item_id FROM items GROUP BY source_id",
        "grams": f"SELECT DISTINCT item_id, substr('  ' || w || ' ', i, 3) AS gram FROM (SELECT item_id, w, unnest(range(1, CAST(length(w) AS BIGINT) + 2)) AS i FROM (SELECT item_id, unnest({_words_sql('title')}) AS w FROM items))",
        "sized": "SELECT item_id, gram, count(*) OVER (PARTITION BY item_id) AS n FROM grams",
    },
)
def similar_titles(v):
    first = v.items().groupBy("source_id").agg(F.min("item_id").alias("item_id")).join(v.items().select("item_id", "title"), "item_id")
    return search.title_similarity(v.items(), first.select(F.col("item_id").alias("query_id"), F.col("title").alias("text")), 0.5).withColumn("similarity", six("similarity"))
