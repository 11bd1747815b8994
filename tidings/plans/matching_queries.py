"""Queries over near duplicates, topic matching, relevance and stories."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tidings.functions import text as tx
from tidings.operators import dedup, fingerprint, handoff, match, measures, ordered, rematch, similarity, stories as st
from tidings.plans.registry import query, six, sql_stamp, stamp
from tidings.plans.scalar_queries import SIMHASH_VIEWS
from tidings.plans.views import AS_OF, TOPICS
from tidings.session import checkpointed

# --- near duplicates -------------------------------------------------------------------------


def _greedy(near: str, hours: int) -> dict[str, str]:
    """One item after the other in time order, kept when no kept item of the window is near."""
    return {
        "kept_list": f"""SELECT 0::BIGINT AS rn, []::STRUCT(id BIGINT, tm BIGINT, sig {{sig}})[] AS kept UNION ALL
            SELECT o.rn, CASE WHEN len(list_filter(kept, lambda c: o.tm - c.tm <= {hours * 3600} AND {near})) > 0 THEN kept
            ELSE list_append(kept, {{{{'id': o.item_id, 'tm': o.tm, 'sig': o.sig}}}}) END
            FROM kept_list JOIN timeline o ON o.rn = kept_list.rn + 1""",
        "originals": "SELECT unnest(kept, recursive := true) FROM (SELECT kept FROM kept_list ORDER BY rn DESC LIMIT 1)",
    }


def _greedy_views(sig: str, near: str, hours: int, source: str) -> dict[str, str]:
    timeline = f"MATERIALIZED SELECT row_number() OVER (ORDER BY published_at, item_id) AS rn, item_id, epoch(published_at)::BIGINT AS tm, sig FROM ({source})"
    return {"timeline": timeline, **{k: v.format(sig=sig) for k, v in _greedy(near, hours).items()}}


HASH_NEAR = "bit_count(xor(c.sig, o.sig)) <= 3"
HASH_VIEWS = {**SIMHASH_VIEWS, **_greedy_views("BIGINT", HASH_NEAR, 48, "SELECT items.item_id, published_at, simhash AS sig FROM items JOIN fingerprints USING (item_id)")}


@query(
    "canonical_items",
    f"""SELECT t.item_id, arg_min(c.id, (c.tm, c.id)) AS canonical_item_id FROM timeline t LEFT JOIN originals c
    ON t.item_id NOT IN (SELECT id FROM originals) AND (t.tm, t.item_id) > (c.tm, c.id) AND t.tm - c.tm <= 172800 AND {HASH_NEAR.replace('o.sig', 't.sig')} GROUP BY t.item_id""",
    HASH_VIEWS,
)
def canonical_items(v):
    items = fingerprint.item_fingerprints(v.items(), keep=("published_at",))
    return dedup.canonical_items(items, dedup.Nearness(48, 3, None))


VECTOR_NEAR = "list_dot_product(c.sig, o.sig) >= 0.35"
VECTOR_VIEWS = _greedy_views("DOUBLE[]", VECTOR_NEAR, 48, "SELECT item_id, published_at, embedding::DOUBLE[] AS sig FROM vectors")


CANONICAL_VECTORS_SQL = f"""SELECT t.item_id, arg_min(c.id, (c.tm, c.id)) AS canonical_item_id FROM timeline t LEFT JOIN originals c
    ON t.item_id NOT IN (SELECT id FROM originals) AND (t.tm, t.item_id) > (c.tm, c.id) AND t.tm - c.tm <= 172800 AND {VECTOR_NEAR.replace('o.sig', 't.sig')} GROUP BY t.item_id"""


@query("canonical_vectors", CANONICAL_VECTORS_SQL, VECTOR_VIEWS)
def canonical_vectors(v):
    return dedup.canonical_items(v.vectors().select("item_id", "published_at", "embedding"), dedup.Nearness(48, None, 0.35))


@query(
    "canonical_matches",
    f"""SELECT t.item_id, arg_min(c.id, (c.tm, c.id)) AS canonical_item_id FROM timeline t JOIN originals c ON t.item_id <> c.id
    AND abs(t.tm - c.tm) <= 172800 AND {HASH_NEAR.replace('o.sig', 't.sig')} GROUP BY t.item_id""",
    HASH_VIEWS,
)
def canonical_matches(v):
    """Every item against the pool of originals, before and after it."""
    rule = dedup.Nearness(48, 3, None)
    prints = checkpointed(fingerprint.item_fingerprints(v.items(), keep=("published_at",)))
    copies = dedup.canonical_items(prints, rule).filter("canonical_item_id is not null").select("item_id")
    return dedup.canonical_match(prints, prints.join(copies, "item_id", "left_anti"), rule)


# --- topics by keywords and verdicts ---------------------------------------------------------


def _term_rows() -> str:
    """One constant pattern per term; a list of what a text holds."""
    rows = []
    for topic, _, keywords, exclusions, _, active in TOPICS:
        pos = 0
        for entry, exclude in [(k, False) for k in keywords] + [(k, True) for k in exclusions]:
            for piece in entry.split(" / "):
                for term in [piece] if "(" not in piece else [piece.split(" (")[0], piece.split("(")[1].rstrip(")")]:
                    short = len(term) <= 4 and term.upper() == term
                    plain = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))
                    test = f"regexp_matches(body, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')" if short else f"regexp_matches(folded, '(^|[^\\p{{L}}\\p{{N}}]){plain}')"
                    if active:
                        rows.append(f"CASE WHEN {test} THEN {{'topic_id': {topic}::BIGINT, 'pos': {pos}, 'term': '{term}', 'exclude': {str(exclude).lower()}}} END")
                    pos += 1
    return ", ".join(rows)


HIT_VIEWS = {
    "term_hits": f"""SELECT item_id, t.topic_id, t.pos, t.term, t.exclude FROM (SELECT item_id, unnest(list_filter([{_term_rows()}], lambda x: x IS NOT NULL)) AS t FROM (
        SELECT item_id, title || ' ' || text AS body, strip_accents(lower(title || ' ' || text)) AS folded FROM items))""",
    "hits": """MATERIALIZED SELECT item_id, topic_id, string_agg(term, ', ' ORDER BY pos) AS words FROM term_hits a WHERE NOT exclude
        AND NOT EXISTS (SELECT 1 FROM term_hits b WHERE b.exclude AND b.item_id = a.item_id AND b.topic_id = a.topic_id) GROUP BY item_id, topic_id""",
}


def _texts(v):
    return v.items().select("item_id", F.concat_ws(" ", "title", "text").alias("text"))


def _hits(v):
    return match.keyword_hits(_texts(v), v.topics().filter("active"))


@query("keyword_hits", "SELECT item_id, topic_id, words FROM hits", HIT_VIEWS)
def keyword_hits(v):
    return _hits(v).select("item_id", "topic_id", F.array_join("words", ", ").alias("words"))


@query("keyword_hits_by_word", "SELECT item_id, topic_id, words FROM hits", HIT_VIEWS)
def keyword_hits_by_word(v):
    """The same hits with the terms in many blocks, as a long list has them."""
    hits = match.keyword_hits(_texts(v), v.topics().filter("active"), block_terms=4)
    return hits.select("item_id", "topic_id", F.array_join("words", ", ").alias("words"))


COMBINED_VIEWS = {
    **HIT_VIEWS,
    "combined": """SELECT v.item_id, v.topic_id, CASE WHEN words IS NULL THEN 7 ELSE 10 END::BIGINT AS score, CASE WHEN words IS NULL THEN 'ai' ELSE 'ai; keywords: ' || words END AS reason
        FROM verdicts v LEFT JOIN hits h USING (item_id, topic_id) WHERE picked AND batch_ok
        UNION ALL SELECT h.item_id, h.topic_id, 10, 'keywords (AI unavailable): ' || words FROM hits h JOIN verdicts v ON v.item_id = h.item_id WHERE NOT batch_ok""",
}


def _combined(v):
    verdicts = v.verdicts()
    return match.combine_matches(verdicts.select("item_id", "batch_ok"), _hits(v), verdicts.filter("picked").select("item_id", "topic_id"))


@query("combined_matches", "SELECT * FROM combined", COMBINED_VIEWS)
def combined_matches(v):
    return _combined(v)


@query(
    "match_statuses",
    "SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM combined) THEN 'scored' WHEN batch_ok THEN 'not_relevant' ELSE 'new' END AS status FROM verdicts",
    COMBINED_VIEWS,
)
def match_statuses(v):
    return match.match_status(v.verdicts().select("item_id", "batch_ok"), _combined(v))


@query(
    "item_batches",
    "SELECT item_id, (n - 1) // 60 AS batch_no, (n - 1) % 60 AS idx FROM (SELECT item_id, row_number() OVER (ORDER BY created_at, item_id) AS n FROM items)",
)
def item_batches(v):
    return ordered.batches(v.items().select("item_id", "created_at"), 60, ["created_at", "item_id"]).select("item_id", "batch_no", "idx")


@query(
    "topic_batches",
    "SELECT topic_id, item_id, (n - 1) // 20 AS batch_no, (n - 1) % 20 AS idx FROM (SELECT topic_id, item_id, row_number() OVER (PARTITION BY topic_id ORDER BY item_id) AS n FROM scores)",
)
def topic_batches(v):
    return ordered.batches(v.scores().select("topic_id", "item_id"), 20, ["item_id"], ["topic_id"])


@query("decoded_verdicts", "SELECT item_id, topic_id FROM verdicts WHERE picked")
def decoded_verdicts(v):
    """Answers by position in the batch, with positions that do not exist mixed in."""
    batch = ordered.batches(v.items().select("item_id", "created_at"), 60, ["created_at", "item_id"])
    picks = v.verdicts().filter("picked").join(batch, "item_id")
    answers = picks.select("batch_no", F.col("idx").alias("i"), F.array(F.col("topic_id"), F.lit(99).cast("bigint"), F.col("topic_id")).alias("t"))
    answers = answers.unionByName(picks.select("batch_no", (F.col("idx") + 60).alias("i"), F.array("topic_id").alias("t")))
    return match.decode_verdicts(answers, batch, v.topics().select(F.col("topic_id").alias("idx"), "topic_id"))


BACKFILL_VIEWS = {
    **HIT_VIEWS,
    "recent": f"SELECT * FROM statuses WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND status IN ('not_relevant', 'scored', 'grouped')",
    "new_hits": "SELECT item_id, topic_id FROM hits WHERE topic_id IN (0, 1) AND item_id IN (SELECT item_id FROM recent)",
}


def _backfill(v):
    recent = v.statuses().filter((F.col("created_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 7 days")) & F.col("status").isin("not_relevant", "scored", "grouped"))
    texts = recent.select("item_id", F.concat_ws(" ", "title", "text").alias("text"))
    hits = match.keyword_hits(texts, v.topics().filter(F.col("topic_id").isin(0, 1)))
    return match.topic_backfill(hits, recent.select("item_id", "status"), v.story_items())


@query("backfill_reopened", "SELECT item_id, 'scored' AS status FROM recent WHERE status = 'not_relevant' AND item_id IN (SELECT item_id FROM new_hits)", BACKFILL_VIEWS)
def backfill_reopened(v):
    return _backfill(v)[0]


@query("backfill_tags", "SELECT DISTINCT story_id, topic_id FROM new_hits JOIN story_items USING (item_id)", BACKFILL_VIEWS)
def backfill_tags(v):
    return _backfill(v)[1]


@query(
    "keyword_lists",
    """SELECT item_id, array_to_string(CASE WHEN len(g) > 0 THEN list_filter([title] || g, lambda x, i: list_position([title] || g, x) = i) ELSE [title] END, '|') AS keywords FROM (
    SELECT item_id, trim(title) AS title, list_filter(list_transform(regexp_split_to_array(title, ' '), lambda w: trim(w)), lambda w: w <> '') AS g FROM items WHERE trim(title) <> '')""",
)
def keyword_lists(v):
    topics = v.items().filter(F.trim("title") != "").select("item_id", F.trim("title").alias("name"), F.split("title", " ").alias("generated"), F.array().cast("array<string>").alias("keywords"))
    return match.topic_keyword_list(topics).select("item_id", F.array_join("keywords", "|").alias("keywords"))


@query(
    "search_queries",
    """SELECT item_id AS topic_id, unnest(list_distinct(w[1:3] || w[2:4])) AS query, 'src3' AS source_id FROM (SELECT item_id, regexp_split_to_array(title, ' ') AS w FROM items)""",
)
def search_queries(v):
    words = F.split("title", " ")
    topics = v.items().select(F.col("item_id").alias("topic_id"), F.slice(words, 1, 3).alias("queries_a"), F.slice(words, 2, 3).alias("queries_b"))
    return match.search_queries(topics, "src3")


# --- vectors ---------------------------------------------------------------------------------

PAIR_VIEWS = {
    "close_pairs": """SELECT item_id, topic_id, list_cosine_similarity(v.embedding::DOUBLE[], t.embedding) AS cosine FROM vectors v, topic_vectors t
        WHERE list_cosine_similarity(v.embedding::DOUBLE[], t.embedding) >= 0.2"""
}


@query("relevance_prefilter", "SELECT item_id, topic_id, round(cosine, 6) AS cosine FROM close_pairs", PAIR_VIEWS)
def relevance_prefilter(v):
    return similarity.similar_pairs(v.vectors(), v.topic_vectors(), 0.2).withColumn("cosine", six("cosine"))


@query("relevance_prefilter_by_cell", "SELECT item_id, topic_id, round(cosine, 6) AS cosine FROM close_pairs", PAIR_VIEWS)
def relevance_prefilter_by_cell(v):
    """The same pairs with the topics in many blocks, as a long list has them."""
    return similarity.similar_pairs(v.vectors(), v.topic_vectors(), 0.2, block=3).withColumn("cosine", six("cosine"))


RELEVANCE_VIEWS = {
    **PAIR_VIEWS,
    "asked": "SELECT item_id, topic_id, item_id % 11 <> 0 AS batch_ok FROM close_pairs",
    "answers": "SELECT item_id, topic_id, (item_id * 7 + topic_id) % 11 AS score FROM close_pairs WHERE (item_id + topic_id) % 5 <> 0",
    "judged": "SELECT a.item_id, a.topic_id, score, batch_ok AND score IS NOT NULL AS scored FROM asked a LEFT JOIN answers USING (item_id, topic_id)",
}


def _relevance(v):
    asked = similarity.similar_pairs(v.vectors(), v.topic_vectors(), 0.2).select("item_id", "topic_id", (F.col("item_id") % 11 != 0).alias("batch_ok"))
    answers = asked.filter((F.col("item_id") + F.col("topic_id")) % 5 != 0).select("item_id", "topic_id", ((F.col("item_id") * 7 + F.col("topic_id")) % 11).alias("score"), F.lit("r").alias("reason"))
    return similarity.relevance_scores(asked, answers, v.topic_vectors().select("topic_id", F.lit(5).alias("relevance_threshold")))


@query("relevance_scores", "SELECT item_id, topic_id, score FROM judged WHERE scored", RELEVANCE_VIEWS)
def relevance_scores(v):
    return _relevance(v)[0].select("item_id", "topic_id", "score")


@query(
    "relevance_outcomes",
    "SELECT item_id, CASE WHEN bool_or(scored AND score >= 5) THEN 'scored' WHEN bool_or(NOT scored) THEN 'retry' ELSE 'not_relevant' END AS outcome FROM judged GROUP BY item_id",
    RELEVANCE_VIEWS,
)
def relevance_outcomes(v):
    return _relevance(v)[1]


CLUSTER_VIEWS = {
    "snapshot": "SELECT t.topic_id AS story_id, t.embedding AS centroid, m.at AS last_updated_at FROM topic_vectors t JOIN (SELECT label, max(published_at) AS at FROM vectors GROUP BY label) m ON m.label = t.topic_id",
    "compared": """SELECT item_id, story_id, list_cosine_similarity(v.embedding::DOUBLE[], centroid) AS cosine FROM vectors v JOIN snapshot s
        ON abs(epoch(v.published_at) - epoch(s.last_updated_at)) <= 72 * 3600 WHERE list_cosine_similarity(v.embedding::DOUBLE[], centroid) >= 0.20""",
    "best": "SELECT item_id, arg_max(story_id, (cosine, -story_id)) AS story_id, max(cosine) AS cosine FROM compared GROUP BY item_id",
    "decided": "SELECT v.item_id, b.story_id, b.cosine, CASE WHEN b.cosine >= 0.30 THEN 'attach' WHEN b.cosine >= 0.20 THEN 'confirm' ELSE 'new' END AS action FROM vectors v LEFT JOIN best b USING (item_id)",
}


def _snapshot(v):
    last = v.vectors().groupBy(F.col("label").alias("topic_id")).agg(F.max("published_at").alias("last_updated_at"))
    return v.topic_vectors().join(last, "topic_id").select(F.col("topic_id").alias("story_id"), F.col("embedding").alias("centroid"), "last_updated_at")


@query("cluster_decisions", "SELECT item_id, story_id, round(cosine, 6) AS cosine, action FROM decided", CLUSTER_VIEWS)
def cluster_decisions(v):
    return similarity.best_stories(v.vectors(), _snapshot(v), 0.30, 0.20).withColumn("cosine", six("cosine"))


@query("cluster_decisions_by_cell", "SELECT item_id, story_id, round(cosine, 6) AS cosine, action FROM decided", CLUSTER_VIEWS)
def cluster_decisions_by_cell(v):
    """The same decisions with the stories in many blocks."""
    return similarity.best_stories(v.vectors(), _snapshot(v), 0.30, 0.20, block=3).withColumn("cosine", six("cosine"))


LEADER_NEAR = "list_dot_product(c.sig, o.sig) >= 0.30"


@query(
    "clustered_batch",
    f"""SELECT item_id, story_id, false AS is_new FROM placed WHERE attached UNION ALL
    SELECT t.item_id, ('0x' || substr(sha256('story ' || coalesce(arg_min(c.id, (c.tm, c.id)), t.item_id)), 1, 15))::BIGINT, true FROM timeline t LEFT JOIN originals c
    ON t.item_id NOT IN (SELECT id FROM originals) AND (t.tm, t.item_id) > (c.tm, c.id) AND t.tm - c.tm <= 259200 AND {LEADER_NEAR.replace('o.sig', 't.sig')} GROUP BY t.item_id""",
    {
        **CLUSTER_VIEWS,
        "placed": "SELECT *, action = 'attach' OR (action = 'confirm' AND (item_id + story_id) % 2 = 0) AS attached FROM decided",
        **_greedy_views("DOUBLE[]", LEADER_NEAR, 72, "SELECT v.item_id, published_at, embedding::DOUBLE[] AS sig FROM vectors v JOIN placed USING (item_id) WHERE NOT coalesce(attached, false)"),
    },
)
def clustered_batch(v):
    pairs = similarity.best_stories(v.vectors(), _snapshot(v), 0.30, 0.20).filter("action = 'confirm'")
    verdicts = pairs.select("item_id", "story_id", ((F.col("item_id") + F.col("story_id")) % 2 == 0).alias("same"))
    return similarity.cluster_batch(v.vectors(), _snapshot(v), verdicts, 0.30, 0.20)


@query(
    "cluster_agreement",
    """SELECT found_pairs, true_pairs, common_pairs, round(common_pairs / found_pairs, 6) AS precision, round(common_pairs / true_pairs, 6) AS recall, round(2 * common_pairs / (found_pairs + true_pairs), 6) AS f1 FROM (
    SELECT count(*) FILTER (WHERE a.story_id = b.story_id) AS found_pairs, count(*) FILTER (WHERE a.label = b.label) AS true_pairs, count(*) FILTER (WHERE a.story_id = b.story_id AND a.label = b.label) AS common_pairs
    FROM grouped a JOIN grouped b ON a.item_id < b.item_id)""",
    {**CLUSTER_VIEWS, "grouped": "SELECT v.item_id, label, story_id FROM vectors v LEFT JOIN decided USING (item_id)"},
)
def cluster_agreement(v):
    """The stories that items were nearest to, against their labels."""
    found = similarity.best_stories(v.vectors(), _snapshot(v), 0.30, 0.20).select("item_id", F.col("story_id").alias("cluster"))
    agreed = measures.cluster_agreement(found, v.vectors().select("item_id", F.col("label").alias("cluster")))
    return agreed.withColumns({c: six(c) for c in ("precision", "recall", "f1")})


@query(
    "updated_centroids",
    """SELECT label AS story_id, n, array_to_string(list_transform(list(x ORDER BY pos), lambda y: printf('%.4f', y + 0.00000001)), ',') AS centroid FROM (
    SELECT label, count(*) OVER (PARTITION BY label, pos) AS n, pos, avg(x) OVER (PARTITION BY label, pos) AS x, row_number() OVER (PARTITION BY label, pos ORDER BY item_id) AS k FROM (
    SELECT label, item_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors)) WHERE k = 1 GROUP BY label, n""",
)
def updated_centroids(v):
    """Vectors of the second half of the month join the stories of the first half."""
    half = F.lit("2024-01-15").cast("timestamp")
    early, late = v.vectors().filter(F.col("published_at") < half), v.vectors().filter(F.col("published_at") >= half)
    spread = early.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    before = spread.groupBy("label", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(F.col("label").alias("story_id"), F.col("p.x").alias("centroid"), "n")
    after = similarity.updated_centroids(before, late.select(F.col("label").alias("story_id"), "embedding"))
    shown = F.transform("centroid", lambda x: F.format_string("%.4f", x + 0.00000001))
    return after.select("story_id", "n", F.array_join(shown, ",").alias("centroid"))


# --- stories ---------------------------------------------------------------------------------


@query(
    "primary_topics",
    """SELECT item_id, arg_min(topic_id, (CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, topic_id)) AS topic_id FROM scores JOIN topics USING (topic_id) GROUP BY item_id""",
)
def primary_topics(v):
    return st.primary_topic(v.scores(), v.topics())


@query(
    "orphan_items",
    "SELECT item_id FROM statuses WHERE status = 'scored' AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.item_id = statuses.item_id AND s.topic_id IN (SELECT topic_id FROM topics WHERE active))",
)
def orphan_items(v):
    return st.orphan_items(v.statuses().filter("status = 'scored'").select("item_id"), v.scores(), v.topics().filter("active"))


@query(
    "recent_events",
    f"""SELECT topic_id, n - 1 AS idx, story_id, title FROM (SELECT topic_id, story_id, title, row_number() OVER (PARTITION BY topic_id ORDER BY last_updated_at DESC, story_id) AS n
    FROM story_topics JOIN stories USING (story_id) WHERE status = 'open' AND last_updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR)""",
)
def recent_events(v):
    return st.recent_events(v.story_topics(), v.stories(), AS_OF, window_hours=240).drop("last_updated_at")


@query("sample_titles", "SELECT story_id, array_to_string((list(title ORDER BY item_id))[1:3], '|') AS titles FROM story_items JOIN items USING (item_id) GROUP BY story_id")
def sample_titles(v):
    return st.sample_titles(v.story_items(), v.items()).withColumn("titles", F.array_join("titles", "|"))


_GROUP_VIEWS = {
    "batch": "SELECT item_id, title, source_id, (n - 1) // 20 AS batch_no, (n - 1) % 20 AS idx FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM items)",
}


def _batch(v):
    rows = v.items().select("item_id", "title", F.concat(F.lit("From "), "source_id").alias("standfirst"), "language", "source_id")
    return ordered.batches(rows, 20, ["item_id"])


def _answers(batch):
    """Verdicts per batch: two assignments (one to a missing event, one repeated), two new events
    that overlap, and no answer at all for every fifth batch."""
    number = batch.select("batch_no").distinct().filter(F.col("batch_no") % 5 != 4)
    n = F.col("batch_no")
    assign = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(e).cast("bigint").alias("e")) for i, e in ((0, 0), (1, 7), (2, 1), (2, 0), (25, 0))])

    def event(members, title, tier):
        return F.struct(F.array(*[F.lit(m).cast("bigint") for m in members]).alias("items"), title.alias("title"), F.concat(F.lit("What happened – batch "), n.cast("string")).alias("summary"), F.lit(tier).cast("bigint").alias("tier"))

    events = F.array(event((2, 3, 4), F.concat(F.lit("Event — "), n.cast("string")), 1), event((4, 5, 30), F.lit(""), 2))
    return number.select("batch_no", assign.alias("assign"), events.alias("new_events"))


def _events(batch):
    return batch.select("batch_no").distinct().select("batch_no", F.posexplode(F.array(F.col("batch_no") * 10, F.col("batch_no") * 10 + 1)).alias("idx", "story_id"))


def _resolved(v):
    batch = _batch(v)
    return st.resolve_grouping(batch, _events(batch).withColumn("idx", F.col("idx").cast("bigint")), _answers(batch))


RESOLVED_SQL = """SELECT item_id, batch_no,
    CASE WHEN answered AND idx = 0 THEN batch_no * 10 WHEN answered AND idx = 2 THEN batch_no * 10 + 1 END AS story_id,
    CASE WHEN answered AND idx IN (0, 2) THEN NULL WHEN answered AND idx IN (3, 4) THEN 0 WHEN answered AND idx = 5 THEN 1 ELSE idx + 1000000 END AS new_no,
    CASE WHEN answered AND idx IN (0, 2) THEN NULL WHEN answered AND idx IN (3, 4) THEN 'Event, ' || batch_no ELSE title END AS title,
    CASE WHEN answered AND idx IN (0, 2) THEN NULL WHEN answered AND idx IN (3, 4, 5) THEN 'What happened, batch ' || batch_no ELSE 'From ' || source_id END AS summary,
    CASE WHEN answered AND idx IN (0, 2) THEN NULL WHEN answered AND idx IN (3, 4) THEN 1 WHEN answered AND idx = 5 THEN 2 ELSE 3 END::BIGINT AS tier
    FROM (SELECT *, batch_no % 5 <> 4 AS answered FROM batch)"""


@query("resolved_grouping", RESOLVED_SQL, _GROUP_VIEWS)
def resolved_grouping(v):
    return _resolved(v)


_SID = "coalesce(story_id::VARCHAR, 's' || sha256((min(item_id) OVER (PARTITION BY batch_no, new_no))::VARCHAR)[1:16])"
_NAMED = f"SELECT *, {_SID} AS sid FROM resolved"


@query("grouping_stories", f"SELECT sid AS story_id, min(title) AS title, min(summary) AS summary, min(tier) AS tier FROM ({_NAMED}) WHERE story_id IS NULL GROUP BY 1", {**_GROUP_VIEWS, "resolved": RESOLVED_SQL})
def grouping_stories(v):
    return st.grouping_writes(_resolved(v), v.scores())[0]


@query("grouping_links", f"SELECT DISTINCT sid AS story_id, item_id FROM ({_NAMED})", {**_GROUP_VIEWS, "resolved": RESOLVED_SQL})
def grouping_links(v):
    return st.grouping_writes(_resolved(v), v.scores())[1]


@query("grouping_touched", "SELECT DISTINCT story_id FROM resolved WHERE story_id IS NOT NULL", {**_GROUP_VIEWS, "resolved": RESOLVED_SQL})
def grouping_touched(v):
    return st.grouping_writes(_resolved(v), v.scores())[3]


@query(
    "grouping_topics",
    f"SELECT DISTINCT sid AS story_id, topic_id FROM (SELECT sid, item_id FROM ({_NAMED})) JOIN scores USING (item_id)",
    {**_GROUP_VIEWS, "resolved": RESOLVED_SQL},
)
def grouping_topics(v):
    return st.grouping_writes(_resolved(v), v.scores())[2]


@query(
    "threshold_topics",
    "SELECT DISTINCT story_id, topic_id FROM story_items JOIN scores USING (item_id) JOIN topics USING (topic_id) WHERE score >= 3 + topic_id % 4",
)
def threshold_topics(v):
    limits = v.topics().select("topic_id", (F.lit(3) + F.col("topic_id") % 4).alias("relevance_threshold"))
    return st.threshold_topics(v.story_items(), v.scores(), limits)


@query(
    "ranked_stories",
    """SELECT s.story_id, s.tier, s.novelty, round(CASE s.tier WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 10 END + CASE s.novelty WHEN 'new' THEN 8 WHEN 'continuation' THEN 4 ELSE 0 END
    + CASE coalesce(p.priority, 'normal') WHEN 'high' THEN 6 WHEN 'normal' THEN 3 ELSE 0 END + 10 * coalesce(w.weight, 0.5) + c.n, 6) AS rank_score, CASE WHEN s.novelty = 'repetition' THEN 'closed' ELSE 'open' END AS status
    FROM (SELECT story_id, tier, ['new', 'continuation', 'repetition', 'other'][story_id % 4 + 1] AS novelty FROM stories) s
    JOIN (SELECT story_id, count(*) AS n FROM story_items GROUP BY 1) c USING (story_id)
    LEFT JOIN (SELECT story_id, avg(weight::DOUBLE) AS weight FROM story_items JOIN items USING (item_id) JOIN sources USING (source_id) GROUP BY 1) w USING (story_id)
    LEFT JOIN (SELECT story_id, ['high', 'normal', 'low'][min(CASE priority WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END)] AS priority FROM story_topics JOIN topics USING (topic_id) GROUP BY 1) p USING (story_id)""",
)
def ranked_stories(v):
    novelty = F.element_at(F.array(F.lit("new"), F.lit("continuation"), F.lit("repetition"), F.lit("other")), (F.col("story_id") % 4 + 1).cast("int"))
    judged = v.stories().select("story_id", "tier", novelty.alias("novelty"))
    ranked = st.rank_stories(v.stories(), judged, v.story_items(), v.items(), v.sources(), v.story_topics(), v.topics())
    return ranked.withColumn("rank_score", six("rank_score"))


@query(
    "story_contexts",
    """SELECT story_id, item_id, title, language, coalesce(l.source_id, '?') AS source_name, perspective_group FROM story_items JOIN linked_items l USING (item_id)
    JOIN (SELECT item_id, language FROM items) USING (item_id) LEFT JOIN sources s ON s.source_id = l.source_id""",
)
def story_contexts(v):
    items = v.linked_items().join(v.items().select("item_id", "language"), "item_id")
    return st.story_context(v.story_items(), items, v.sources())


@query(
    "story_source_counts",
    "SELECT story_id, count(DISTINCT l.source_id) AS sources, count(DISTINCT perspective_group) AS perspectives FROM story_items LEFT JOIN linked_items l USING (item_id) LEFT JOIN sources s ON s.source_id = l.source_id GROUP BY story_id",
)
def story_source_counts(v):
    return st.source_counts(v.story_items(), v.linked_items(), v.sources())


@query(
    "framing_shown",
    "SELECT story_id, count(DISTINCT perspective_group) >= 2 AND story_id % 3 > 0 AS show FROM story_items LEFT JOIN linked_items l USING (item_id) LEFT JOIN sources s ON s.source_id = l.source_id GROUP BY story_id",
)
def framing_shown(v):
    framing = v.stories().select("story_id", F.when(F.col("story_id") % 3 > 0, F.array(F.lit("a"), F.lit("b"))).alias("framing"))
    return st.framing_gate(st.source_counts(v.story_items(), v.linked_items(), v.sources()), framing)


@query(
    "why_matched",
    """SELECT story_id, name AS topic, count(DISTINCT item_id) AS articles, count(DISTINCT CASE WHEN reason LIKE 'ai%' THEN item_id END) AS verdicts,
    coalesce(array_to_string(list_sort(list_distinct(list(word) FILTER (word IS NOT NULL))), ', '), '') AS keywords FROM (
    SELECT story_id, item_id, topic_id, reason, unnest(CASE WHEN contains(reason, ': ') THEN string_split(split_part(reason, ': ', 2), ', ') WHEN reason = 'keyword' THEN ['(keyword match, earlier rule)'] ELSE [NULL] END) AS word
    FROM story_items JOIN scores USING (item_id)) JOIN topics USING (topic_id) GROUP BY story_id, name""",
)
def why_matched(v):
    return st.why_matched(v.story_items(), v.scores(), v.topics()).withColumn("keywords", F.array_join("keywords", ", "))


@query(
    "applied_verdicts",
    "SELECT story_id, title, CASE WHEN summary IS NULL AND story_id % 3 <> 0 THEN 'written for ' || story_id ELSE summary END AS summary FROM stories",
)
def applied_verdicts(v):
    missing = v.stories().filter("summary is null and story_id % 3 <> 0").select("story_id", F.concat(F.lit("written for "), F.col("story_id").cast("string")).alias("summary"))
    return st.apply_verdicts(v.stories().select("story_id", "title", "summary"), missing, "story_id", ["summary"])[0]


@query("verdict_totals", "SELECT count(*) FILTER (story_id % 3 <> 0) AS done, count(*) FILTER (story_id % 3 = 0) AS failed FROM stories WHERE summary IS NULL")
def verdict_totals(v):
    due = v.stories().filter("summary is null").select("story_id", "title", "summary")
    written = due.filter("story_id % 3 <> 0").select("story_id", F.lit("written").alias("summary"))
    return st.apply_verdicts(due, written, "story_id", ["summary"])[1]


@query("topic_timelines", f"SELECT topic_id, story_id, title, tier, {sql_stamp('first_seen_at')} AS first_seen_at FROM story_topics JOIN stories USING (story_id)")
def topic_timelines(v):
    return st.topic_timeline(v.story_topics(), v.stories()).withColumn("first_seen_at", stamp("first_seen_at"))


# --- rematch ---------------------------------------------------------------------------------

REMATCH_VIEWS = {
    **HIT_VIEWS,
    "keyword_only": "SELECT * FROM scores WHERE reason LIKE 'keyword%'",
    "picks": "SELECT item_id, topic_id FROM verdicts WHERE picked",
    "diff": """SELECT d.item_id, d.topic_id, change, CASE WHEN change <> 'drop' THEN CASE WHEN words IS NULL THEN 'ai' ELSE 'ai; keywords: ' || words END END AS reason FROM (
        SELECT item_id, topic_id, CASE WHEN (item_id, topic_id) IN (SELECT (item_id, topic_id) FROM picks) THEN 'keep' ELSE 'drop' END AS change FROM keyword_only
        UNION ALL SELECT item_id, topic_id, 'add' FROM picks WHERE (item_id, topic_id) NOT IN (SELECT (item_id, topic_id) FROM scores)) d LEFT JOIN hits USING (item_id, topic_id)""",
    "scores_after": """SELECT s.item_id, s.topic_id, s.score, coalesce(d.reason, s.reason) AS reason FROM scores s LEFT JOIN diff d USING (item_id, topic_id) WHERE coalesce(change, '') <> 'drop'
        UNION ALL SELECT item_id, topic_id, 7, reason FROM diff WHERE change = 'add'""",
    "touched": "SELECT DISTINCT story_id FROM story_items WHERE item_id IN (SELECT item_id FROM diff WHERE change = 'drop')",
    "supported": "SELECT DISTINCT story_id, topic_id FROM story_items JOIN scores_after USING (item_id)",
    "closed": "SELECT story_id FROM touched WHERE story_id NOT IN (SELECT story_id FROM supported)",
}


def _diff(v):
    only = v.scores().filter(F.startswith("reason", F.lit("keyword")))
    return rematch.rematch_diff(only, v.verdicts().filter("picked").select("item_id", "topic_id"), v.scores(), _hits(v))


@query("rematch_diff", "SELECT * FROM diff", REMATCH_VIEWS)
def rematch_diff(v):
    return _diff(v)


@query("rematch_summary", "SELECT name AS topic, count(*) FILTER (change = 'keep') AS kept, count(*) FILTER (change = 'drop') AS dropped FROM diff JOIN topics USING (topic_id) WHERE change <> 'add' GROUP BY name", REMATCH_VIEWS)
def rematch_summary(v):
    return rematch.rematch_summary(_diff(v), v.topics())


@query("rematch_scores", "SELECT * FROM scores_after", REMATCH_VIEWS)
def rematch_scores(v):
    return rematch.applied_scores(v.scores(), _diff(v))


def _applied(v):
    diff = _diff(v)
    after = rematch.applied_scores(v.scores(), diff)
    return rematch.rematch_apply(diff, after, v.statuses().select("item_id", "status"), v.stories(), v.story_items(), v.story_topics())


@query(
    "rematch_story_topics",
    """SELECT story_id, topic_id FROM (SELECT story_id, topic_id FROM story_topics UNION SELECT story_id, topic_id FROM story_items JOIN diff USING (item_id) WHERE change = 'add')
    WHERE story_id NOT IN (SELECT story_id FROM touched) OR (story_id, topic_id) IN (SELECT (story_id, topic_id) FROM supported)""",
    REMATCH_VIEWS,
)
def rematch_story_topics(v):
    return _applied(v)[0]


@query("rematch_stories", "SELECT story_id, CASE WHEN story_id IN (SELECT story_id FROM closed) THEN 'closed' ELSE status END AS status FROM stories", REMATCH_VIEWS)
def rematch_stories(v):
    return _applied(v)[1].select("story_id", "status")


@query(
    "rematch_items",
    """SELECT item_id, CASE WHEN item_id NOT IN (SELECT item_id FROM scores_after) AND (item_id IN (SELECT item_id FROM story_items WHERE story_id IN (SELECT story_id FROM closed))
    OR (status = 'scored' AND item_id IN (SELECT item_id FROM diff WHERE change = 'drop'))) THEN 'not_relevant' ELSE status END AS status FROM statuses""",
    REMATCH_VIEWS,
)
def rematch_items(v):
    return _applied(v)[2]


# --- hand-off --------------------------------------------------------------------------------


@query(
    "match_requests",
    """SELECT batch_no, 'Topics:' || chr(10) || (SELECT string_agg('T' || topic_id || ': ' || name, chr(10) ORDER BY topic_id) FROM topics WHERE active) || chr(10) || chr(10) || 'Articles:' || chr(10)
    || string_agg(idx || '. ' || title || ' | From ' || source_id, chr(10) ORDER BY idx) AS request FROM batch GROUP BY batch_no""",
    _GROUP_VIEWS,
)
def match_requests(v):
    return handoff.match_requests(_batch(v), v.topics().filter("active").withColumn("idx", F.col("topic_id")))


@query(
    "group_requests",
    """SELECT batch_no, 'Events:' || chr(10) || 'E0: event ' || batch_no * 10 || chr(10) || 'E1: event ' || (batch_no * 10 + 1) || chr(10) || chr(10) || 'Articles:' || chr(10)
    || string_agg(idx || '. [' || source_id || '] ' || title || ' | From ' || source_id, chr(10) ORDER BY idx) AS request FROM batch GROUP BY batch_no""",
    _GROUP_VIEWS,
)
def group_requests(v):
    batch = _batch(v)
    events = _events(batch).withColumn("title", F.concat(F.lit("event "), F.col("story_id").cast("string")))
    return handoff.group_requests(batch.withColumn("source", F.col("source_id")), events)


@query(
    "checked_answers",
    "SELECT item_id, item_id % 4 <> 1 AND NOT (item_id % 4 = 2 AND item_id % 5 = 4) AS accepted, CASE WHEN item_id % 4 <> 1 AND NOT (item_id % 4 = 2 AND item_id % 5 = 4) THEN (item_id % 60)::BIGINT END AS first_index FROM items",
)
def checked_answers(v):
    """Answers around the JSON object, cut off, or without a required field."""
    i = (F.col("item_id") % 60).cast("string")
    good = F.concat(F.lit('{"matches": [{"i": '), i, F.lit(', "t": [0, 3]}]}'))
    made = (
        F.when(F.col("item_id") % 4 == 0, good)
        .when(F.col("item_id") % 4 == 1, F.substring(good, 1, 20))
        .when((F.col("item_id") % 4 == 2) & (F.col("item_id") % 5 == 4), F.lit('{"matches": [{"i": 1}]}'))
        .otherwise(F.concat(F.lit("Here it is:\n"), good, F.lit("\nDone.")))
    )
    answers = v.items().select(F.col("item_id").alias("batch_no"), made.alias("answer"))
    fine, bad = handoff.parsed_answers(answers, handoff.MATCH_ANSWER, handoff.match_valid)
    return fine.select(F.col("batch_no").alias("item_id"), F.lit(True).alias("accepted"), F.element_at("value.matches", 1)["i"].alias("first_index")).unionByName(
        bad.select(F.col("batch_no").alias("item_id"), F.lit(False).alias("accepted"), F.lit(None).cast("bigint").alias("first_index"))
    )


_SHOT_SQL = """SELECT topic_id, array_to_string(list(title ORDER BY n), '|') AS titles FROM (
    SELECT topic_id, story_id, min((-epoch_us(created_at), feedback_id)) AS n FROM (
    SELECT * FROM feedback WHERE signal IN ('relevant', 'saved')) f JOIN story_topics t ON t.story_id = f.target_id GROUP BY topic_id, story_id) r
    JOIN (SELECT story_id, arg_min(title, item_id) AS title FROM story_items JOIN items USING (item_id) WHERE title <> '' GROUP BY story_id) USING (story_id) GROUP BY topic_id"""


@query("few_shot_titles", _SHOT_SQL)
def few_shot_titles(v):
    from tidings.functions.scoring import TOPIC_POSITIVE

    return handoff.few_shot(v.feedback(), v.story_topics(), v.story_items(), v.items(), TOPIC_POSITIVE).withColumn("titles", F.array_join("titles", "|"))


@query(
    "relevance_requests",
    """SELECT topic_id, (n - 1) // 10 AS batch_no, 'Topic: ' || name || chr(10) || 'Excluded: ' || CASE WHEN len(exclusions) > 0 THEN array_to_string(exclusions, ', ') ELSE '(none)' END || chr(10)
    || 'Relevant: "' || name || '"' || chr(10) || 'Not relevant: (none)' || chr(10) || 'Items:' || chr(10)
    || string_agg('- id: ' || item_id || chr(10) || '  language: ' || language || chr(10) || '  title: ' || title || chr(10) || '  standfirst: (none)', chr(10) ORDER BY n) AS request
    FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY item_id) AS n FROM scores JOIN items USING (item_id)) JOIN topics USING (topic_id) GROUP BY topic_id, (n - 1) // 10, name, exclusions""",
)
def relevance_requests(v):
    rows = v.scores().select("topic_id", "item_id").join(v.items().select("item_id", "title", "language", F.lit(None).cast("string").alias("standfirst")), "item_id")
    examples = v.topics().select("topic_id", F.array("name").alias("positive"), F.array().cast("array<string>").alias("negative"))
    return handoff.relevance_requests(ordered.batches(rows, 10, ["item_id"], ["topic_id"]), v.topics(), examples)


@query(
    "eval_cases",
    """SELECT doc_id AS case_id, (NOT contains(lower(text), lower(source)))::BIGINT AS missing, contains(lower(text), 'the')::BIGINT + (contains(lower(text), '3,5') OR contains(lower(text), '3.5'))::BIGINT AS forbidden, doc_id % 4 = 3 AS framing_off,
    contains(lower(text), lower(source)) AND NOT contains(lower(text), 'the') AND NOT contains(lower(text), '3,5') AND NOT contains(lower(text), '3.5') AND doc_id % 4 <> 3 AS passed FROM documents""",
)
def eval_cases(v):
    return _evaluated(v)[0].drop("answered")


@query(
    "eval_totals",
    """SELECT count(*) AS cases, count(*) FILTER (contains(lower(text), lower(source)) AND NOT contains(lower(text), 'the') AND NOT contains(lower(text), '3,5') AND NOT contains(lower(text), '3.5') AND doc_id % 4 <> 3) AS passed FROM documents""",
)
def eval_totals(v):
    return _evaluated(v)[1]


def _evaluated(v):
    cases = v.table("documents").select(
        F.col("doc_id").alias("case_id"), F.array("source").alias("must_contain"), F.array(F.lit("The"), F.lit("3.5")).alias("must_not_contain"),
        F.lit(1).alias("min_framing"), F.lit(3).alias("max_framing"),
    )
    framing = F.array_repeat(F.lit("-"), F.when(F.col("doc_id") % 4 == 3, F.lit(4)).otherwise((F.col("doc_id") % 3 + 1).cast("int")))
    outputs = v.table("documents").select(F.col("doc_id").alias("case_id"), F.array("text").alias("texts"), framing.alias("framing"))
    return handoff.eval_assertions(cases, outputs)
