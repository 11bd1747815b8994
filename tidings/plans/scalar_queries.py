"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import markup as mk, scoring, text as tx, urls, vectors as vx
from tidings.operators import fingerprint, languages
from tidings.plans.registry import query, six, sql_stamp, stamp
from tidings.plans.views import AS_OF
from tidings.session import checkpointed

_PARTS = "regexp_extract(url, '^([A-Za-z]+)://([^/?#]+)([^?#]*)(?:[?]([^#]*))?', ['s', 'h', 'p', 'q'])"
_TRACK = "^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|ref_src|ref_url|igshid|spm|si|cmpid|icid)$"
CANONICAL_SQL = f"""SELECT page_id, url, lower(u.s) || '://' || lower(u.h)
    || CASE WHEN u.p = '' THEN '/' WHEN length(u.p) > 1 THEN regexp_replace(u.p, '/$', '') ELSE u.p END
    || CASE WHEN len(k) > 0 THEN '?' || array_to_string(list_sort(k), '&') ELSE '' END AS canonical_url
    FROM (SELECT page_id, url, u, list_filter(string_split(u.q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '{_TRACK}')) AS k
    FROM (SELECT page_id, url, {_PARTS} AS u FROM pages))"""


@query("canonical_urls", CANONICAL_SQL)
def canonical_urls(v):
    return v.pages().select("page_id", "url", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("host_keys", f"SELECT regexp_replace(lower(u.h), '^www[.]', '') AS host, count(*) AS pages FROM (SELECT {_PARTS} AS u FROM pages) GROUP BY 1")
def host_keys(v):
    return v.pages().groupBy(urls.host_label(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


_GUARD = """SELECT item_id, n, CASE item_id % 9 WHEN 0 THEN 'http://10.' || n || '.0.1/a' WHEN 1 THEN 'https://172.' || n || '.3.4/' WHEN 2 THEN 'http://100.' || n || '.1.1/'
    WHEN 3 THEN 'ftp://files.example.com/' || n WHEN 4 THEN 'http://localhost:8080/' || n WHEN 5 THEN 'http://192.168.' || n || '.9' WHEN 6 THEN 'https://' || n || '.8.8.8/x'
    WHEN 7 THEN 'not a url ' || n ELSE 'HTTPS://www.example.org/' || n END AS url FROM (SELECT doc_id AS item_id, doc_id % 256 AS n FROM documents)"""


@query(
    "url_guard",
    """SELECT item_id, CASE WHEN regexp_matches(lower(url), '^https?://') THEN url END AS safe_url,
    CASE item_id % 9 WHEN 1 THEN n NOT BETWEEN 16 AND 31 WHEN 2 THEN n NOT BETWEEN 64 AND 127
    WHEN 6 THEN n NOT IN (0, 10, 127) AND n < 224 WHEN 8 THEN true ELSE false END AS is_public FROM guarded""",
    {"guarded": _GUARD},
)
def url_guard(v):
    n, kind = (F.col("doc_id") % 256).cast("string"), F.col("doc_id") % 9
    made = (
        F.when(kind == 0, F.concat(F.lit("http://10."), n, F.lit(".0.1/a")))
        .when(kind == 1, F.concat(F.lit("https://172."), n, F.lit(".3.4/")))
        .when(kind == 2, F.concat(F.lit("http://100."), n, F.lit(".1.1/")))
        .when(kind == 3, F.concat(F.lit("ftp://files.example.com/"), n))
        .when(kind == 4, F.concat(F.lit("http://localhost:8080/"), n))
        .when(kind == 5, F.concat(F.lit("http://192.168."), n, F.lit(".9")))
        .when(kind == 6, F.concat(F.lit("https://"), n, F.lit(".8.8.8/x")))
        .when(kind == 7, F.concat(F.lit("not a url "), n))
        .otherwise(F.concat(F.lit("HTTPS://www.example.org/"), n))
    )
    rows = v.table("documents").select(F.col("doc_id").alias("item_id"), made.alias("url"))
    return rows.select("item_id", urls.safe_url(F.col("url")).alias("safe_url"), urls.is_public_url(F.col("url")).alias("is_public"))


@query(
    "path_dates",
    """SELECT item_id, CASE item_id % 4 WHEN 0 THEN '2024-' || m || '-' || d WHEN 1 THEN CASE WHEN m = '01' THEN '2024-01-15T10:00:00Z' ELSE '2024-' || m || '-01' END END AS path_date
    FROM (SELECT doc_id AS item_id, lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS m, lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS d FROM documents)""",
)
def path_dates(v):
    m, d = (F.lpad((F.col("doc_id") % n + 1).cast("string"), 2, "0") for n in (12, 28))
    kind = F.col("doc_id") % 4
    tail = F.when(kind == 0, F.concat(F.lit("2024/"), m, F.lit("/"), d, F.lit("/story"))).when(kind == 1, F.concat(F.lit("2024/"), m, F.lit("/story"))).when(kind == 2, F.lit("2024/13/40/x")).otherwise(F.lit("plain"))
    link = F.concat(F.lit("https://"), "source", F.lit(".example.org/"), tail)
    return v.table("documents").select(F.col("doc_id").alias("item_id"), urls.path_date(link, F.lit("2024-01-15T10:00:00Z")).alias("path_date"))


@query(
    "clean_titles",
    """SELECT item_id, CASE WHEN length(rtrim(title)) >= 20 THEN trim(title) ELSE trim(title || ' | ' || source_id) END AS title FROM items""",
)
def clean_titles(v):
    return v.items().select("item_id", tx.clean_title(F.concat("title", F.lit(" | "), "source_id")).alias("title"))


@query(
    "decoded_titles",
    """SELECT page_id, trim(replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')) AS title
    FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)""",
)
def decoded_titles(v):
    return v.pages().select("page_id", mk.tag_text(F.col("html"), "title").alias("title"))


@query("text_hashes", "SELECT item_id, sha256(replace(text, chr(0), '')) AS text_hash, length(replace(text, chr(0), '')) AS chars FROM items")
def text_hashes(v):
    clean = tx.sanitize_text(F.col("text"))
    return v.items().select("item_id", tx.content_hash(clean).alias("text_hash"), F.char_length(clean).cast("bigint").alias("chars"))


def _language_sql() -> str:
    scores = ", ".join(
        f"{{'score': len(list_filter(w, lambda x: x IN ({', '.join(repr(word) for word in words)}))), 'rank': -{n}, 'lang': '{lang}'}}"
        for n, (lang, words) in enumerate(sorted(tx.LANGUAGE_WORDS.items()))
    )
    return f"""SELECT item_id, CASE WHEN best.score > 0 THEN best.lang END AS detected, language FROM (
        SELECT item_id, text, language, list_max([{scores}]) AS best FROM (SELECT *, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM items))"""


@query("detected_languages", _language_sql())
def detected_languages(v):
    return v.items().select("item_id", tx.detect_language(F.col("text")).alias("detected"), "language")


def _trigram_sql() -> str:
    """The same profiles and sums in SQL: fourfold hold-out by id, 200 texts a language."""
    return """WITH plain AS (SELECT item_id, language, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS t FROM items),
        grams AS MATERIALIZED (SELECT item_id, language, z[1] || z[2] || z[3] AS gram, count(*) AS k FROM (SELECT item_id, language, unnest(list_zip(c, c[2:], c[3:])) AS z
            FROM (SELECT item_id, language, string_split(t, '') AS c FROM plain)) WHERE z[3] IS NOT NULL GROUP BY ALL),
        sample AS (SELECT item_id FROM items WHERE item_id % 4 <> 1 AND language IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY language ORDER BY item_id) <= 200),
        counts AS MATERIALIZED (SELECT language, gram, sum(k) AS n FROM grams JOIN sample USING (item_id) GROUP BY ALL),
        sizes AS (SELECT language, sum(n) AS size FROM counts GROUP BY language),
        every AS (SELECT gram, sum(n) AS n FROM counts GROUP BY gram HAVING sum(n) >= 5),
        odds AS MATERIALIZED (SELECT s.language, e.gram, ln((coalesce(c.n, 0) + 0.5) / (s.size + 0.5)) - ln((e.n + 0.5) / ((SELECT sum(size) FROM sizes) + 0.5)) AS w
            FROM every e CROSS JOIN sizes s LEFT JOIN counts c ON c.gram = e.gram AND c.language = s.language),
        sums AS (SELECT item_id, o.language, sum(k * w) AS s FROM grams g JOIN odds o USING (gram) GROUP BY ALL)
        SELECT items.item_id, items.item_id % 4 = 1 AS held_out, items.language, b.detected FROM items LEFT JOIN (SELECT item_id, arg_max(language, s) AS detected FROM sums GROUP BY item_id) b USING (item_id)"""


@query("trigram_languages", f"SELECT * FROM ({_trigram_sql()})")
def trigram_languages(v):
    """Every text judged by profiles learnt from three quarters of the items."""
    names, profiles = languages.language_profiles(v.items().filter("item_id % 4 <> 1"))
    judged = languages.by_trigrams(v.items(), names, profiles)
    return v.items().select("item_id", (F.col("item_id") % 4 == 1).alias("held_out"), "language").join(judged.select("item_id", "detected"), "item_id")


@query("folded_texts", "SELECT item_id, sha256(strip_accents(lower(text))) AS folded_hash FROM items")
def folded_texts(v):
    return v.items().select("item_id", F.sha2(tx.fold_text(F.col("text")), 256).alias("folded_hash"))


@query(
    "expanded_keywords",
    """SELECT item_id, pos, term, length(term) <= 4 AND term = upper(term) AND regexp_matches(term, '[A-Z]') AS acronym FROM (
    SELECT item_id, unnest([w1, source_id, upper(language)]) AS term, unnest([0, 1, 2]) AS pos FROM (
    SELECT item_id, source_id, language, regexp_extract(text, '\\p{L}+') AS w1 FROM items)) WHERE term <> ''""",
)
def expanded_keywords(v):
    entry = F.concat(F.regexp_extract("text", r"\p{L}+", 0), F.lit(" / "), "source_id", F.lit(" ("), F.upper("language"), F.lit(")"))
    rows = v.items().select("item_id", F.posexplode(tx.expand_keyword(entry)).alias("pos", "term"))
    return rows.select("item_id", F.col("pos").cast("bigint").alias("pos"), "term", tx.is_acronym(F.col("term")).alias("acronym"))


TOKENS_SQL = """SELECT item_id, list_filter(regexp_split_to_array(strip_accents(regexp_replace(lower({0}), '([éóèñçüêäöíáúâàîôûëïãõåøğşı])', '\\1 ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 2) AS {1} FROM items"""


@query(
    "token_counts",
    "SELECT item_id, len(toks) AS tokens, len(list_distinct(toks)) AS distinct_tokens FROM tokenised",
    {"tokenised": TOKENS_SQL.format("text", "toks")},
)
def token_counts(v):
    toks = tx.tokens(F.col("text"))
    return v.items().select("item_id", F.size(toks).cast("bigint").alias("tokens"), F.size(F.array_distinct(toks)).cast("bigint").alias("distinct_tokens"))


SIMHASH_VIEWS = {
    "text_tokens": TOKENS_SQL.format("text", "toks"),
    "title_tokens": TOKENS_SQL.format("title", "toks"),
    "weighted": "SELECT item_id, unnest(toks) AS t, 1 AS w FROM text_tokens UNION ALL SELECT item_id, unnest(toks) AS t, 25 AS w FROM title_tokens",
    "hashed": "SELECT item_id, ('0x' || sha256(t)[1:16])::UBIGINT AS h, sum(w) AS w FROM weighted GROUP BY item_id, t",
    "bit_sums": "SELECT item_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) AS s FROM hashed, (SELECT unnest(range(0, 64))::UBIGINT AS b) GROUP BY item_id, b",
    "unsigned_hash": "SELECT item_id, sum(CASE WHEN s > 0 THEN (1::UBIGINT << b)::HUGEINT ELSE 0::HUGEINT END) AS u FROM bit_sums GROUP BY item_id",
    "fingerprints": """SELECT items.item_id, CASE WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::BIGINT ELSE coalesce(u, 0)::BIGINT END AS simhash
        FROM items LEFT JOIN unsigned_hash USING (item_id)""",
}


@query("item_simhash", "SELECT item_id, simhash FROM fingerprints", SIMHASH_VIEWS)
def item_simhash(v):
    return fingerprint.item_fingerprints(v.items())


@query(
    "simhash_steps",
    "SELECT a.item_id, bit_count(xor(a.simhash, b.simhash))::BIGINT AS distance FROM fingerprints a JOIN fingerprints b ON b.item_id = a.item_id + 1",
    SIMHASH_VIEWS,
)
def simhash_steps(v):
    prints = checkpointed(fingerprint.item_fingerprints(v.items()))
    after = prints.select((F.col("item_id") - 1).alias("item_id"), F.col("simhash").alias("next"))
    return prints.join(after, "item_id").select("item_id", vx.hamming(F.col("simhash"), F.col("next")).cast("bigint").alias("distance"))


@query(
    "centroid_cosines",
    """SELECT v.item_id, round(list_cosine_similarity(v.embedding::DOUBLE[], t.embedding), 6) AS cosine, round(sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 4) AS norm,
    round(sqrt(list_dot_product(t.embedding, t.embedding)), 4) AS centroid_norm FROM vectors v JOIN topic_vectors t ON t.topic_id = v.label""",
)
def centroid_cosines(v):
    joined = v.vectors().join(v.topic_vectors().select(F.col("topic_id").alias("label"), F.col("embedding").alias("centroid")), "label")
    return joined.select("item_id", six(vx.cosine(F.col("embedding"), F.col("centroid"))).alias("cosine"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"), F.round(vx.norm(F.col("centroid")), 4).alias("centroid_norm"))


@query(
    "unit_vectors",
    "SELECT item_id, CASE WHEN item_id % 10 <> 0 THEN round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 4) END AS total FROM vectors",
)
def unit_vectors(v):
    scaled = F.transform("embedding", lambda x: F.when(F.col("item_id") % 10 == 0, F.lit(0.0)).otherwise(x * 3))
    total = F.aggregate(vx.unit_vector(scaled), F.lit(0.0), lambda t, x: t + x.cast("double"))
    return v.vectors().select("item_id", F.round(total, 4).alias("total"))


@query(
    "parsed_embeddings",
    "SELECT item_id, CASE item_id % 3 WHEN 2 THEN NULL ELSE 3 END::BIGINT AS dimensions, CASE item_id % 3 WHEN 2 THEN NULL ELSE item_id - 0.25 + 0.5 END::DOUBLE AS total FROM vectors",
)
def parsed_embeddings(v):
    literal = F.when(F.col("item_id") % 3 != 2, F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit(", -0.25,0.5]"))).otherwise(F.lit("not json"))
    parsed = vx.parse_embedding(literal)
    return v.vectors().select("item_id", F.when(parsed.isNotNull(), F.size(parsed)).cast("bigint").alias("dimensions"), F.aggregate(parsed, F.lit(0.0), lambda t, x: t + x).alias("total"))


@query(
    "embedding_inputs",
    """SELECT item_id, length(b) AS chars, sha256(b) AS digest FROM (SELECT item_id, substr(title || chr(10) || chr(10) ||
    array_to_string(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), ' '), 1) AS b FROM items)""",
)
def embedding_inputs(v):
    body = tx.embedding_input(F.col("title"), F.col("text"))
    return v.items().select("item_id", F.char_length(body).cast("bigint").alias("chars"), F.sha2(body, 256).alias("digest"))


@query("initial_statuses", f"SELECT item_id, CASE WHEN published_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'not_relevant' ELSE 'new' END AS status FROM items")
def initial_statuses(v):
    return v.items().select("item_id", scoring.initial_status(F.col("published_at"), AS_OF).alias("status"))


@query("dash_cleaned", "SELECT item_id, trim(regexp_replace(title || ' — ' || source_id, '\\s*[—–]\\s*', ', ', 'g')) AS title FROM items")
def dash_cleaned(v):
    return v.items().select("item_id", tx.dash_clean(F.concat("title", F.lit(" — "), "source_id")).alias("title"))


@query(
    "research_windows",
    f"""SELECT source_id, strftime(CASE WHEN n % 3 = 0 THEN DATE '{AS_OF[:10]}' - 90 ELSE CAST(last_seen AS DATE) END - 3, '%Y-%m-%d') AS since
    FROM sources JOIN (SELECT source_id, max(created_at) AS last_seen FROM items GROUP BY 1) USING (source_id)""",
)
def research_windows(v):
    last = v.items().groupBy("source_id").agg(F.max("created_at").alias("last_seen"))
    since = scoring.research_since(F.when(F.col("n") % 3 != 0, F.col("last_seen")), AS_OF)
    return v.sources().join(last, "source_id").select("source_id", F.date_format(since, "yyyy-MM-dd").alias("since"))


@query(
    "stage_backlogs",
    """SELECT stage, count(*) AS due FROM (
    SELECT unnest(CASE status WHEN 'new' THEN ['extract'] WHEN 'extracted' THEN ['embed'] WHEN 'embedded' THEN ['dedup', 'relevance'] WHEN 'scored' THEN ['cluster', 'group'] ELSE [] END) AS stage, status, original
    FROM (SELECT ['new', 'extracted', 'embedded', 'scored', 'grouped'][CAST(doc_id % 5 + 1 AS BIGINT)] AS status, doc_id % 7 <> 0 AS original FROM documents))
    WHERE original OR stage = 'group' GROUP BY stage
    UNION ALL SELECT 'score', count(*) FILTER (status = 'open' AND story_id % 4 = 0) FROM stories
    UNION ALL SELECT 'enrich', count(*) FILTER (status = 'open' AND story_id % 4 <> 0 AND summary IS NULL) FROM stories
    UNION ALL SELECT 'research', count(*) FILTER (language <> 'en') FROM items""",
)
def stage_backlogs(v):
    status = F.element_at(F.array(*[F.lit(s) for s in ("new", "extracted", "embedded", "scored", "grouped")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = v.table("documents").select("doc_id", status.alias("status"), F.when(F.col("doc_id") % 7 == 0, F.lit(1)).alias("canonical_item_id"))
    flags = F.array_compact(F.array(*[F.when(scoring.stage_due(s), F.lit(s)) for s in ("extract", "embed", "dedup", "relevance", "cluster", "group")]))
    by_item = rows.select(F.explode(flags).alias("stage"))
    stories = v.stories().withColumn("tier", F.when(F.col("story_id") % 4 != 0, F.col("tier")))
    by_story = stories.select(F.explode(F.array_compact(F.array(*[F.when(scoring.stage_due(s), F.lit(s)) for s in ("score", "enrich")]))).alias("stage"))
    research = v.items().select(F.when(F.col("language") == "en", F.lit("a")).alias("argument")).filter(scoring.stage_due("research")).select(F.lit("research").alias("stage"))
    return by_item.unionByName(by_story).unionByName(research).groupBy("stage").agg(F.count("*").alias("due"))


@query(
    "read_minutes",
    """SELECT source_id, sum(len(regexp_split_to_array(text, '\\s+'))) AS words, greatest(3, CAST(floor(sum(len(regexp_split_to_array(text, '\\s+'))) / 200.0 + 0.5) AS BIGINT)) AS minutes FROM items GROUP BY source_id""",
)
def read_minutes(v):
    per_source = v.items().groupBy("source_id").agg(F.sum(tx.word_count(F.col("text"))).alias("words"))
    return per_source.withColumn("minutes", tx.read_minutes(F.col("words")))


@query(
    "item_times",
    f"SELECT item_id, {sql_stamp('published_at')} AS published_at FROM items",
)
def item_times(v):
    """Dates as feeds write them, read back."""
    rows = v.items()
    kind = F.col("item_id") % 3
    written = (
        F.when(kind == 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"))
    )
    return rows.select("item_id", stamp(tx.parse_date(written)).alias("published_at"))
