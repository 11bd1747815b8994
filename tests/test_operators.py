"""Operators against plain reckonings on small fixtures."""

from __future__ import annotations

import datetime as dt
import html
import json
import math
import random
import re
import sys
import unicodedata
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidings.operators import dedup, handoff, languages, match, measures, neighbours, ordered, scorer, search, similarity, stories
from tidings.plans import matching_queries
from tidings.session import checkpointed
from tidings.sources import feeds, pages, sitemaps

START = dt.datetime(2024, 3, 4, 5)


def _originals_one_by_one(rows, hours, near):
    pool, links = [], {}
    for at, item, sig in sorted(rows):
        found = [(a, i) for a, i, s in pool if at - a <= hours * 3600 and near(s, sig)]
        if found:
            links[item] = min(found)[1]
        else:
            pool.append((at, item, sig))
    return links


def _check_hashes(spark, rows):
    made = [(i, START + dt.timedelta(seconds=at), h) for at, i, h in rows]
    df = spark.createDataFrame(made, "item_id bigint, published_at timestamp, simhash bigint")
    got = {r[0]: r[1] for r in dedup.canonical_items(df, dedup.Nearness(48, 3, None)).collect() if r[1] is not None}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert got == _originals_one_by_one(rows, 48, near)


def _family_rows(count):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(count):
        h = base[0] if i % 3 == 0 else rng.choice(base)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(63)
        rows.append((rng.randrange(10 * 24 * 3600), i, h))
    return rows


def test_originals_in_rounds(spark):
    _check_hashes(spark, _family_rows(250))


def test_originals_of_a_long_chain_and_a_hot_group(spark):
    hot = [(i * 7919 % (9 * 24 * 3600), i, 12345) for i in range(400)]
    chain = [(1000 + i, 1000 + i, (1 << 2 * i) - 1) for i in range(20)]
    _check_hashes(spark, hot + chain)


def _unit(v):
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v]


def test_vectors_meet_in_cells_without_loss(spark):
    """Clustered vectors on a tree of many cells, few of which a vector reaches."""
    rng = random.Random(8)
    centers = [_unit([rng.gauss(0, 1) for _ in range(16)]) for _ in range(40)]
    rows = []
    for i in range(1200):
        v = _unit([x + rng.gauss(0, 0.05) for x in rng.choice(centers)])
        rows.append((rng.randrange(6 * 24 * 3600), i, [float(np.float32(x)) for x in v]))
    made = [(i, START + dt.timedelta(seconds=at), v) for at, i, v in rows]
    df = spark.createDataFrame(made, "item_id bigint, published_at timestamp, embedding array<float>")
    got = {r[0]: r[1] for r in dedup.canonical_items(df, dedup.Nearness(48, None, 0.97)).collect() if r[1] is not None}
    assert got == _originals_one_by_one(rows, 48, lambda a, b: sum(x * y for x, y in zip(a, b)) >= 0.97)
    radius = neighbours.chord(0.97)
    placed = neighbours.place(checkpointed(df.withColumnRenamed("embedding", "unit")), "item_id", "unit", radius)
    assert len(placed.tree.lower) == math.ceil(math.sqrt(1200)) and placed.share < 0.2
    cells = placed.rows.select(placed.reach(F.col("unit"), radius).alias("c"), "home").collect()
    assert all(r["home"] in r["c"] for r in cells) and sum(len(r["c"]) for r in cells) / len(cells) < 0.25 * len(placed.tree.lower)


def test_tree_reaches_every_near_vector():
    draw = np.random.default_rng(4)
    block = draw.normal(size=(600, 5))
    block[100:160] = block[100]
    block /= np.sqrt((block**2).sum(axis=1))[:, None]
    tree = neighbours.PivotTree(np.unique(block[:120], axis=0))
    home, apart = tree.homes(block)
    tree.rings = np.array([[apart[home == c].min() - 1e-6, apart[home == c].max() + 1e-6] if (home == c).any() else [np.inf, -np.inf] for c in range(len(tree.lower))])
    for radius in (0.05, 0.3, 1.0):
        row, cell = tree.reached(block, radius)
        reached = set(zip(row.tolist(), cell.tolist()))
        near = np.sqrt(((block[:, None] - block[None]) ** 2).sum(axis=2)) <= radius
        assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(near)))


def test_without_structure_all_share_one_cell(spark):
    draw = np.random.default_rng(4)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(draw.normal(size=(300, 64)))] + [(300, None)]
    placed = neighbours.place(checkpointed(spark.createDataFrame(rows, "item_id bigint, unit array<double>")), "item_id", "unit", neighbours.chord(0.2))
    assert placed.tree is None and placed.rows.select("home").distinct().count() == 2


def test_crowded_vectors_are_swept_in_slices(spark):
    """Vectors without cells: slices of the timeline, longer and shorter than the window, ids that repeat,
    and as many steps as slices however long the chains are."""
    rng = random.Random(5)
    rows = [(rng.randrange(8 * 24) * 3600, i, [float(np.float32(x)) for x in _unit([rng.gauss(0, 1) for _ in range(8)])]) for i in range(900)]
    expected = _originals_one_by_one(rows, 48, lambda a, b: sum(x * y for x, y in zip(a, b)) >= 0.6)
    made = [(i, at * 1_000_000, v) for at, i, v in rows] + [(900, 0, None), (None, 0, rows[0][2])]
    made += [made[7], made[8], made[8]]
    rule = dedup.Nearness(48, None, 0.6)
    for kind, size in (("bigint", 220), ("string", 500)):
        name = (lambda i: i) if kind == "bigint" else (lambda i: None if i is None else f"n{i:04d}")
        df = checkpointed(spark.createDataFrame([(name(i), at, v) for i, at, v in made], f"item_id {kind}, at bigint, unit array<float>"))
        assert {r[0]: r[1] for r in dedup.swept(df, rule, size).collect()} == {name(a): name(b) for a, b in expected.items()}
    stamped = [(i, None if at is None else START + dt.timedelta(microseconds=at), v) for i, at, v in made]
    placed, crowded = rule.placed(spark.createDataFrame(stamped, "item_id bigint, published_at timestamp, embedding array<float>"))
    assert crowded and placed.count() == len(made)


def test_new_stories_take_no_id_in_use(spark):
    """Item 6 joins the open story 5; the unlike item 5 opens another story."""
    items = spark.createDataFrame([(5, START, [1.0, 0.0]), (6, START, [0.0, 1.0])], "item_id bigint, published_at timestamp, embedding array<double>")
    open_stories = spark.createDataFrame([(5, [0.0, 1.0], START)], "story_id bigint, centroid array<double>, last_updated_at timestamp")
    none = spark.createDataFrame([], "item_id bigint, story_id bigint, same boolean")
    got = {r["item_id"]: (r["story_id"], r["is_new"]) for r in similarity.cluster_batch(items, open_stories, none, 0.9, 0.8).collect()}
    assert got[6] == (5, False) and got[5][1] and got[5][0] != 5
    named = open_stories.selectExpr("'a' as story_id", "centroid", "last_updated_at")
    got = {r["item_id"]: r["story_id"] for r in similarity.cluster_batch(items, named, none.selectExpr("item_id", "'a' as story_id", "same"), 0.9, 0.8).collect()}
    assert got[6] == "a" and got[5].startswith("s")


def test_matches_are_near_in_content_and_time(spark):
    hour = dt.timedelta(hours=1)
    rng = random.Random(3)
    base, axes = [rng.getrandbits(60) for _ in range(4)], [[float(i == j) for j in range(4)] for i in range(4)]
    pool_rows = [(i, START + rng.randrange(200) * hour, base[i % 4] ^ (1 << rng.randrange(60)), axes[(i + 1) % 4]) for i in range(30)]
    item_rows = [(100 + i, START + rng.randrange(200) * hour, base[rng.randrange(4)] ^ (rng.getrandbits(60) if i % 5 == 0 else 1 << rng.randrange(60)), axes[rng.randrange(4)]) for i in range(60)]
    schema = "item_id bigint, published_at timestamp, simhash bigint, embedding array<double>"
    got = {r[0]: r[1] for r in dedup.canonical_match(spark.createDataFrame(item_rows, schema), spark.createDataFrame(pool_rows, schema), dedup.Nearness(48, 8, 0.95)).collect()}
    want = {}
    for i, at, h, v in item_rows:
        near = [(p_at, p) for p, p_at, p_h, p_v in pool_rows if abs(at - p_at) <= 48 * hour and (bin(h ^ p_h).count("1") <= 8 or v == p_v)]
        if near:
            want[i] = min(near)[1]
    assert got == want


def test_best_story_of_each_item(spark):
    rng = random.Random(4)
    vector = lambda: [rng.gauss(0, 1) for _ in range(3)]
    story_rows = [(i, vector(), START + dt.timedelta(hours=rng.randrange(200))) for i in range(25)] + [(25, [0.0, 0.0, 0.0], START)]
    item_rows = [(i, vector(), START + dt.timedelta(hours=rng.randrange(200))) for i in range(60)]
    stories_df = spark.createDataFrame(story_rows, "story_id bigint, centroid array<double>, last_updated_at timestamp")
    items_df = spark.createDataFrame(item_rows, "item_id bigint, embedding array<double>, published_at timestamp")

    def cosine(a, b):
        length = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / length if length else 0.0

    want = {}
    for i, v, at in item_rows:
        near = [(round(cosine(v, c), 9), -s) for s, c, t in story_rows if abs(at - t) <= dt.timedelta(hours=72) and cosine(v, c) >= 0.7]
        best = max(near, default=None)
        want[i] = (None, None, "new") if best is None else (-best[1], best[0], "attach" if best[0] >= 0.9 else "confirm")
    for block in (1000, 4):
        got = {r["item_id"]: (r["story_id"], None if r["cosine"] is None else round(r["cosine"], 9), r["action"]) for r in similarity.best_stories(items_df, stories_df, 0.9, 0.7, block=block).collect()}
        assert got == want


def test_languages_by_trigrams(spark):
    rng = random.Random(6)
    parts = {"aa": ["kat", "mol", "tiv", "ros"], "bb": ["schu", "lung", "weg", "ich"], "cc": ["éa", "oui", "çon", "ment"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, lang, text(lang, 40)) for i, lang in enumerate("aa bb cc".split() * 30)]
    odd = [(900, None, text("aa", 10)), (901, "aa", None), (902, "aa", ""), (903, "aa", "12 !"), (904, "bb", text("bb", 30_000)), (None, "cc", text("cc", 9))]
    schema = "item_id bigint, language string, text string"
    items = spark.createDataFrame(rows + odd, schema)
    names, profiles = languages.language_profiles(items.filter("item_id % 3 <> 1 or item_id < 60"), 15)
    assert names == ["aa", "bb", "cc"] and profiles.filter("odds[0] < 0 and odds[1] < 0 and odds[2] < 0").count() == 0
    judged = languages.by_trigrams(items, names, profiles, "xx")
    got = {r["item_id"]: r["detected"] for r in judged.collect()}
    assert all(got[i] == lang for i, lang, _ in rows) and got[900] == "aa" and got[904] == "bb"
    assert got[901] == got[902] == got[903] == "xx" and len(got) == 96
    found = {r["language"]: (r["texts"], r["agreeing"]) for r in languages.agreement(judged, items).collect()}
    assert found["bb"] == (31, 31) and found["aa"] == (33, 30)
    assert languages.language_profiles(items.limit(0))[0] == [] and languages.by_trigrams(items, [], profiles).filter("detected is null").count() == 96


def test_cluster_agreement_against_all_pairs(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 0, 0, 1, 2, None]), rng.choice([0, 1, 1, None])) for i in range(120)]
    found = spark.createDataFrame([(i, a) for i, a, _ in rows] + [(0, rows[0][1]), (500, 1)], "item_id bigint, cluster bigint")
    truth = spark.createDataFrame([(i, b) for i, _, b in rows] + [(600, 1)], "item_id bigint, cluster bigint")
    pairs = [(x, y) for n, x in enumerate(rows) for y in rows[n + 1 :]]
    same = lambda x, y, k: x[k] is not None and x[k] == y[k]
    a, b, c = (sum(t(x, y) for x, y in pairs) for t in (lambda x, y: same(x, y, 1), lambda x, y: same(x, y, 2), lambda x, y: same(x, y, 1) and same(x, y, 2)))
    got = measures.cluster_agreement(found, truth).first()
    assert (got["found_pairs"], got["true_pairs"], got["common_pairs"]) == (a, b, c)
    assert abs(got["precision"] - c / a) < 1e-12 and abs(got["recall"] - c / b) < 1e-12 and abs(got["f1"] - 2 * c / (a + b)) < 1e-12
    assert tuple(measures.cluster_agreement(found.limit(0), truth).first()) == (0, 0, 0, None, None, None)


def test_words_are_counted_by_stem(spark):
    docs = [(1, "en", "Running runs, hopping hopped hops! parties party"), (2, "en", "run; RUNNING ran hop"), (3, "tr", "kitaplar kitap evlerde evler"), (4, None, "cats"), (5, "en", None), (6, "en", "")]
    got = {(r["language"], r["stem"]): (r["n"], r["items"], r["words"]) for r in search.stem_counts(spark.createDataFrame(docs, "item_id bigint, language string, body string")).collect()}
    assert got[("en", "run")] == (4, 2, 3) and got[("en", "hop")] == (4, 2, 4) and got[("en", "parti")] == (2, 1, 2)
    assert got[("tr", "kitap")] == (2, 1, 2) and got[("tr", "ev")] == (2, 1, 2) and got[(None, "cat")] == (1, 1, 1) and got[("en", "ran")] == (1, 1, 1)


def test_few_shot_keeps_all_stories_of_a_topic(spark):
    signals = [(i, "story", i % 150, "relevant", START + dt.timedelta(minutes=i)) for i in range(300)]
    feedback = spark.createDataFrame(signals, "feedback_id bigint, target_type string, target_id bigint, signal string, created_at timestamp")
    topics, links = spark.range(150).selectExpr("id as story_id", "7 as topic_id"), spark.range(150).selectExpr("id as story_id", "id as item_id")
    items = spark.range(150).selectExpr("id as item_id", "concat('t', id) as title")
    assert handoff.few_shot(feedback, topics, links, items, ("relevant",)).first()["titles"] == [f"t{i}" for i in range(149, -1, -1)]
    assert handoff.few_shot(feedback, topics, links, items, ("relevant",), 3).first()["titles"] == ["t149", "t148", "t147"]


def test_keywords_against_word_lists(spark):
    rng = random.Random(5)
    vocabulary = ["tin", "tinsel", "Oslo", "ÖBB", "rail", "railway", "sea", "señal", "EU", "eu"]
    topics = [(1, ["tin", "rail"], []), (2, ["EU"], ["sea"]), (3, ["Senal / Oslo", "river (EU)"], []), (4, [], ["tin"]), (5, ["öbb"], ["EU"])]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))) + rng.choice(["", ".", "-EU"]) for _ in range(120)]
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))

    def holds(text, term):
        whole = len(term) <= 4 and term == term.upper()
        side, needle = (text, term) if whole else (fold(text), fold(term))
        cut = re.split(r"[^\w]+", side)
        return needle in cut if whole else any(w.startswith(needle) for w in cut)

    want = {}
    for i, text in enumerate(texts):
        for topic, keywords, exclusions in topics:
            terms = [p for k in keywords for e in k.split(" / ") for p in ([e] if "(" not in e else [e.split(" (")[0], e.split("(")[1][:-1]])]
            found = [t for t in dict.fromkeys(terms) if holds(text, t)]
            if found and not any(holds(text, e) for e in exclusions):
                want[(i, topic)] = found
    items_df = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    topics_df = spark.createDataFrame(topics, "topic_id bigint, keywords array<string>, exclusions array<string>")
    for block in (1000, 2):
        assert {(r[0], r[1]): r[2] for r in match.keyword_hits(items_df, topics_df, block).collect()} == want
    assert match.keyword_hits(items_df, topics_df.limit(0)).count() == 0


def test_running_totals_split_a_hot_group(spark):
    rows = [(0 if i % 3 else i % 5, i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, x bigint")
    got = {(r["g"], r["i"]): r["s"] for r in ordered.running_totals(df, ["g"], ["i"], {"s": F.col("x")}).collect()}
    total, want = {}, {}
    for g, i, x in rows:
        total[g] = total.get(g, 0) + x
        want[(g, i)] = total[g]
    assert got == want


def test_grouping_settles_claims_in_order(spark):
    rng = random.Random(6)
    size, known = 12, 3
    batch_rows = [(b, i, b * 100 + i, f"own {b}/{i}", f"note {i}" if i % 2 else None) for b in range(6) for i in range(size)]
    event_rows = [(b, e, b * 10 + e) for b in range(6) for e in range(known)]
    answers = [(b, [(rng.randrange(size + 2), rng.randrange(known + 2)) for _ in range(4)], [([rng.randrange(size + 2) for _ in range(3)], rng.choice(["", f"new {n}"]), f"text {n}", n + 1) for n in range(2)]) for b in range(5)]
    want = {}
    for b, assign, events in answers:
        taken = set()
        for i, e in assign:
            if i < size and e < known and i not in taken:
                taken.add(i)
                want[b * 100 + i] = b * 10 + e
        for n, (members, _, _, _) in enumerate(events):
            for i in members:
                if i < size and i not in taken:
                    taken.add(i)
                    want[b * 100 + i] = ("new", b, n)
    schema = "batch_no bigint, assign array<struct<i: bigint, e: bigint>>, new_events array<struct<items: array<bigint>, title: string, summary: string, tier: bigint>>"
    resolved = stories.resolve_grouping(
        spark.createDataFrame(batch_rows, "batch_no bigint, idx bigint, item_id bigint, title string, standfirst string"), spark.createDataFrame(event_rows, "batch_no bigint, idx bigint, story_id bigint"), spark.createDataFrame(answers, schema)
    ).collect()
    assert sorted(r["item_id"] for r in resolved) == sorted(r[2] for r in batch_rows)
    for r in resolved:
        claim = want.get(r["item_id"])
        if isinstance(claim, int):
            assert r["story_id"] == claim
        elif claim:
            assert (r["story_id"], r["batch_no"], r["new_no"]) == (None, claim[1], claim[2])
        else:
            assert r["story_id"] is None and r["new_no"] >= 1_000_000 and r["title"].startswith("own")


def test_story_ids_of_two_runs_differ_and_repeat(spark):
    schema = "item_id bigint, batch_no bigint, story_id bigint, new_no bigint, title string, summary string, tier bigint"
    topics = spark.createDataFrame([], "item_id bigint, topic_id bigint")
    run = lambda first: spark.createDataFrame([(first + i, 0, None, i // 2, "t", "s", 1) for i in range(6)], schema)
    ids = [sorted(r["story_id"] for r in stories.grouping_writes(run(first), topics)[0].collect()) for first in (0, 0, 50)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3 and not set(ids[0]) & set(ids[2])


def test_sitemap_entries_and_their_dates(spark):
    rows = [("https://n.example/2020/05/06/x", "2021-01-01", None, None), ("https://n.example/y?a=1&b=2", "2021-01-02", "2021-02-03", "Named & dated"), ("https://n.example/z", None, None, None)]
    wrap = lambda tag, value: "" if value is None else f"<{tag}>{html.escape(value)}</{tag}>"
    xml = "<urlset>" + "".join(f"<url>{wrap('loc', u)}{wrap('lastmod', m)}{wrap('news:publication_date', n)}{wrap('news:title', t)}</url>" for u, m, n, t in rows) + "</urlset>"
    got = [tuple(r) for r in sitemaps.sitemap_entries(spark.createDataFrame([("s", xml)], "sitemap string, body string")).orderBy("pos").select("url", "date", "title").collect()]
    assert got == [(rows[0][0], "2020-05-06", None), (rows[1][0], "2021-02-03", "Named & dated"), (rows[2][0], None, None)]


def test_many_children_keep_their_order(spark):
    """Twelve children of an index, each with an entry: the first places are those of the newest."""
    days = [f"2024-01-{n + 10:02d}" for n in range(12)]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://n.example/c{n}.xml</loc><lastmod>{d}</lastmod></sitemap>" for n, d in enumerate(days)) + "</sitemapindex>"
    leaves = [(f"https://n.example/c{n}.xml", f"<urlset><url><loc>https://n.example/p{n}</loc><lastmod>{d}</lastmod></url></urlset>") for n, d in enumerate(days)]
    bodies = spark.createDataFrame([("https://n.example/i.xml", index), *leaves], "sitemap string, body string")
    roots = spark.createDataFrame([("s", "https://n.example/i.xml", None)], "source_id string, sitemap string, link_pattern string")
    found = sitemaps.collected_entries(roots, bodies, "2024-01-01").orderBy("order", "pos").collect()
    assert [r["url"] for r in found] == [f"https://n.example/p{n}" for n in reversed(range(12))]


def test_listing_links_of_a_page(spark):
    parts = [("/news/a", "First story here"), ("/news/a", "First"), ("/about", "About"), ("https://away.example/news/b", "Away"), ("../news/c", "→ Third &amp; last"), ("#x", "jump"), ("/news/d#end", "Fourth")]
    page = "".join(f"<a class=k href='{h}'><span>{t}</span></a>" for h, t in parts)
    listing = spark.createDataFrame([("s", "https://p.example/section/", page, "^/news/[a-z]$")], "source_id string, url string, html string, link_pattern string")
    got = [(r["rank"], r["url"], r["text"]) for r in pages.listing_links(listing).orderBy("rank").collect()]
    assert got == [(1, "https://p.example/news/a", "First story here"), (2, "https://p.example/news/c", "Third & last"), (3, "https://p.example/news/d", "Fourth")]


def test_feeds_cut_off_anywhere_keep_their_whole_items(spark):
    body = "<rss>" + "".join(f"<item><title>Item {n}</title><link>https://f.example/{n}</link><description>&lt;i&gt;text&lt;/i&gt; {n}</description></item>" for n in range(6)) + "</rss>"
    cuts = [(str(n), body[:n]) for n in range(0, len(body), 37)]
    rows = feeds.rss_items(spark.createDataFrame(cuts, "source_id string, body string")).collect()
    for name, cut in cuts:
        own = sorted((r["pos"], r["title"], r["url"], r["standfirst"]) for r in rows if r["source_id"] == name)
        assert own == [(n, f"Item {n}", f"https://f.example/{n}", f"text {n}") for n in range(cut.count("</item>"))]


def test_word_ranks_against_plain_reckoning(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["alder", "birch", "cedar", "x"]) for _ in range(rng.randrange(1, 400))) for _ in range(25)]
    queries = spark.createDataFrame([(1, "alder"), (2, "alder birch"), (3, "cedar or birch"), (4, '"birch cedar" -x')], "query_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, body string")
    got = {(r["query_id"], r["item_id"]): (r["matched"], r["rank"]) for r in search.text_ranks(docs, queries).collect()}
    series = lambda n: sum(0.1 / i**2 for i in range(1, n + 1)) / 1.64493406685
    for i, text in enumerate(texts):
        words = text.split()
        at = {w: [p for p, x in enumerate(words) if x == w] for w in ("alder", "birch", "cedar", "x")}
        if at["alder"]:
            assert abs(got[(1, i)][1] - series(len(at["alder"]))) < 1e-9
        if at["alder"] or at["birch"]:
            miss = 1.0
            for a in at["alder"]:
                for b in at["birch"]:
                    if abs(a - b) <= 100:
                        miss *= 1 - 0.1 * (1 / (1.005 + 0.05 * math.exp(abs(a - b) / 1.5 - 2))) ** 0.5
            assert got[(2, i)][0] == bool(at["alder"] and at["birch"]) and abs(got[(2, i)][1] - (1 - miss)) < 1e-9
        if at["birch"] or at["cedar"]:
            assert abs(got[(3, i)][1] - (series(len(at["birch"])) + series(len(at["cedar"]))) / 2) < 1e-9
        if (4, i) in got:
            assert got[(4, i)][0] == ("birch cedar" in text and "x" not in words)


def test_blocks_that_cannot_hold_better_items_are_skipped(monkeypatch):
    """Blocks in falling order of their cosines: once k are kept, the words of the others are not read."""
    read, made = [], scorer.Postings.__init__
    monkeypatch.setattr(scorer.Postings, "__init__", lambda self, texts, numbers: read.append(1) or made(self, texts, numbers))
    asked = {"query_ids": [7, 8], "query_units": [1.0, 0.0, 0.0, 1.0], "query_haves": [True, True], "termss": ['[[{"negated":false,"words":["oak"]}]]', '[[{"negated":false,"words":["elm"]}]]']}
    blocks = []
    for b in range(20):
        angle = 0.05 * b
        blocks.append({"item_ids": [3 * b, 3 * b + 1, 3 * b + 2], "units": [math.cos(angle), math.cos(angle)] * 3, "haves": [True] * 3, "longs": ["oak elm", "oak", ""], "shorts": ["oak", "", ""], **asked})
    parts = list(scorer.best_items(4)(iter([pd.DataFrame([b]) for b in blocks])))
    got = {p["query_id"][0]: list(zip(p["item_id"], p["score"].round(9))) for p in parts}
    word = lambda n: 0.4 * 0.1 / 1.64493406685 * n
    assert got[7] == [(0, round(0.6 + word(1), 9)), (1, round(0.6 + word(1), 9)), (3, round(0.6 * math.cos(0.05) + word(1), 9)), (4, round(0.6 * math.cos(0.05) + word(1), 9))]
    assert got[8][0] == (0, round(0.6 + word(1), 9)) and 2 <= len(read) // 2 < 12


def test_long_chains_of_fingerprints_take_few_steps(spark, monkeypatch):
    """Copies all along the timeline, near ones of several fingerprints among them: the tables written do
    not grow with the windows that a chain passes, and very large groups go in rounds with equal results."""
    rng, hour, mask = random.Random(13), 3600, 2**64 - 1
    bases = [rng.getrandbits(64) for _ in range(6)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    flipped = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
    rows = [(30 * n * hour, n, signed(bases[0])) for n in range(60)]
    rows += [(rng.randrange(1800) * hour, 100 + n, signed(flipped(rng.choice(bases)))) for n in range(300)]
    rule, written = dedup.Nearness(48, 3, None), []
    monkeypatch.setattr(dedup, "checkpointed", lambda df: written.append(1) or checkpointed(df))

    def check(rows, again=0):
        frame = spark.createDataFrame([(i, START + dt.timedelta(seconds=at), h) for at, i, h in rows + rows[:again]], "item_id bigint, published_at timestamp, simhash bigint")
        got = {r[0]: r[1] for r in dedup.canonical_items(frame, rule).collect() if r[1] is not None}
        assert got == _originals_one_by_one(rows, 48, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)

    check(rows)
    assert len(written) < 30
    monkeypatch.setattr(dedup, "BUCKET", 2)
    check(rows, 40)
    monkeypatch.setattr(dedup, "GROUP", 10)
    check(rows[:8] + rows[60:140])


def test_matches_of_a_long_chain_take_few_steps(spark, monkeypatch):
    """Equal texts every 30 hours: every second one is an original, the others match the one before."""
    rows = [(n, "same title", "same text of all", START + dt.timedelta(hours=30 * n)) for n in range(60)]
    frame, written = spark.createDataFrame(rows, "item_id bigint, title string, text string, published_at timestamp"), []
    monkeypatch.setattr(dedup, "checkpointed", lambda df: written.append(1) or checkpointed(df))
    got = matching_queries.canonical_matches(SimpleNamespace(items=lambda: frame)).collect()
    assert {r[0]: r[1] for r in got} == {n: n - 1 for n in range(1, 60, 2)} and len(written) < 30


def test_searches_rank_only_items_that_could_be_among_the_best(monkeypatch):
    """Plain words: of 1,500 items a search ranks few, and has the best ones of ranking all."""
    rng, ranked, made = random.Random(12), [], scorer.close_ranks
    monkeypatch.setattr(scorer, "close_ranks", lambda postings, words, *rows: ranked.append(len(rows[0]) if rows else postings.items) or made(postings, words, *rows))
    common = [f"c{n}" for n in range(6)]
    longs = [" ".join(rng.choice([*common, f"r{rng.randrange(400)}"]) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]
    shorts = [" ".join(t.split(" ")[:4]) for t in longs]
    units = [(math.cos(x), math.sin(x)) if n % 3 == 0 else None for n, x in enumerate(rng.uniform(0, 6) for _ in range(1500))]
    texts = [" ".join(rng.sample(common, 2)) if q % 2 else f"r{q} c{q % 6} r{q + 1}" for q in range(60)]
    vectors = [(math.cos(q), math.sin(q)) if q % 4 > 1 else None for q in range(60)]
    flat = lambda vs: [x for v in vs if v for x in v]
    termss = [json.dumps([[{"negated": False, "words": [w]} for w in t.split(" ")]]) for t in texts]
    asked = {"query_ids": list(range(60)), "query_units": flat(vectors), "query_haves": [v is not None for v in vectors], "termss": termss}
    blocks = [{"item_ids": list(range(a, a + 500)), "units": flat(units[a : a + 500]), "haves": [v is not None for v in units[a : a + 500]], "longs": longs[a : a + 500], "shorts": shorts[a : a + 500], **asked} for a in (1000, 0, 500)]
    got = {p["query_id"][0]: list(zip(p["item_id"].tolist(), p["score"].round(9))) for p in scorer.best_items(5)(iter([pd.DataFrame([b]) for b in blocks]))}
    assert sum(ranked) < 2 * 60 * 1500 / 3
    numbers: dict = {}
    searches = [scorer.Search(json.loads(t), numbers) for t in termss]
    long, short = scorer.Postings(longs, numbers), scorer.Postings(shorts, numbers)
    for q, search in enumerate(searches):
        (a, in_a), (b, in_b) = search.ranks(long), search.ranks(short)
        both = [vectors[q] is not None and u is not None for u in units]
        score = [(0.6 * (vectors[q][0] * u[0] + vectors[q][1] * u[1]) if v else 0.0) + 0.4 * max(x, y) for u, v, x, y in zip(units, both, a, b)]
        best = sorted((-s, n) for n, s in enumerate(score) if both[n] or in_a[n] or in_b[n])[:5]
        assert got.get(q, []) == [(n, round(-s, 9)) for s, n in best]


def _plain_searches(rng, count):
    texts = [" ".join(rng.sample([f"c{n}" for n in range(8)], 1 + q % 3) + [f"r{rng.randrange(300)}"] * (q % 2)) for q in range(count)]
    vectors = [(math.cos(q), math.sin(q)) if q % 4 == 0 else None for q in range(count)]
    return texts, vectors


def _mixed_items(rng, count):
    words = lambda most: " ".join(rng.choice([*[f"c{n}" for n in range(8)], f"r{rng.randrange(300)}"]) for _ in range(rng.randrange(most)))
    return [(n, words(6), words(80), words(3), [math.cos(1.37 * n), math.sin(1.37 * n)] if n % 3 else None) for n in range(count)]


def test_searches_meet_a_block_together():
    """One more block of items takes few calls, however many searches look at it, and ranks are those of
    each search alone."""
    rng = random.Random(14)
    texts, vectors = _plain_searches(rng, 1200)
    termss = [json.dumps([[{"negated": False, "words": [w]} for w in t.split(" ")]]) for t in texts]
    asked = {"query_ids": list(range(1200)), "query_units": [x for v in vectors if v for x in v], "query_haves": [v is not None for v in vectors], "termss": termss}
    items = _mixed_items(rng, 800)
    blocks = []
    for own in (items[:300], items[300:550], items[550:]):
        blocks.append({"item_ids": [i[0] for i in own], "units": [x for i in own if i[4] for x in i[4]], "haves": [i[4] is not None for i in own], "longs": [f"{i[1]} {i[2]}" for i in own], "shorts": [f"{i[1]} {i[3]}" for i in own], **asked})
    calls, found = [], []
    for count in (1, 3):
        made = [0]
        sys.setprofile(lambda frame, event, _: event == "call" and frame.f_code.co_filename == scorer.__file__ and made.__setitem__(0, made[0] + 1))
        try:
            found = list(scorer.best_items(5)(iter([pd.DataFrame([b]) for b in blocks[:count]])))
        finally:
            sys.setprofile(None)
        calls.append(made[0])
    assert calls[1] - calls[0] < 1200
    got: dict = {}
    for part in found:
        for q, i, score in part.itertuples(index=False):
            got.setdefault(q, []).append((i, round(score, 9)))
    numbers: dict = {}
    searches = [scorer.Search(json.loads(t), numbers) for t in termss]
    both = [scorer.Postings([f"{i[1]} {i[2 + n]}" for i in items], numbers) for n in (0, 1)]
    for q in range(0, 1200, 7):
        (long, in_long), (short, in_short) = (searches[q].ranks(p) for p in both)
        near = [vectors[q] is not None and i[4] is not None for i in items]
        score = [(0.6 * (vectors[q][0] * i[4][0] + vectors[q][1] * i[4][1]) if v else 0.0) + 0.4 * max(x, y) for i, v, x, y in zip(items, near, long, short)]
        best = sorted((-s, n) for n, s in enumerate(score) if near[n] or in_long[n] or in_short[n])[:5]
        assert got.get(q, []) == [(n, round(-s, 9)) for s, n in best]


def test_items_drawn_first_do_not_change_the_best(spark, monkeypatch):
    """Several draws and several blocks of searches give the rows of one pass over all items."""
    rng = random.Random(15)
    texts, vectors = _plain_searches(rng, 90)
    items = spark.createDataFrame(_mixed_items(rng, 700), "item_id bigint, title string, text string, standfirst string, embedding array<double>")
    queries = spark.createDataFrame([(q, t, list(v) if v else None) for q, (t, v) in enumerate(zip(texts, vectors))], "query_id bigint, text string, embedding array<double>")
    rows = lambda: sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in search.hybrid_search(items, queries, 6).collect())
    whole, known, made = rows(), [], scorer.Asked.know
    monkeypatch.setattr(scorer.Asked, "know", lambda self, floors: known.append(len(floors)) or made(self, floors))
    monkeypatch.setattr(search, "FIRST_ITEMS", 20)
    monkeypatch.setattr(search, "SEARCH_BLOCK", 50)
    assert rows() == whole and len(known) == 4 and all(known)


def test_searches_over_odd_items(spark):
    items = spark.createDataFrame([(1, None, None, None, None), (2, "", "", "", [0.0, 0.0]), (3, "Oak", None, "elm", [1.0, 0.0]), (4, "elm", "oak oak", None, None)], "item_id bigint, title string, text string, standfirst string, embedding array<double>")
    queries = spark.createDataFrame([(1, "oak", None), (2, "", [1.0, 0.0]), (3, "-oak", None), (4, '"oak oak"', None), (5, "oak elm", [0.0, 0.0])], "query_id bigint, text string, embedding array<double>")
    rows = search.hybrid_search(items, queries, 10).collect()
    got = {q: sorted((r["rank"], r["item_id"]) for r in rows if r["query_id"] == q) for q in range(1, 6)}
    assert got[1] == [(1, 4), (2, 3)] and got[2] == [(1, 3), (2, 2)] and got[3] == [] and got[4] == [(1, 4)]
    assert [i for _, i in got[5]][0] in (3, 4) and {i for _, i in got[5]} == {2, 3, 4}
    assert search.hybrid_search(items.limit(0), queries, 3).count() == 0 and search.hybrid_search(items, queries.limit(0), 3).count() == 0
    assert {(r["query_id"], r["item_id"], r["matched"]) for r in search.text_ranks(items.selectExpr("item_id", "title as body"), queries).collect()} == {(1, 3, True), (3, 3, False), (4, 3, False), (5, 3, False), (5, 4, False)}


def test_search_of_many_queries_has_one_plan(spark):
    rng = random.Random(11)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    item_rows = [(i, f"t{i % 7} common", f"body {i % 5}", None, vector() if i % 6 else None) for i in range(300)]
    query_rows = [(q, f"t{q % 9}", vector() if q % 4 else None) for q in range(700)]
    items_df = spark.createDataFrame(item_rows, "item_id bigint, title string, text string, standfirst string, embedding array<double>")
    queries_df = spark.createDataFrame(query_rows, "query_id bigint, text string, embedding array<double>")
    plan = lambda n: search.hybrid_search(items_df, queries_df.filter(f"query_id < {n}"), 5)._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas")
    assert plan(5) == plan(700)
    got = {}
    for r in search.hybrid_search(items_df, queries_df, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], round(r["score"], 9)))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for q, text, v in query_rows[::23]:
        scored = []
        for i, title, _, _, e in item_rows:
            rank = 0.1 / 1.64493406685 if title.split()[0] == text else 0.0
            if rank or (v is not None and e is not None):
                scored.append((-round(0.6 * (cosine(v, e) if v is not None and e is not None else 0.0) + 0.4 * rank, 9), i))
        want = [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:5])]
        assert sorted(got.get(q, [])) == want


def test_answers_are_checked(spark):
    fine = {"assign": [{"i": 1, "e": 0}], "new_events": [{"items": [2], "title": "t", "summary": "s", "tier": 2}]}
    broken = [
        json.dumps({**fine, "new_events": [{**fine["new_events"][0], "tier": 0}]}),
        json.dumps({**fine, "new_events": [{**fine["new_events"][0], "items": []}]}),
        json.dumps({"new_events": fine["new_events"]}),
        json.dumps(fine)[:-3],
        "no answer",
    ]
    good = [json.dumps(fine), "Sure:\n" + json.dumps(fine) + "\nThat is all.", json.dumps({"assign": [], "new_events": []})]
    answers = spark.createDataFrame(list(enumerate(good + broken)), "batch_no bigint, answer string")
    kept, rejected = handoff.parsed_answers(answers, handoff.GROUP_ANSWER, handoff.group_valid)
    assert sorted(r["batch_no"] for r in kept.collect()) == [0, 1, 2]
    assert sorted(r["batch_no"] for r in rejected.collect()) == [3, 4, 5, 6, 7]


def test_sources_without_a_url_are_broken_and_only_feeds_go_stale(spark):
    rows = [(1, "a", START, True, True, "u", "rss"), (2, "b", START, True, True, "u", "sitemap"), (3, "c", START, True, False, None, "rss"), (4, "d", START, True, False, "u", "rss")]
    log = spark.createDataFrame(rows, "fetch_id bigint, source_id string, at timestamp, ok boolean, stale boolean, url string, type string")
    assert {r["source_id"]: r["health_status"] for r in measures.fetch_health(log).collect()} == {"a": "degraded", "b": "ok", "c": "broken", "d": "ok"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_item_and_word_stay_where_they_are(spark):
    docs = spark.createDataFrame([(1, "en", "cats and cat"), (2, "en", "cat runs"), (2, "en", "cats"), (3, None, "running")], "item_id bigint, language string, body string")
    places = search.word_places(docs)
    assert _plan(places).count("Exchange") == 1 and "hashpartitioning(item_id" in _plan(places)
    assert {(r["item_id"], r["word"], r["n"]) for r in places.collect()} == {(1, "cats", 1), (1, "and", 1), (1, "cat", 1), (2, "cat", 1), (2, "runs", 1), (2, "cats", 1), (3, "running", 1)}


def test_all_blocks_of_terms_in_one_worker(spark):
    topics = spark.createDataFrame([(t, [f"word{t}", f"other{t}"], []) for t in range(9)], "topic_id bigint, keywords array<string>, exclusions array<string>")
    items = spark.createDataFrame([(i, f"word{i % 9} and other{i % 4}") for i in range(500)], "item_id bigint, text string")
    hits = match.keyword_hits(items, topics, block_terms=4)
    assert _plan(hits).count("MapInArrow") == 1
    expected = {(i, t): [w for w, on in ((f"word{t}", i % 9 == t), (f"other{t}", i % 4 == t)) if on] for i in range(500) for t in {i % 9, i % 4}}
    assert {(r["item_id"], r["topic_id"]): r["words"] for r in hits.collect()} == expected


def test_fingerprints_and_words_are_made_once(spark):
    from tests.harness import DATA
    from tidings.plans import QUERIES

    assert "MapInArrow" not in _plan(QUERIES["simhash_steps"](spark, f"{DATA}/sf0.001"))
    exchanges = [line for line in _plan(QUERIES["works"](spark, f"{DATA}/sf0.001")).splitlines() if "hashpartitioning(" in line]
    assert exchanges and all(re.search(r"hashpartitioning\(item_id#\d+L?, \d+\)", line) for line in exchanges)
