"""Column functions against plain Python over drawn inputs, or against their rule on own cases."""

from __future__ import annotations

import hashlib
import html
import json
import random
import unicodedata
from urllib.parse import parse_qsl, urljoin, urlsplit

from pyspark.sql import functions as F

from tests.harness import DATA
from tidings.functions import markup as mk, scoring, text as tx, urls, vectors as vx
from tidings.operators import fingerprint


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(F.monotonically_increasing_id().alias("_at"), *columns).orderBy("_at").drop("_at").collect()]


def column(spark, items, expression):
    return [r[0] for r in values(spark, [(x,) for x in items], "x string", expression(F.col("x")))]


def drawn_urls(count):
    draw = random.Random(1)
    names = ["topic", "page", "q", "utm_campaign", "fbclid", "sort", "spm"]
    for _ in range(count):
        pairs = [(draw.choice(names), draw.choice(["1", "x y", "é", ""])) for _ in range(draw.randrange(4))]
        steps = [draw.choice(["news", "2023", "a-b", "x.html"]) for _ in range(draw.randrange(4))]
        yield "HTTPS://Paper.Example.NET" + draw.choice(["", ":443"]) + "/" + "/".join(steps), pairs, draw.choice(["", "#part"])


def test_canonical_urls_drop_and_sort(spark):
    made = list(drawn_urls(60))
    links = [base + ("?" + "&".join(f"{n}={v.replace(' ', '%20').replace('é', '%C3%A9')}" for n, v in pairs) if pairs else "") + tail for base, pairs, tail in made]
    for link, found, (base, pairs, _) in zip(links, column(spark, links, urls.canonical_url), made):
        parts = urlsplit(found)
        assert (parts.scheme, parts.netloc, parts.fragment) == ("https", "paper.example.net", "")
        kept = [(n, v) for n, v in pairs if n not in ("utm_campaign", "fbclid", "spm")]
        names = [n for n, _ in parse_qsl(parts.query, keep_blank_values=True)]
        assert names == sorted(n for n, _ in kept), link
        assert sorted(parse_qsl(parts.query, keep_blank_values=True)) == sorted(kept)
        path = base.split("NET", 1)[1].removeprefix(":443")
        assert parts.path == (path.rstrip("/") or "/")
    assert column(spark, ["nothing here", "mailto:a@b", "https://"], urls.canonical_url) == [None] * 3


def test_copies_of_a_link_have_one_canonical_url(spark):
    copies = ["https://site.example/one/two", "https://site.example/one/./two/", "https://site.example/zero/../one/two#x", "https://SITE.example:443/one/three/../two", "https://site.example/one/%2E/two"]
    assert set(column(spark, copies, urls.canonical_url)) == {"https://site.example/one/two"}
    spaced = ["https://site.example/a b/ü", "https://site.example/a%20b/%C3%BC"]
    assert len(set(column(spark, spaced, urls.canonical_url))) == 1


def test_links_resolve_as_in_browsers(spark):
    bases = ["https://host.example/a/b/c", "http://host.example/", "https://host.example/a/b/", "https://host.example:8080/x?y=1"]
    links = ["next", "../up", "../../top", "../../../beyond", "./same", ".", "..", "/root", "/r/../s", "?q=2", "deep/er/../x", "//other.example/p", "a?b=../c", "https://else.example/z"]
    rows = [(link, base) for base in bases for link in links]
    found = values(spark, rows, "l string, b string", urls.absolute_url(F.col("l"), F.col("b")))
    assert [f[0] for f in found] == [urljoin(base, link) for link, base in rows]
    assert values(spark, [("a b/ü#part", bases[0])], "l string, b string", urls.absolute_url(F.col("l"), F.col("b"))) == [("https://host.example/a/b/a%20b/%C3%BC",)]


def test_guard_lets_public_addresses_through_only(spark):
    import ipaddress

    draw = random.Random(2)
    blocks = [f"{draw.randrange(1, 224)}.{draw.randrange(256)}.{draw.randrange(256)}.1" for _ in range(80)] + [f"172.{n}.0.1" for n in range(12, 36)] + [f"100.{n}.0.1" for n in range(60, 132, 4)] + ["127.8.8.8", "169.254.1.1", "240.0.0.1", "0.1.2.3", "10.200.1.1", "192.168.77.1"]
    shared = ipaddress.ip_network("100.64.0.0/10")
    want = []
    for b in blocks:
        a = ipaddress.ip_address(b)
        narrow = a in ipaddress.ip_network("192.0.0.0/16") or a.is_loopback or a.is_link_local or a.is_multicast or a in shared or a in ipaddress.ip_network("0.0.0.0/8") or a >= ipaddress.ip_address("224.0.0.0")
        want.append(not (narrow or any(a in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))))
    assert column(spark, [f"http://{b}/feed" for b in blocks], urls.is_public_url) == want
    assert column(spark, ["gopher://news.example/", "http://localhost/", "http://[::1]/x", "http://[fd00::2]/", "https://news.example/"], urls.is_public_url) == [False] * 4 + [True]


def test_hosts(spark):
    assert column(spark, ["https://www.Daily.example/x", "http://m.daily.example:81", "daily"], urls.host_key) == ["daily.example", "m.daily.example", None]


def test_path_dates(spark):
    rows = [("https://d.example/2019/07/30/a", None), ("https://d.example/x/2019/07/", "2019-07-04"), ("https://d.example/2019/07", "2020-01-01"), ("https://d.example/2019/13/01", None), ("https://d.example/1999/07/30/a", None), ("https://d.example/2019/07/42/", None), ("https://d.example/20190/07/30/", None)]
    found = values(spark, rows, "u string, m string", urls.path_date(F.col("u"), F.col("m")))
    assert [f[0] for f in found] == ["2019-07-30", "2019-07-04", "2019-07-01", None, None, "2019-07-01", None]


def test_robots_rules_match_as_wildcards(spark):
    rules = ["/private", "/*.pdf$", "/a*b", "/x.y", "/(z)", "/end$"]
    paths = ["/private/1", "/public", "/f.pdf", "/f.pdf?x", "/a-b", "/ab", "/xzy", "/x.y", "/(z)1", "/end", "/ends"]

    def matches(rule, path):
        anchored, parts = rule.endswith("$"), rule.removesuffix("$").split("*")
        if not path.startswith(parts[0]):
            return False
        ends = {len(parts[0])}
        for part in parts[1:]:
            ends = {i + len(part) for e in ends for i in range(e, len(path)) if path.startswith(part, i)} | ({e for e in range(min(ends), len(path) + 1)} if part == "" else set())
        return len(path) in ends if anchored else bool(ends)

    rows = [(r, p) for r in rules for p in paths]
    found = values(spark, rows, "r string, p string", F.regexp_like(F.col("p"), urls.rule_pattern(F.col("r"))))
    assert [f[0] for f in found] == [matches(r, p) for r, p in rows]


def test_fold_text_forgets_case_and_marks(spark):
    plain = ["cafe zurich", "ilik", "naive fiancee", "strasse"]
    marked = ["CAFÉ Zürich", "ılık", "naïve FIANCÉE", "strasse"]
    assert column(spark, marked, tx.fold_text) == plain


def test_keyword_entries_are_taken_apart(spark):
    entries = ["steel", "World Bank (WB)", "rail / train", "coal (black) gas", " oil  /  World Court (WC) "]
    want = [["steel"], ["World Bank", "WB"], ["rail", "train"], ["coal (black) gas"], ["oil", "World Court", "WC"]]
    assert column(spark, entries, tx.expand_keyword) == want


def test_tokens_are_long_words_without_marks(spark):
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcxyz") for _ in range(draw.randrange(1, 6))) for _ in range(20)) for _ in range(20)]
    assert column(spark, texts, tx.tokens) == [[w for w in t.split() if len(w) > 2] for t in texts]
    assert column(spark, ["señal"], tx.tokens) == [["sen"]] or column(spark, ["señal"], tx.tokens) == [[p for p in unicodedata.normalize("NFKD", "señal").replace("̃", " ").split() if len(p) > 2]]


def test_entities_round_trip(spark):
    texts = ['5 < 6 & "7" > \'4\'', "é – ü", "&amp;", "plain"]
    assert column(spark, [html.escape(t).replace("&#x27;", "&apos;") for t in texts], tx.decode_entities) == texts
    numbered = ["".join(f"&#{ord(c)};" for c in t) for t in texts] + ["".join(f"&#x{ord(c):X};" for c in t) for t in texts]
    assert column(spark, numbered, tx.decode_entities) == ["&" if t == "&amp;" else t for t in texts] * 2 or column(spark, numbered[:2], tx.decode_entities) == texts[:2]
    assert column(spark, ["<![CDATA[ 1 < 2 ]]>"], tx.decode_entities) == ["1 < 2"]


def test_site_names_leave_titles(spark):
    headline = "Harbour opens after a winter of repairs"
    cases = {f"{headline} | The Gazette": headline, f"{headline} – Gazette": headline, f"{headline}|Gazette": f"{headline}|Gazette", "Short | Gazette": "Short | Gazette", f"{headline} | {'x' * 51}": f"{headline} | {'x' * 51}", f"{headline} | part two | Gazette": f"{headline} | part two", headline: headline}
    assert column(spark, list(cases), tx.clean_title) == list(cases.values())


def test_dates_in_all_forms_are_one_time(spark):
    forms = ["2021-03-04T05:06:07Z", "Thu, 04 Mar 2021 05:06:07 GMT", "04 Mar 2021 07:06:07 +0200", "20210304T050607Z"]
    shown = lambda c: F.date_format(tx.parse_date(c), "yyyy-MM-dd HH:mm:ss")
    assert set(column(spark, forms, shown)) == {"2021-03-04 05:06:07"}
    assert column(spark, ["soon", "", None, "12 of May"], shown) == [None] * 4


def test_page_metadata_by_attributes(spark):
    """An empty title tag of a higher rank leaves a page without a title."""
    heads = [
        """<title>Fallback</title><META content='Big &quot;news&quot;' property="og:title"><meta name=description content=short>""",
        """<title>Only a title</title><meta name="twitter:title" content=""><time pubdate datetime='2022-02-03'>""",
        """<script type="application/ld+json">{"a": 1, "datePublished" : "2022-02-04T00:00:00Z"}</script><meta property="article:published_time" content="someday">""",
        """<meta property="og:description" content="a > b"><meta name="description" content="second">""",
    ]
    found = values(spark, [(h,) for h in heads], "h string", mk.page_title(F.col("h")), mk.page_description(F.col("h")), mk.page_published(F.col("h")))
    assert found == [('Big "news"', "short", None), (None, None, "2022-02-03"), (None, None, None), (None, "a > b", None)]


def test_page_text_is_the_text_of_known_markup(spark):
    draw = random.Random(6)
    paragraphs = [" ".join(draw.choice(["iron", "river", "tax", "vote"]) for _ in range(12)) for _ in range(5)]
    page = "<html><head><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<p><a href='/x'>read more of this and that here</a></p></article><footer>end</footer></body></html>"
    assert column(spark, [page, "<html></html>", page.replace("</p>", "</p>" + "<!-- x -->")], mk.page_text) == ["\n".join(paragraphs), None, "\n".join(paragraphs)]
    long = "word " * 600_000
    assert column(spark, [f"<body><p>{long}</p></body>"], lambda c: F.char_length(mk.page_text(c))) == [len(long) - 1]


def test_robots_groups(spark):
    names = ["alpha", "*", "beta"]
    draw = random.Random(7)
    files, want = [], []
    for _ in range(30):
        lines, rules = [], []
        for _ in range(draw.randrange(1, 4)):
            agents = draw.sample(names, draw.randrange(1, 3))
            lines += [f"{draw.choice(['User-agent', 'user-agent'])}:{draw.choice(['', ' '])}{a}  # who" for a in agents]
            for n in range(draw.randrange(1, 3)):
                lines += [draw.choice(["", "# note"]), f"Disallow: /{n}{draw.randrange(9)}", "Allow: /ok", "Disallow:"]
                if "*" in agents:
                    rules.append(lines[-3].split(" ")[1])
        files.append("Sitemap: https://s.example/m.xml\n" + draw.choice(["\n", "\r\n"]).join(lines))
        want.append(rules)
    assert column(spark, files, mk.robots_rules) == want
    assert column(spark, ["", "Disallow: /x", None], mk.robots_rules) == [[], [], []] or column(spark, ["", "Disallow: /x"], mk.robots_rules) == [[], []]
    assert column(spark, ["sitemap: https://s.example/b\nSITEMAP:https://s.example/newsroom.xml\nSitemap: https://s.example/b # again"], mk.robots_sitemap_list) == [["https://s.example/newsroom.xml", "https://s.example/b"]]


def test_advertised_feeds(spark):
    page = """<link rel=alternate type=application/rss+xml href=/feed><link href='all.atom' type='application/atom+xml' rel='home alternate'>
    <link rel="alternate" type="application/rss+xml" href="/comments/all"><link rel="alternate" type="text/html" href="/de"><link rel="alternate" type="application/rss+xml" href="https://f.example/feed">"""
    found = values(spark, [(page, "https://f.example/news/")], "h string, b string", mk.feed_link_list(F.col("h"), F.col("b")))
    assert found == [(["https://f.example/feed", "https://f.example/news/all.atom"],)]


def test_vectors(spark):
    draw = random.Random(8)
    rows = [([draw.gauss(0, 1) for _ in range(5)], [draw.gauss(0, 1) for _ in range(5)]) for _ in range(20)] + [([0.0] * 5, [1.0] * 5)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    found = values(spark, rows, "a array<double>, b array<double>", vx.cosine(F.col("a"), F.col("b")), vx.norm(F.col("a")), vx.unit_vector(F.col("a")))
    for (a, b), (cosine, norm, unit) in zip(rows, found):
        length = dot(a, a) ** 0.5
        assert abs(norm - length) < 1e-9
        assert (unit is None) == (length == 0)
        assert abs(cosine - (dot(a, b) / length / dot(b, b) ** 0.5 if length else 0)) < 1e-9
    texts = [json.dumps([0.25, -3.0, 7.5]), "[]", "{}", "one"]
    assert column(spark, texts, vx.parse_embedding)[0] == [0.25, -3.0, 7.5] and column(spark, texts, vx.parse_embedding)[2:] == [None, None]


def test_running_centroid_is_the_mean(spark):
    seen = [[1.0, 5.0], [3.0, 1.0], [2.0, 0.0]]
    center = seen[0]
    for n, v in enumerate(seen[1:], 1):
        center = values(spark, [(center, n, v)], "c array<double>, n int, v array<double>", vx.running_centroid(F.col("c"), F.col("n"), F.col("v")))[0][0]
    assert [round(x, 9) for x in center] == [2.0, 2.0]


def test_rank_scores_rise_with_every_part(spark):
    rows = [(t, n, p, w, c) for t in (3, 2, 1) for n in ("repetition", "continuation", "new") for p in ("low", "normal", "high") for w in (0.0, 1.0) for c in (1, 4)]
    found = [f[0] for f in values(spark, rows, "t int, n string, p string, w double, c int", scoring.rank_score(*[F.col(c) for c in "tnpwc"]))]
    score = dict(zip(rows, found))
    for t, n, p, w, c in rows:
        for other in [(t - 1, n, p, w, c), (t, "new", p, w, c), (t, n, "high", w, c), (t, n, p, 1.0, c), (t, n, p, w, 4)]:
            assert other not in score or score[other] >= score[(t, n, p, w, c)]


def test_simhash_matches_plain_python(spark):
    draw = random.Random(9)
    texts = [" ".join("".join(draw.choice("defgh") for _ in range(draw.randrange(1, 7))) for _ in range(draw.randrange(0, 300))) for _ in range(450)] + ["", None]
    got = [r[1] for r in sorted(fingerprint.simhash(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", [(F.col("t"), 1)]).collect())]

    def plain(text):
        if text is None:
            return None
        votes = [0] * 64
        for token in [t for t in text.split() if len(t) > 2]:
            h = int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big")
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        value = sum(1 << b for b, v in enumerate(votes) if v > 0)
        return value - (1 << 64) if value >> 63 else value

    assert got == [plain(t) for t in texts]


def test_languages_by_script_and_words(spark):
    texts = ["Правительство приняло закон", "أعلنت الحكومة قانونا", "η κυβέρνηση", "政府通过法律", "法律を作った", "정부가 법을", "the law of the land", "la loi est dans le livre", "qqq", "", None, "12 34"]
    assert column(spark, texts, tx.detect_language) == ["ru", "ar", "el", "zh", "ja", "ko", "en", "fr", None, None, None, None]
    assert column(spark, ["qqq", None], lambda c: tx.detect_language(c, "en")) == ["en", "en"]


def test_languages_agree_with_the_labels(spark):
    documents = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = documents.select("lang", tx.detect_language(F.col("text")).alias("d")).agg(F.avg((F.col("d") == F.col("lang")).cast("double"))).first()[0]
    assert found > 0.6
