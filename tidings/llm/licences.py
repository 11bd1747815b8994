"""Licence scan of a file tree: notices by TF-IDF, then inheritance along directories.

Every line of every file is compared with the templates as sparse TF-IDF vectors. A word's weight
hangs on the files that hold it, counted over all files; a word that no template has counts as one
that no file has. Only lines that share enough of a template's weight to reach the threshold are
taken apart into words (an exact bound: the cosine is at most the shared part of the template). A
file whose notice is a good part of it is a licence file and speaks for its directory; a file without
a notice takes the licence of its nearest ancestor directory. DataFrame operations only.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.llm.tables import checkpointed

THRESHOLD = 0.6
FILE_SHARE = 0.04
WORD = r"[a-z0-9]+(?:\.[0-9]+)?"

# The notices that these licences ask for or are announced by.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def template_words(templates: dict[str, str]) -> dict[str, Counter]:
    import re

    return {name: Counter(re.findall(WORD, text.lower())) for name, text in templates.items()}


def word_weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse file frequencies of the vocabulary, and that of a word in no file. The vocabulary is
    that of the templates, so a few hundred sums reach the driver."""
    own = F.array(*[F.lit(w) for w in vocabulary])
    held = files.select(F.explode(F.array_intersect(F.array_distinct(words(F.col("text"))), own)).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = files.count()
    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {w: idf(found.get(w, 0)) for w in vocabulary}, idf(0)


def notices(files: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(file, licence, score, n_notice): each file's best notice, and the words on its notice lines."""
    counted = template_words(templates)
    vocabulary = sorted({w for own in counted.values() for w in own})
    weight, unknown = word_weights(files, vocabulary)
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "content"))

    def within_reach(shared: Column) -> Column:
        """Whether the words that a line shares with the vocabulary can bring it to the threshold."""
        reach = F.lit(False)
        for own in counted.values():
            mass = {w: (n * weight[w]) ** 2 for w, n in own.items()}
            shares = F.create_map(*[F.lit(x) for pair in mass.items() for x in pair])
            held = F.aggregate(shared, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(shares, w), F.lit(0.0)))  # noqa: B023
            reach = reach | (held >= threshold**2 * sum(mass.values()) - 1e-9)
        return reach

    # One expression, so that a line is split into words once for all templates.
    shared = F.array_intersect(words(F.col("content")), F.array(*[F.lit(w) for w in vocabulary]))
    close = lines.filter(F.exists(F.array(shared), within_reach)).withColumn("words", words(F.col("content")))
    weights = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    counts = close.select("file", "line", F.size("words").alias("n_words"), F.explode("words").alias("word")).groupBy("file", "line", "n_words", "word").agg(F.count("*").alias("tf"))
    weighted = counts.withColumn("w", F.col("tf") * F.coalesce(F.element_at(weights, F.col("word")), F.lit(unknown)))
    dots = []
    for own in counted.values():
        of_template = F.create_map(*[F.lit(x) for w, n in own.items() for x in (w, n * weight[w])])
        norm = math.sqrt(sum((n * weight[w]) ** 2 for w, n in own.items()))
        dots.append((F.sum(F.col("w") * F.coalesce(F.element_at(of_template, F.col("word")), F.lit(0.0))) / norm, norm))
    by_line = weighted.groupBy("file", "line", "n_words").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[d.alias(f"d{i}") for i, (d, _) in enumerate(dots)])
    scored = F.array(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 6).alias("score"), F.lit(name).alias("licence")) for i, name in enumerate(counted)])
    # The highest score, then the first name.
    best = F.array_sort(scored, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["licence"] < b["licence"], -1).otherwise(1))[0]
    hits = by_line.withColumn("best", best).filter(F.col("best.score") >= threshold)
    first = F.min(F.struct((-F.col("best.score")).alias("less"), F.col("best.licence").alias("licence")))
    return hits.groupBy("file").agg(first.alias("b"), F.sum("n_words").alias("n_notice")).select("file", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"), "n_notice")


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it with their depth, the deepest first."""
    parts = F.split(directory, "/")
    depths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """(file, path, licence, score, origin, from_path) for every row of ``files`` (file, path, text).

    ``origin`` is ``notice``, ``inherited`` or ``none``. Of several licence files in a directory the
    one with the highest score speaks, then the smallest path. Null and empty texts have no lines; a
    null path has no directory. ``file`` must tell rows apart: rows that repeat it share their lines.
    An empty table gives no rows.
    """
    files = files.select("file", "path", "text")
    found = checkpointed(notices(files, templates or TEMPLATES, threshold))
    sized = files.select("file", "path", F.coalesce(F.size(F.when(F.col("text").isNotNull(), words(F.col("text")))), F.lit(0)).alias("n_words"))
    known = checkpointed(sized.join(found, "file", "left").withColumn("directory", directory_of(F.col("path"))))
    speaking = known.filter((F.col("n_notice") >= file_share * F.col("n_words")) & F.col("path").isNotNull())
    by_directory = speaking.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("less"), "path", "licence")).alias("s"))
    spoken = checkpointed(by_directory.select(F.col("directory").alias("above"), F.col("s.licence").alias("up_licence"), (-F.col("s.less")).alias("up_score"), F.col("s.path").alias("up_path")))
    # Directories find their nearest ancestor, not files: a directory with many files counts once.
    climbing = known.filter("licence is null and directory is not null").select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.depth", "a.above")
    nearest = climbing.join(spoken, "above").groupBy("directory").agg(F.max(F.struct("depth", "up_licence", "up_score", "up_path")).alias("n")).select("directory", "n.up_licence", "n.up_score", "n.up_path")
    joined = known.join(nearest, "directory", "left")
    own, inherited = F.col("licence").isNotNull(), F.col("licence").isNull() & F.col("up_licence").isNotNull()
    return joined.select(
        "file",
        "path",
        F.coalesce("licence", "up_licence").alias("licence"),
        F.coalesce("score", "up_score").alias("score"),
        F.when(own, "notice").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("up_path")).alias("from_path"),
    )


def tree_of(documents: DataFrame) -> DataFrame:
    """Documents as files: source, language, thousand and ten of the doc_id are directories."""
    number = documents["doc_id"].cast("bigint")
    part = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    thousand, ten = F.floor(number / 1000).cast("bigint"), F.floor(number / 10).cast("bigint") % 100
    path = F.concat_ws("/", part(documents["source"], "no-source"), part(documents["lang"], "no-language"), part(thousand, "none"), part(ten, "none"), part(number, "none"))
    return documents.select(number.alias("file"), path.alias("path"), documents["text"].cast("string").alias("text"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(tree_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.withColumnRenamed("file", "doc_id")


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    return f"""
WITH templates(licence, body) AS (VALUES {values}),
t AS (SELECT licence, word, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all(lower(body), '{WORD}')) AS word FROM templates) GROUP BY ALL),
files AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'no-source'), coalesce(lang, 'no-language'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none'), coalesce(CAST((doc_id // 10) % 100 AS VARCHAR), 'none'), coalesce(CAST(doc_id AS VARCHAR), 'none')) AS path FROM documents),
held AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM files) WHERE word IN (SELECT word FROM t) GROUP BY word),
total AS (SELECT count(*) AS n FROM files),
idf AS (SELECT word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS w FROM (SELECT DISTINCT word FROM t) LEFT JOIN held USING (word), total),
lines AS (SELECT doc_id, line, regexp_extract_all(lower(content), '{WORD}') AS words FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS content FROM files)),
close AS (SELECT * FROM lines WHERE list_has_any(words, (SELECT list(DISTINCT word) FROM t))),
counts AS (SELECT doc_id, line, word, count(*) AS tf FROM (SELECT doc_id, line, unnest(words) AS word FROM close) GROUP BY ALL),
weighted AS (SELECT doc_id, line, word, tf * coalesce(w, ln(1 + n) + 1) AS w FROM counts LEFT JOIN idf USING (word), total),
norms AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
tw AS (SELECT licence, word, tf * w AS w FROM t JOIN idf USING (word)),
tn AS (SELECT licence, sqrt(sum(w * w)) AS norm FROM tw GROUP BY licence),
scores AS (SELECT doc_id, line, licence, round(sum(a.w * b.w) / any_value(tn.norm) / any_value(norms.norm), 6) AS score FROM weighted a JOIN tw b USING (word) JOIN tn USING (licence) JOIN norms USING (doc_id, line) GROUP BY ALL),
hits AS (SELECT doc_id, line, min_by(licence, (-score, licence)) AS licence, max(score) AS score FROM scores WHERE score >= {THRESHOLD} GROUP BY ALL),
own AS (SELECT h.doc_id, min_by(licence, (-score, licence)) AS licence, max(score) AS score, sum(len(words)) AS n_notice FROM hits h JOIN lines USING (doc_id, line) GROUP BY h.doc_id),
known AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS directory, licence, score, n_notice, len(regexp_extract_all(lower(text), '{WORD}')) AS n_words FROM files f LEFT JOIN own USING (doc_id)),
spoken AS (SELECT directory, min_by(licence, (-score, path)) AS licence, max(score) AS score, min_by(path, (-score, path)) AS path FROM known WHERE n_notice >= {FILE_SHARE} * n_words GROUP BY directory),
nearest AS (SELECT k.doc_id, max_by(s.licence, len(s.directory)) AS licence, max_by(s.score, len(s.directory)) AS score, max_by(s.path, len(s.directory)) AS path FROM known k JOIN spoken s ON k.directory = s.directory OR starts_with(k.directory, s.directory || '/') WHERE k.licence IS NULL GROUP BY k.doc_id)
SELECT k.doc_id, k.path, coalesce(k.licence, n.licence) AS licence, coalesce(k.score, n.score) AS score,
  CASE WHEN k.licence IS NOT NULL THEN 'notice' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN k.licence IS NOT NULL THEN k.path ELSE n.path END AS from_path
FROM known k LEFT JOIN nearest n USING (doc_id)"""


ORACLE = _sql()
