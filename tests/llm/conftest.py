import random

import pytest

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, as columns of the caller.
CLASHING = "text_key string, one string, two string, run string, runs string, id string, least string, kind string, slot string, shard string, size string, virtual_slot string, simhash string, root string, component_id string, _id string, _key string, row string, held_out string, letters string, _letters string, _runs string, places string, ids string"


def words(draw, n, stem=""):
    return " ".join(stem + "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and very long texts."""
    draw = random.Random(4)
    passage, line = words(draw, 70), words(draw, 30)
    long_text = words(draw, 20_000)
    base = [words(draw, draw.randint(5, 300)) for _ in range(30)]
    texts = [
        *base,
        base[3],
        base[3],
        base[3].upper(),
        base[4] + " tail",
        base[5][:-1],
        None,
        None,
        "",
        "",
        " \t\n ",
        "one",
        "one two",
        "one two three",
        long_text,
        words(draw, 20) + "\n" + passage,
        passage + " " + words(draw, 40),
        words(draw, 3) + " " + passage + "  " + words(draw, 3),
        line + "\n" + words(draw, 60) + "\n" + line,
        line + "\n" + line + "\n" + line + "\n" + line,
        "ab " * 400,
        "x" * 1000,
        "y" * 150 + "z" + "y" * 150,
        "çà et là 漢字 😀 " * 30,
        "É" * 120,
        "▁ under  score ▁",
        "a b c\x0bd\x1ce\x85f",
        " ".join(long_text.split()[500:900]),
        "12 34 56",
        "-- !! ??",
    ]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i * 3, texts[j]) for i, j in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame_of(spark, rows, clashing=False):
    languages, sources = ("en", "de", None), ("a", "b", None)
    full = [(d, t, languages[i % 3], sources[i % 3], len(t) if t is not None else None) for i, (d, t) in enumerate(rows)]
    frame = spark.createDataFrame(full, SCHEMA).repartition(4)
    if clashing:
        from pyspark.sql import functions as F

        frame = frame.select("*", *[F.lit("other").alias(c.split()[0]) for c in CLASHING.split(", ")])
    return frame


@pytest.fixture(scope="session")
def documents(spark, rows):
    return frame_of(spark, rows, clashing=True).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark_rows(rows):
    draw = random.Random(9)
    by_length = [t for _, t in rows if t and len(brute.LETTERS.findall(t)) > 100]
    picked = [" ".join(brute.LETTERS.findall(t)[20:50]).upper() for t in [max(by_length, key=len), *by_length[:3]]]
    return [(1, picked[0]), (2, picked[1]), (10, picked[1]), (3, picked[2] + " " + words(draw, 10)), (4, "one two"), (5, None), (6, ""), (7, "!!"), (None, picked[3]), (1, picked[3]), (8, words(draw, 40))]


@pytest.fixture(scope="session")
def benchmark_table(spark, benchmark_rows):
    return spark.createDataFrame(benchmark_rows, "item_id long, text string")
