"""A training corpus from raw documents: operators of the package, one stage after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidings.llm import decontaminate, language, pieces, simhash, substrings
from tidings.llm.tables import checkpointed, in_short_batches, table

LEAST_LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a language that stands out go."""
    return language.in_known_language(docs, LEAST_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that fingerprints at most two bits apart link, directly or by way of others, the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that an earlier document has too are cut out of the texts."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids; the text that the ids decode to stands beside them."""
    return pieces.with_tokens(docs, pieces.model_path())


STAGES = [
    ("language identification", in_short_batches(identify_language)),
    ("near-duplicate removal", in_short_batches(drop_near_copies)),
    ("repeated passages", in_short_batches(cut_repeats)),
    ("benchmark decontamination", in_short_batches(drop_contaminated)),
    ("tokens", in_short_batches(tokenize)),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
