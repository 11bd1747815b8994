"""Arrival of items: known links, first-wins inserts, research links, status sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidings.functions import scoring, urls
from tidings.operators.ordered import most_rows


def known_urls(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``found`` (url) whose canonical form is already stored (canonical_url)."""
    return _with_canonical(found).join(stored.select("canonical_url"), "canonical_url", "left_semi")


def unknown_urls(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``found`` that are not stored yet; links that do not parse count as unknown."""
    return _with_canonical(found).join(stored.select("canonical_url"), "canonical_url", "left_anti")


def _with_canonical(found: DataFrame) -> DataFrame:
    return found.withColumn("canonical_url", urls.canonical_url(F.col("url")))


def first_wins(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the first in ``order``. Aggregates before the shuffle, so copies of one
    hot key leave each map task as a single row."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)


def new_items(
    arrived: DataFrame, stored: DataFrame, as_of, per_source: int | None = None, age_filter: bool = True
) -> DataFrame:
    """Rows to insert from one run's arrivals (source_id, pos, url, title, published_at).

    Links that do not parse and untitled entries are dropped; the first row of a canonical url wins,
    in the batch and against the stored rows. ``per_source`` takes only the first entries of a fetch.
    """
    taken = most_rows(arrived, per_source, ["source_id"], [F.col("pos")])
    usable = _with_canonical(taken).filter(F.col("canonical_url").isNotNull() & (F.coalesce(F.col("title"), F.lit("")) != ""))
    status = scoring.initial_status(F.col("published_at"), as_of) if age_filter else F.lit("new")
    single = first_wins(usable, ["canonical_url"], F.struct("source_id", "pos"))
    return single.join(stored.select("canonical_url"), "canonical_url", "left_anti").withColumn("status", status)


def research_links(inserted: DataFrame, works: DataFrame) -> DataFrame:
    """One research row per inserted item that came from a work; the last work of a url wins."""
    last = (
        _with_canonical(works)
        .groupBy("canonical_url")
        .agg(F.max_by(F.struct("work_id", "doi", "journal", "authors"), "pos").alias("w"))
    )
    return inserted.join(last, "canonical_url").select("item_id", "w.*")


def upsert_last(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot of ``stored`` with ``changes`` applied; changed rows replace stored ones."""
    return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*stored.columns))


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def purge_candidates(items: DataFrame, saved: DataFrame, watched: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Unmatched items past retention that nobody saved or watches."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    old = items.filter((F.col("status") == "not_relevant") & (F.col("created_at") < cutoff))
    return old.join(saved.select("item_id"), "item_id", "left_anti").join(watched.select("item_id"), "item_id", "left_anti")


def retained(items: DataFrame, saved: DataFrame, watched: DataFrame, as_of, days: int = 90) -> DataFrame:
    """The snapshot that is left after a purge."""
    gone = purge_candidates(items, saved, watched, as_of, days).select("item_id")
    return items.join(gone, "item_id", "left_anti")


def close_backlog(items: DataFrame, as_of, days: int = 2) -> DataFrame:
    """Unfinished items older than ``days`` become unmatched."""
    stuck = F.col("status").isin("new", "extracted", "embedded") & (
        F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    )
    return items.withColumn("status", F.when(stuck, F.lit("not_relevant")).otherwise(F.col("status")))
