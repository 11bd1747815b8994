"""Status and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Points per tier, novelty and topic priority.
TIER_POINTS = {1: 30, 2: 20, 3: 10}
NOVELTY_POINTS = {"new": 8, "continuation": 4, "repetition": 0}
PRIORITY_POINTS = {"high": 6, "normal": 3, "low": 0}
PRIORITY_RANK = {"high": 0, "normal": 1, "low": 2}
SECTION_BY_TIER = {1: "critical", 2: "follow_up", 3: "worth_reading"}
SECTION_ORDER = {"critical": 0, "follow_up": 1, "worth_reading": 2}

POSITIVE_SIGNALS = ("relevant", "saved", "more_from_this_source")
NEGATIVE_SIGNALS = ("not_relevant", "less_like_this", "mute_source")
TOPIC_POSITIVE = ("relevant", "saved")
TOPIC_NEGATIVE = ("not_relevant", "less_like_this")


def lookup(column: Column, table: dict, default=None) -> Column:
    chain = None
    for key, value in table.items():
        chain = F.when(column == key, F.lit(value)) if chain is None else chain.when(column == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def rank_score(tier: Column, novelty: Column, priority: Column, weight: Column, sources: Column) -> Column:
    """Story rank from tier, novelty, topic priority, mean source weight and item count."""
    return (
        lookup(tier, TIER_POINTS, 0)
        + lookup(novelty, NOVELTY_POINTS, 0)
        + lookup(F.coalesce(priority, F.lit("normal")), PRIORITY_POINTS, 0)
        + F.lit(10.0) * F.coalesce(weight.cast("double"), F.lit(0.5))
        + sources
    )


def initial_status(published: Column, as_of, fresh_days: int = 7) -> Column:
    """'not_relevant' for entries older than the fresh window, else 'new'."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {fresh_days} days")
    return F.when(published < cutoff, F.lit("not_relevant")).otherwise(F.lit("new"))


def relevance_outcome(cleared: Column, failed: Column) -> Column:
    return F.when(cleared, F.lit("scored")).when(failed, F.lit("retry")).otherwise(F.lit("not_relevant"))


def freshness(first_seen: Column, updated: Column, since: Column) -> Column:
    """'New' after the previous run, 'Updated' when only the last change is."""
    return F.when(first_seen > since, F.lit("New")).when(updated > since, F.lit("Updated"))


def feedback_delta(signal: Column) -> Column:
    return F.when(signal.isin(*POSITIVE_SIGNALS), F.lit(1)).when(signal.isin(*NEGATIVE_SIGNALS), F.lit(-1)).otherwise(F.lit(0))


def research_since(last_fetched: Column, as_of, lookback_days: int = 90, overlap_days: int = 3) -> Column:
    """First day to ask for: an overlap before the last fetch, or the initial look-back."""
    base = F.coalesce(F.to_date(last_fetched), F.date_sub(F.to_date(F.lit(as_of).cast("timestamp")), lookback_days))
    return F.date_sub(base, overlap_days)


def stage_due(stage: str) -> Column:
    """Rows a stage still has to process, from the row's own status columns."""
    status, original = F.col("status"), F.col("canonical_item_id").isNull() if stage in _ITEM_STAGES else None
    if stage in _ITEM_STAGES:
        return (status == _ITEM_STAGES[stage]) & original
    if stage == "group":
        return status == "scored"
    if stage == "score":
        return (status == "open") & F.col("tier").isNull()
    if stage == "enrich":
        return (status == "open") & (F.col("tier") <= 3) & F.col("summary").isNull()
    if stage == "research":
        return F.col("argument").isNull()
    raise ValueError(f"no stage named {stage}")


# The item status each stage reads.
_ITEM_STAGES = {"extract": "new", "embed": "extracted", "dedup": "embedded", "relevance": "embedded", "cluster": "scored"}
