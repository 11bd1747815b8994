"""Coverage, feedback, usage, budget, health and request-rate measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.functions import scoring
from tidings.operators.ordered import running_totals


def topic_source_coverage(scores: DataFrame, items: DataFrame, as_of, days: int = 7) -> DataFrame:
    """(topic_id, source_id, items) matched in the window; an undated item counts by its arrival."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    recent = items.filter(F.coalesce("published_at", "created_at") >= since).select("item_id", "source_id")
    return scores.select("item_id", "topic_id").join(recent, "item_id").groupBy("topic_id", "source_id").agg(F.count("*").alias("items"))


def topic_coverage(topics: DataFrame, recent: DataFrame, days: int = 7, min_sources: int = 3, min_items: int = 3) -> DataFrame:
    """(topic_id, topic, items, sources, warning) for every active topic, also those with nothing."""
    found = recent.filter(F.col("source_id").isNotNull()).groupBy("topic_id").agg(F.sum("items").alias("items"), F.countDistinct("source_id").alias("sources"))
    joined = topics.filter("active").select("topic_id", F.col("name").alias("topic")).join(found, "topic_id", "left").fillna(0, ["items", "sources"])
    noun = F.when(F.col("sources") == 1, F.lit("source")).otherwise(F.lit("sources"))
    text = F.format_string(f"Few articles: %d from %d %s in the last {days} days.", F.col("items"), F.col("sources"), noun)
    return joined.withColumn("warning", F.when((F.col("sources") < min_sources) | (F.col("items") < min_items), text))


def topic_precision(feedback: DataFrame, story_topics: DataFrame, min_sample: int = 5) -> DataFrame:
    """(topic_id, sample, precision): share of positive story signals; null for a small sample."""
    signals = feedback.filter((F.col("target_type") == "story") & F.col("signal").isin(*scoring.TOPIC_POSITIVE, *scoring.TOPIC_NEGATIVE))
    per_story = signals.groupBy(F.col("target_id").alias("story_id")).agg(F.count("*").alias("n"), F.count_if(F.col("signal").isin(*scoring.TOPIC_POSITIVE)).alias("good"))
    found = story_topics.join(per_story, "story_id", "left").groupBy("topic_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample"), F.sum("good").alias("good"))
    return found.select("topic_id", "sample", F.when(F.col("sample") >= min_sample, F.col("good") / F.col("sample")).alias("precision"))


def feedback_to_sources(feedback: DataFrame, story_items: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, net): story signals counted once per item of the story, plus direct ones.

    Signals are summed per target first, so a story with many clicks joins as one row.
    """
    delta = scoring.feedback_delta(F.col("signal"))
    per_target = feedback.groupBy("target_type", "target_id").agg(F.sum(delta).alias("net"))
    stories = per_target.filter("target_type = 'story'").select(F.col("target_id").alias("story_id"), "net")
    through = stories.join(story_items, "story_id").join(items.filter(F.col("source_id").isNotNull()).select("item_id", "source_id"), "item_id").select("source_id", "net")
    direct = per_target.filter("target_type = 'source'").select(F.col("target_id").cast(items.schema["source_id"].dataType).alias("source_id"), "net")
    return through.unionByName(direct).groupBy("source_id").agg(F.sum("net").alias("net"))


def drifted_weights(sources: DataFrame, net: DataFrame, step: float = 0.01, most: float = 0.05) -> DataFrame:
    """(source_id, old_weight, new_weight) of unlocked sources whose weight moves."""
    delta = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("net") * F.lit(step)))
    old = F.col("weight").cast("double")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), old + delta))
    joined = sources.filter(~F.col("weight_locked")).join(net.filter("net <> 0"), "source_id")
    changed = joined.select("source_id", old.alias("old_weight"), moved.alias("m")).filter("m <> old_weight")
    return changed.select("source_id", "old_weight", F.round("m", 2).alias("new_weight"))


def unapplied(feedback: DataFrame, applied: DataFrame) -> DataFrame:
    """Feedback rows that have not moved a weight yet."""
    return feedback.join(applied.select("feedback_id"), "feedback_id", "left_anti")


def reading_list_inserts(feedback: DataFrame, reading_list: DataFrame) -> DataFrame:
    """(story_id, created_at) rows a 'saved' signal adds, once per story."""
    saved = feedback.filter((F.col("target_type") == "story") & (F.col("signal") == "saved"))
    first = saved.groupBy(F.col("target_id").alias("story_id")).agg(F.min("created_at").alias("created_at"))
    return first.join(reading_list.filter(F.col("story_id").isNotNull()).select("story_id"), "story_id", "left_anti")


def muted_sources(sources: DataFrame, feedback: DataFrame) -> DataFrame:
    """Sources with ``active`` cleared by a mute signal."""
    muted = feedback.filter((F.col("target_type") == "source") & (F.col("signal") == "mute_source")).select(F.col("target_id").alias("source_id"), F.lit(True).alias("_muted")).distinct()
    return sources.join(muted, "source_id", "left").select(*[(F.col("active") & F.col("_muted").isNull()).alias("active") if c == "active" else F.col(c) for c in sources.columns])


def usage_totals(calls: DataFrame, as_of, days: int = 30) -> DataFrame:
    """One row: calls, cost and failures of today and of the last ``days``."""
    now = F.lit(as_of).cast("timestamp")
    recent = calls.filter((F.col("created_at") >= now - F.expr(f"interval {days} days")) & (F.col("created_at") <= now))
    today = F.col("created_at") >= F.date_trunc("day", now)
    return recent.agg(
        F.count_if(today).alias("today_calls"), F.coalesce(F.sum(F.when(today, F.col("cost_usd"))), F.lit(0.0)).alias("today_cost"), F.count_if(today & ~F.col("ok")).alias("today_failed"),
        F.count("*").alias("period_calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("period_cost"), F.count_if(~F.col("ok")).alias("period_failed"),
    )


def usage_by_stage(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("stage", "prompt_name").alias("stage")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost")).orderBy(F.col("cost").desc(), "stage")


def budget_left(calls: DataFrame, as_of, daily_budget: float, run_cap: float | None = None) -> DataFrame:
    """(spent, remaining) since UTC midnight, within the run's own cap when one is set."""
    now = F.lit(as_of).cast("timestamp")
    spent = F.coalesce(F.sum("cost_usd"), F.lit(0.0))
    left = F.greatest(F.lit(0.0), F.lit(daily_budget) - F.col("spent"))
    capped = F.least(left, F.lit(run_cap)) if run_cap and run_cap > 0 else left
    today = calls.filter((F.col("created_at") >= F.date_trunc("day", now)) & (F.col("created_at") < F.date_trunc("day", now) + F.expr("interval 1 day")))
    return today.agg(spent.alias("spent")).select("spent", capped.alias("remaining"))


def budget_blocked(calls: DataFrame, daily_budget: float) -> DataFrame:
    """Calls with ``spent_before`` of their day and ``blocked`` once that reaches the budget."""
    dated = calls.withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    run = running_totals(dated, ["day"], ["created_at", "call_id"], {"_sum": F.col("cost_usd").cast("decimal(38,9)")})
    before = F.col("_sum") - F.col("cost_usd").cast("decimal(38,9)")
    return run.withColumn("spent_before", before.cast("double")).withColumn("blocked", before >= F.lit(daily_budget).cast("decimal(38,9)")).drop("_sum")


def call_costs(calls: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(costed calls, rejects): cost by per-million prices; a model without a price is rejected."""
    joined = calls.join(prices, "model", "left")
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    return joined.filter(F.col("input_price").isNotNull()).withColumn("cost_usd", cost), joined.filter(F.col("input_price").isNull()).select(*calls.columns)


def call_log(calls: DataFrame) -> DataFrame:
    """Log rows: a failed call has an error and no tokens or cost."""
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(F.lit(0)).alias(c)
    return calls.select("call_id", "stage", "prompt_name", "model", zero("input_tokens"), zero("output_tokens"), zero("cost_usd"), "latency_ms", "ok", F.when(~F.col("ok"), F.col("error")).alias("error"), "created_at")


def rate_windows(requests: DataFrame, window_seconds: int, most: int) -> DataFrame:
    """Each request with its hit number in the fixed window and whether it is allowed."""
    keyed = requests.withColumn("window_epoch", F.floor(F.unix_micros("ts") / (window_seconds * 1_000_000)).cast("bigint"))
    counted = running_totals(keyed, ["owner", "bucket", "window_epoch"], ["ts", "request_id"], {"hit_count": F.lit(1).cast("bigint")})
    return counted.withColumn("allowed", F.col("hit_count") <= most)


def source_health_summary(sources: DataFrame) -> DataFrame:
    """(total, ok, failing) over active sources; ``failing`` counts them, ``failing_sources`` lists."""
    bad = F.col("health_status").isin("broken", "degraded")
    return sources.filter("active").agg(F.count("*").alias("total"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failing"))


def failing_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("active") & F.col("health_status").isin("broken", "degraded")).select("source_id", "health_status")


def fetch_health(log: DataFrame) -> DataFrame:
    """(source_id, error_count, health_status) after an ordered fetch log (source_id, at, ok, stale),
    and, where the log has them, (url, type).

    A source that has no url to fetch is broken. Staleness is a property of feeds: a log row of
    another type is never stale. Errors are those after the last success, so no ordered pass is needed: one aggregate finds the
    last success, a second counts what follows.
    """
    success = F.when(F.col("ok"), F.struct("at", "fetch_id"))
    last = log.groupBy("source_id").agg(F.max(success).alias("last_ok"))
    joined = log.join(last, "source_id")
    after = F.col("last_ok").isNull() | (F.struct("at", "fetch_id") > F.col("last_ok"))
    at_last = F.struct("at", "fetch_id") == F.col("last_ok")
    is_feed = F.col("type") == "rss" if "type" in log.columns else F.lit(True)
    no_url = F.coalesce(F.col("url"), F.lit("")) == "" if "url" in log.columns else F.lit(False)
    found = joined.groupBy("source_id").agg(
        F.count_if(~F.col("ok") & after).alias("error_count"), F.bool_or(at_last & F.col("stale") & is_feed).alias("stale"), F.max_by(no_url, F.struct("at", "fetch_id")).alias("no_url")
    )
    status = F.when(F.col("no_url") | (F.col("error_count") >= 3), F.lit("broken")).when((F.col("error_count") > 0) | F.coalesce("stale", F.lit(False)), F.lit("degraded")).otherwise(F.lit("ok"))
    return found.select("source_id", "error_count", status.alias("health_status"))


def feed_state(entries: DataFrame, as_of, stale_days: int = 21) -> DataFrame:
    """(source_id, entries, newest, stale) per feed: empty, or newest entry too old. Feeds without
    dates are never stale. An empty feed is a row with a null link."""
    newest = F.max("published_at")
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {stale_days} days")
    found = entries.groupBy("source_id").agg(F.count("url").alias("entries"), newest.alias("newest"))
    return found.withColumn("stale", (F.col("entries") == 0) | F.coalesce(F.col("newest") < cutoff, F.lit(False)))


def feed_window(entries: DataFrame, min_hours: float = 12) -> DataFrame:
    """(source_id, entries, hours, short): the time span a feed holds; null under two dates."""
    dated = F.count("published_at")
    span = (F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))) / 3_600_000_000
    found = entries.groupBy("source_id").agg(F.count("url").alias("entries"), F.when(dated > 1, span).alias("hours"))
    return found.withColumn("short", F.coalesce(F.col("hours") < min_hours, F.lit(False)))


def feed_check(checks: DataFrame, entries: DataFrame, as_of, stale_days: int = 7) -> DataFrame:
    """(source_id, entries, newest, status) from checks (source_id, allowed, error) and entries."""
    found = entries.groupBy("source_id").agg(F.count("url").alias("entries"), F.max("published_at").alias("newest"))
    joined = checks.join(found, "source_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {stale_days} days")
    status = (
        F.when(~F.col("allowed"), F.lit("ROBOTS"))
        .when(F.col("error").isNotNull(), F.lit("FAIL"))
        .when(F.col("entries") == 0, F.lit("EMPTY"))
        .when(F.col("newest") < cutoff, F.lit("STALE"))
        .otherwise(F.lit("ok"))
    )
    return joined.select("source_id", "entries", "newest", status.alias("status"))


def feed_check_totals(checked: DataFrame) -> DataFrame:
    """(status, feeds, entries) per status with a grand total in a row of null status."""
    return checked.rollup("status").agg(F.count("*").alias("feeds"), F.sum("entries").alias("entries"))


def gap_suspects(fetched: DataFrame, minimum: int = 20) -> DataFrame:
    """Feeds fetched before whose whole, long enough, fetch was new: older entries may be lost."""
    return fetched.filter((F.col("type") == "rss") & F.col("last_fetched_at").isNotNull() & (F.col("inserted") >= minimum) & (F.col("inserted") == F.col("fetched")))


def run_summary(results: DataFrame) -> DataFrame:
    """(run_id, status, sources, inserted, failed, stats) per run from per-source results."""
    found = results.groupBy("run_id").agg(F.count("*").alias("sources"), F.sum("inserted").alias("inserted"), F.count_if(~F.col("ok")).alias("failed"))
    stats = F.to_json(F.struct("sources", "inserted", "failed"))
    return found.select("run_id", F.when(F.col("failed") > 0, F.lit("partial")).otherwise(F.lit("ok")).alias("status"), "sources", "inserted", "failed", stats.alias("stats"))


def source_gaps(excluded: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, status, reason, option): wanted sources that deliver nothing, and registered ones
    that fail or are muted; healthy ones are left out."""
    e = excluded.select("name", F.col("reason").alias("known_reason"), F.col("option").alias("known_option"), F.lit(True).alias("known"))
    s = sources.select("name", "type", "active", "health_status", "last_fetched_at", F.lit(True).alias("registered"))
    joined = e.join(s, "name", "full_outer")
    known, registered, active = F.coalesce("known", F.lit(False)), F.coalesce("registered", F.lit(False)), F.coalesce("active", F.lit(False))
    status = F.when(~registered, F.lit("not in system")).when(~active, F.lit("muted")).otherwise(F.col("health_status"))
    reason = (
        F.when(~active, F.lit("Muted on this page."))
        .when(F.col("health_status") == "unknown", F.lit("Not fetched yet."))
        .when(F.col("health_status") == "degraded", F.lit("Recent fetches failed or the feed has gone quiet."))
        .otherwise(F.lit("Fetches keep failing."))
    )
    option = F.when(~active, F.lit("Activate below")).when(F.col("last_fetched_at").isNotNull(), F.concat(F.lit("Last data "), F.date_format("last_fetched_at", "dd/MM/yyyy"))).otherwise(F.lit("Check the feed URL"))
    wanted = known | F.col("type").isin("rss", "sitemap", "scrape", "api_openalex")
    return (
        joined.filter(wanted)
        .select("name", status.alias("status"), F.when(known, F.col("known_reason")).otherwise(reason).alias("reason"), F.when(known, F.col("known_option")).otherwise(option).alias("option"))
        .filter("status <> 'ok'")
    )


def cluster_agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (found_pairs, true_pairs, common_pairs, precision, recall, f1) of two clusterings (item_id,
    cluster) over the items that both have.

    Pairs of items are counted from the sizes of the clusters and of their intersections, so none is
    listed and a cluster with most of the items is a few rows per map task. A null cluster holds its item
    alone. A share of no pairs is null; repeated rows count once.
    """
    own = lambda df, name: df.groupBy("item_id").agg(F.min("cluster").alias(name))
    both = own(found, "found").join(own(truth, "truth"), "item_id")
    cells = both.groupBy("found", "truth").agg(F.count("*").alias("n"))

    def pairs(sizes: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("decimal(19,0)")
        return sizes.agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("decimal(38,0)")), F.lit(0)).cast("bigint").alias(name))

    of = lambda name: cells.filter(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("n"))
    common = cells.filter(F.col("found").isNotNull() & F.col("truth").isNotNull())
    # Three tables of one row each.
    counts = pairs(of("found"), "found_pairs").crossJoin(pairs(of("truth"), "true_pairs")).crossJoin(pairs(common, "common_pairs"))
    share = lambda a, b: F.when(b > 0, a / b)
    precision, recall = share(F.col("common_pairs"), F.col("found_pairs")), share(F.col("common_pairs"), F.col("true_pairs"))
    f1 = share(2 * F.col("common_pairs"), F.col("found_pairs") + F.col("true_pairs"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
