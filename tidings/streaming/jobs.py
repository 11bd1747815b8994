"""Streaming jobs. Each takes a streaming DataFrame and returns the batch view of its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidings.operators import measures as ms, similarity
from tidings.operators.items import first_wins
from tidings.session import checkpointed
from tidings.streaming.store import latest_rows, open_table, read_batches, run_available, write_batch


def request_counts(requests: DataFrame, seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """(owner, bucket, window_start, hits) per fixed window; state leaves with the watermark."""
    counted = requests.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"), "owner", "bucket").agg(F.count("*").alias("hits"))
    return counted.select("owner", "bucket", F.col("window.start").alias("window_start"), "hits")


def live_counts(updates: DataFrame, key: str, lateness: str = "1 hour") -> DataFrame:
    """(key, window_end, n): rolling 24-hour counts that move every hour."""
    counted = updates.withWatermark("ts", lateness).groupBy(F.window("ts", "24 hours", "1 hour"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.end").alias("window_end"), "n")


def late_day_counts(arrivals: DataFrame, key: str, overlap: str = "3 days") -> DataFrame:
    """(key, day, n): daily counts that accept rows up to the overlap late."""
    counted = arrivals.withWatermark("ts", overlap).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.start").alias("day"), "n")


def collect_counts(counts: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Run a windowed count to the end of its input and return each window's last value."""
    spark = counts.sparkSession
    open_table(spark, f"{folder}/rows", counts.schema)
    run_available(counts, folder, lambda rows, batch_id: write_batch(rows, f"{folder}/rows", batch_id), "update")
    return latest_rows(read_batches(spark, f"{folder}/rows", StructType([*counts.schema, StructField("batch_id", LongType())])), keys)


def arrivals_once(arrivals: DataFrame, folder: str, key: str) -> DataFrame:
    """Each key once, first arrival wins, however late it comes: repeats are found in the rows already
    written, of which only the keys are read. A batch that runs again gives the same rows."""
    spark, schema = arrivals.sparkSession, arrivals.schema
    wide = StructType([*schema, StructField("batch_id", LongType())])
    open_table(spark, f"{folder}/rows", schema)

    def insert(rows: DataFrame, batch_id: int) -> None:
        held = read_batches(spark, f"{folder}/rows", wide, batch_id)
        fresh = first_wins(rows, [key], F.struct("ts", *[c for c in rows.columns if c not in (key, "ts")]))
        write_batch(fresh.join(held.select(key), key, "left_anti").select(*rows.columns), f"{folder}/rows", batch_id)

    run_available(arrivals, folder, insert)
    return read_batches(spark, f"{folder}/rows", wide).drop("batch_id")


def clustered_stream(items: DataFrame, folder: str, same_story: DataFrame, high: float, low: float, window_hours: int = 72) -> DataFrame:
    """(item_id, story_id) of arriving items (item_id, published_at, embedding).

    A batch joins the stories open within the window; stories and their centroids move on between
    batches. A story silent for the whole window takes no more items.
    """
    spark = items.sparkSession
    joined_schema = StructType([*items.schema, StructField("story_id", LongType())])
    members = StructType([*joined_schema, StructField("batch_id", LongType())])
    story_schema = "story_id bigint, centroid array<double>, n bigint, last_updated_at timestamp"
    open_table(spark, f"{folder}/stories", story_schema)
    open_table(spark, f"{folder}/rows", joined_schema)

    def join_stories(rows: DataFrame, batch_id: int) -> None:
        batch = checkpointed(rows)
        start = batch.agg(F.min("published_at").alias("start")).first()["start"]
        if start is None:
            return
        # A story's last update only grows, so older rows can go before the latest are sought.
        held = read_batches(spark, f"{folder}/stories", story_schema + ", batch_id bigint", batch_id)
        recent = held.filter(F.col("last_updated_at") >= F.lit(start) - F.expr(f"interval {window_hours} hours"))
        still_open = checkpointed(latest_rows(recent, ["story_id"]))
        placed = checkpointed(similarity.cluster_batch(batch, still_open, same_story, high, low, window_hours))
        joined = batch.join(placed.select("item_id", "story_id"), "item_id")
        times = joined.groupBy("story_id").agg(F.max("published_at").alias("t"))
        known = similarity.updated_centroids(still_open, joined).join(still_open.select("story_id", "last_updated_at"), "story_id")
        born = joined.join(still_open.select("story_id"), "story_id", "left_anti").select("story_id", "embedding")
        seeds = born.select("story_id", F.posexplode("embedding").alias("pos", "x")).groupBy("story_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
        fresh = seeds.groupBy("story_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select("story_id", F.col("p.x").alias("centroid"), "n", F.lit(None).cast("timestamp").alias("last_updated_at"))
        moved = known.unionByName(fresh).join(times, "story_id").withColumn("last_updated_at", F.greatest("last_updated_at", "t"))
        write_batch(moved.select("story_id", "centroid", "n", "last_updated_at"), f"{folder}/stories", batch_id)
        write_batch(joined, f"{folder}/rows", batch_id)

    run_available(items, folder, join_stories)
    return read_batches(spark, f"{folder}/rows", members).select("item_id", "story_id")


def feedback_once(feedback: DataFrame, folder: str, story_items: DataFrame, items: DataFrame) -> DataFrame:
    """(source_id, net): each feedback row counted once, however often a batch is run."""
    spark = feedback.sparkSession
    net = StructType([items.schema["source_id"], StructField("net", LongType())])
    open_table(spark, f"{folder}/rows", net)
    run_available(feedback, folder, lambda rows, batch_id: write_batch(ms.feedback_to_sources(rows, story_items, items), f"{folder}/rows", batch_id))
    schema = StructType([*net, StructField("batch_id", LongType())])
    return read_batches(spark, f"{folder}/rows", schema).groupBy("source_id").agg(F.sum("net").alias("net"))


def one_brief_a_day(editions: DataFrame, folder: str) -> DataFrame:
    """(day, headline): the first edition of each day; later ones for the same day are ignored."""
    spark, schema = editions.sparkSession, editions.schema
    wide = StructType([*schema, StructField("batch_id", LongType())])
    open_table(spark, f"{folder}/rows", schema)

    def publish(rows: DataFrame, batch_id: int) -> None:
        held = read_batches(spark, f"{folder}/rows", wide, batch_id)
        first = first_wins(rows, ["day"], F.struct(*[c for c in rows.columns if c != "day"]))
        write_batch(first.join(held.select("day"), "day", "left_anti").select(*rows.columns), f"{folder}/rows", batch_id)

    run_available(editions, folder, publish)
    return read_batches(spark, f"{folder}/rows", wide).drop("batch_id")


def with_pending(arrived: DataFrame, earlier: DataFrame) -> DataFrame:
    """A batch's new rows together with those an earlier, failed batch left at status 'new';
    the row that waited counts."""
    waiting = earlier.filter("status = 'new'").select(*arrived.columns, F.lit(0).alias("_turn"))
    both = waiting.unionByName(arrived.withColumn("_turn", F.lit(1)))
    rest = F.struct("_turn", *[c for c in arrived.columns if c != "item_id"])
    return first_wins(both, ["item_id"], rest).select(*arrived.columns)
