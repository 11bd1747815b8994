"""Near duplicates and story closing with keyed state that outlives a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from tidings.functions import vectors as vx
from tidings.operators import dedup, neighbours
from tidings.session import checkpointed
from tidings.streaming.store import open_table, read_batches, write_batch

KEPT = "ids array<bigint>, ats array<bigint>, came array<bigint>, prints array<bigint>, units array<binary>"
EPISODES = "firsts array<bigint>, lasts array<bigint>, ns array<bigint>, totals array<double>"
SALTS = 4


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64))


class Originals:
    """State of one key: the originals that lie there, each for ``keep_ms`` after it came.

    Rows with ``probe`` false are originals to be kept; the others ask for the earliest original near
    them in content and time, and are sent on with it. The clock is that of arrival, so no row is late;
    a key that nothing has reached for ``keep_ms`` leaves by a timer.
    """

    def __init__(self, rule: dedup.Nearness, keep_ms: int):
        self.window, self.distance, self.cosine, self.keep_ms = rule.window, rule.distance, rule.cosine, keep_ms

    def __call__(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        now = int(rows["arrived"].max().timestamp() * 1000)
        held = [h for h in zip(*state.get) if h[2] > now - self.keep_ms] if state.exists else []
        known = {h[0] for h in held}
        for i, at, h, u in rows.loc[~rows["probe"], ["item_id", "at", "simhash", "unit"]].itertuples(index=False, name=None):
            if i not in known:
                known.add(i)
                held.append((int(i), int(at), now, None if pd.isna(h) else int(h), None if u is None else np.asarray(u, dtype="float32").tobytes()))
        if held:
            state.update(tuple(list(column) for column in zip(*held)))
            state.setTimeoutTimestamp(max(h[2] for h in held) + self.keep_ms)
        elif state.exists:
            state.remove()
        probes = rows[rows["probe"]].reset_index(drop=True)
        if len(probes):
            vector = lambda b: None if b is None else np.frombuffer(b, dtype="float32")
            best = self._earliest(probes, sorted(((h[1], h[0], h[3], vector(h[4])) for h in held), key=lambda h: h[:2]))
            yield pd.DataFrame({
                "item_id": probes["item_id"], "published_at": probes["published_at"], "simhash": probes["simhash"].astype("Int64"), "unit": probes["unit"],
                "original_at": pd.array([None if b is None else b[0] for b in best], dtype="Int64"), "original_id": pd.array([None if b is None else b[1] for b in best], dtype="Int64"),
            })

    def _earliest(self, probes: pd.DataFrame, held: list) -> list:
        """(at, item_id) of the first of the ``held``, which are in order of time, near each probe."""
        if not held:
            return [None] * len(probes)
        at, ids = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        near = np.zeros((len(probes), len(held)), dtype=bool)
        if self.distance is not None:
            own, has = probes["simhash"].fillna(0).to_numpy("int64"), probes["simhash"].notna().to_numpy()
            other, other_has = np.array([h[2] or 0 for h in held], dtype="int64"), np.array([h[2] is not None for h in held])
            near |= (_hamming(own, other) <= self.distance) & has[:, None] & other_has[None, :]
        if self.cosine is not None:
            a, b = [n for n, u in enumerate(probes["unit"]) if u is not None], [n for n, h in enumerate(held) if h[3] is not None]
            if a and b:
                dots = np.array([probes["unit"][n] for n in a], dtype="float64") @ np.array([held[n][3] for n in b], dtype="float64").T
                near[np.ix_(a, b)] |= dots >= self.cosine
        near &= np.abs(probes["at"].to_numpy("int64")[:, None] - at[None, :]) <= self.window
        near &= probes["item_id"].to_numpy("int64")[:, None] != ids[None, :]
        first = near.argmax(axis=1)
        return [(int(at[f]), int(ids[f])) if near[n, f] else None for n, f in enumerate(first)]


def _prepared(items: DataFrame, rule: dedup.Nearness, tree: neighbours.PivotTree | None) -> DataFrame:
    """Items with their time slot, where they lie and where they look; all keys are column expressions."""
    unit = vx.unit_vector(F.col("embedding")) if "embedding" in items.columns and rule.cosine is not None else F.lit(None).cast("array<float>")
    simhash = F.col("simhash") if "simhash" in items.columns and rule.distance is not None else F.lit(None).cast("bigint")
    base = items.select("item_id", "published_at", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), simhash.alias("simhash"), unit.alias("unit"))
    base = base.withColumn("slot", F.floor(F.col("at") / rule.window).cast("bigint"))
    by_hash = neighbours.simhash_keys(F.col("simhash"), rule.distance, rule.intact) if rule.distance is not None else F.array().cast("array<bigint>")
    place = neighbours.Placed(base, tree, 1.0)
    return base.withColumn("keys", F.array_distinct(F.concat(by_hash, place.home(F.col("unit"))))).withColumn("probes", F.array_distinct(F.concat(by_hash, place.reach(F.col("unit"), neighbours.chord(rule.cosine or 1.0)))))


def linked_stream(items: DataFrame, folder: str, rule: dedup.Nearness, keep_hours: int | None = None, tree: neighbours.PivotTree | None = None, salts: int = SALTS) -> DataFrame:
    """(item_id, canonical_item_id) of arriving items (item_id, published_at, simhash and / or embedding).

    The originals found so far are keyed state: per key (a part of the fingerprint, or a cell of
    ``tree``) and time slot, dealt to ``salts`` groups. They stay ``keep_hours`` after they came (twice
    the window if not given), so the state follows the rate of arrival, not the length of the stream,
    and an item later than that no longer finds them. A micro-batch asks the state first; what is left
    settles among itself; its originals come back as a second source of the stream in the next batch.
    An item that arrives again keeps its first link.
    """
    spark, schema = items.sparkSession, items.schema
    kept = StructType([f for f in schema.fields if f.name in ("item_id", "published_at", "simhash", "embedding")])
    linked = StructType([*kept, StructField("canonical_item_id", schema["item_id"].dataType)])
    wide = StructType([*linked, StructField("batch_id", LongType())])
    open_table(spark, f"{folder}/rows", linked)
    names = kept.fieldNames()
    keep_ms = 1000 * 3600 * (keep_hours if keep_hours is not None else 2 * rule.window // 3_600_000_000)
    shape = ["probe", "key", "slot", "salt", "item_id", "at", "published_at", "simhash", "unit"]

    back = spark.readStream.schema(wide).parquet(f"{folder}/rows").filter("canonical_item_id is null").select(*names)
    own_salt = F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int").alias("salt")
    lying = _prepared(back, rule, tree).select(F.lit(False).alias("probe"), F.explode("keys").alias("key"), "slot", own_salt, "item_id", "at", "published_at", "simhash", "unit")
    arrived = _prepared(items.select(*names), rule, tree)
    looking = arrived.withColumn("slot", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # An item without any key looks under one of its own, so that it is seen at all.
    somewhere = F.when(F.size("probes") > 0, F.col("probes")).otherwise(F.array(F.xxhash64(F.lit("none"), F.col("item_id"))))
    looking = looking.withColumn("key", F.explode(somewhere)).withColumn("probe", F.lit(True)).select(*shape)
    both = lying.select(*shape).unionByName(looking).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    answers = both.groupBy("key", "slot", "salt").applyInPandasWithState(
        Originals(rule, keep_ms), "item_id bigint, published_at timestamp, simhash bigint, unit array<float>, original_at bigint, original_id bigint", KEPT, "append", "EventTimeTimeout"
    )

    def link(rows: DataFrame, batch_id: int) -> None:
        found = F.min(F.when(F.col("original_id").isNotNull(), F.struct("original_at", "original_id")))["original_id"]
        first = F.min(F.struct("published_at", "simhash", "unit"))
        asked = checkpointed(rows.groupBy("item_id").agg(first.alias("i"), found.alias("canonical_item_id")).select("item_id", "i.*", "canonical_item_id"))
        if asked.isEmpty():  # only originals came back; a written batch would come back again
            return
        asked = asked.withColumn("embedding", F.col("unit"))
        rest = asked.filter("canonical_item_id is null")
        settled = dedup.canonical_items(rest.select("item_id", "published_at", "simhash", "embedding"), rule)
        both = asked.filter("canonical_item_id is not null").unionByName(rest.drop("canonical_item_id").join(settled, "item_id"))
        columns = [F.col(f.name).cast(f.dataType) for f in linked]
        write_batch(both.select(*columns), f"{folder}/rows", batch_id)

    query = answers.writeStream.foreachBatch(link).option("checkpointLocation", f"{folder}/progress").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = read_batches(spark, f"{folder}/rows", wide)
    return rows.groupBy("item_id").agg(F.min(F.struct("batch_id", "canonical_item_id"))["canonical_item_id"].alias("canonical_item_id"))


class Episodes:
    """State of one story: its episodes that may still grow. A timer on event time closes them."""

    def __init__(self, window_us: int):
        self.window = window_us

    def __call__(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        episodes = self._held(state) if state.exists else []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            episodes += [(at, at, 1, np.asarray(v, dtype="float64")) for at, v in zip(rows["at"].tolist(), rows["embedding"])]
        episodes = self._joined(episodes)
        due = [self._due(e[1]) <= state.getCurrentWatermarkMs() for e in episodes]
        left = [e for e, gone in zip(episodes, due) if not gone]
        if left:
            state.update(([e[0] for e in left], [e[1] for e in left], [e[2] for e in left], np.concatenate([e[3] for e in left]).tolist()))
            state.setTimeoutTimestamp(min(self._due(e[1]) for e in left))
        elif state.exists:
            state.remove()
        yield self._rows(key, [e for e, gone in zip(episodes, due) if gone])

    @staticmethod
    def _held(state: GroupState) -> list:
        firsts, lasts, ns, totals = state.get
        return list(zip(firsts, lasts, ns, np.asarray(totals).reshape(len(ns), -1)))

    def _joined(self, episodes: list) -> list:
        """Those that touch within the window are one."""
        out: list = []
        for first, last, n, total in sorted(episodes, key=lambda e: e[:3]):
            if out and first <= out[-1][1] + self.window:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n, out[-1][3] + total)
            else:
                out.append((first, last, n, total))
        return out

    def _due(self, last: int) -> int:
        """The first millisecond at which nothing can join any more."""
        return (last + self.window) // 1000 + 1

    def _rows(self, key, closed: list) -> pd.DataFrame:
        return pd.DataFrame({
            "story_id": [key[0]] * len(closed), "first_seen_at": pd.to_datetime([c[0] for c in closed], unit="us"), "last_updated_at": pd.to_datetime([c[1] for c in closed], unit="us"),
            "n": [c[2] for c in closed], "centroid": [[x / c[2] for x in c[3]] for c in closed],
        })


def closed_stories(joined: DataFrame, folder: str, window_hours: int = 72, lateness: str = "24 hours") -> DataFrame:
    """(story_id, first_seen_at, last_updated_at, n, centroid) of stories that have been silent for the
    whole window, from a stream (story_id, item_id, published_at, embedding) of items that joined them.

    The open episodes of a story are state, and leave it when the watermark passes the end of their
    window; until then items that come late join them, so the order of arrival does not count. An item
    beyond the window opens another episode. Items later than ``lateness`` are left out. The stories
    still open when the stream ends are not among the rows.
    """
    spark = joined.sparkSession
    story = joined.schema["story_id"].dataType.simpleString()
    rows = joined.filter(F.col("embedding").isNotNull()).withWatermark("published_at", lateness)
    rows = rows.select("story_id", "published_at", F.unix_micros("published_at").alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"story_id {story}, first_seen_at timestamp, last_updated_at timestamp, n bigint, centroid array<double>"
    closed = rows.groupBy("story_id").applyInPandasWithState(Episodes(window_hours * 3_600_000_000), schema, EPISODES, "append", "EventTimeTimeout")
    open_table(spark, f"{folder}/closed", schema)
    query = closed.writeStream.foreachBatch(lambda r, batch_id: write_batch(r, f"{folder}/closed", batch_id)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_batches(spark, f"{folder}/closed", schema + ", batch_id bigint").drop("batch_id")
