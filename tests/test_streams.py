"""Streams that arrive in several files."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd

from tidings.operators import dedup
from tidings.streaming import jobs, linking
from tidings.streaming.store import run_folder

START = dt.datetime(2026, 9, 27)


def _files(spark, folder, parts, schema):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:03d}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_arrivals_are_kept_once_over_batches(spark):
    folder = run_folder(spark, "test-arrivals")
    stream = _files(spark, folder, [[("a", START), ("b", START)], [("a", START + dt.timedelta(days=9)), ("c", START + dt.timedelta(days=9))]], "k string, ts timestamp")
    assert sorted(r["k"] for r in jobs.arrivals_once(stream, f"{folder}/out", "k").collect()) == ["a", "b", "c"]


def test_links_reach_originals_of_earlier_batches(spark):
    folder = run_folder(spark, "test-links")
    hour = dt.timedelta(hours=1)
    parts = [[(1, START, 5), (2, START + hour, 5)], [(3, START + 2 * hour, 4), (4, START + 60 * hour, 5)], [(5, START + 61 * hour, 5)]]
    stream = _files(spark, folder, parts, "item_id bigint, published_at timestamp, simhash bigint")
    got = {r[0]: r[1] for r in linking.linked_stream(stream, f"{folder}/out", dedup.Nearness(48, 3, None)).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: 4}


def test_one_brief_a_day(spark):
    folder = run_folder(spark, "test-briefs")
    stream = _files(spark, folder, [[("d1", "one")], [("d1", "two"), ("d2", "three")]], "day string, headline string")
    assert sorted(map(tuple, jobs.one_brief_a_day(stream, f"{folder}/out").collect())) == [("d1", "one"), ("d2", "three")]


def test_late_arrivals_never_seen_before_are_kept(spark):
    folder = run_folder(spark, "test-late")
    day = dt.timedelta(days=1)
    parts = [[("a", START + 30 * day), ("b", START + 30 * day)], [("c", START), ("a", START), ("d", START + 40 * day)], [("c", START + day), ("e", START - 300 * day)]]
    stream = _files(spark, folder, parts, "k string, ts timestamp")
    assert sorted(r["k"] for r in jobs.arrivals_once(stream, f"{folder}/out", "k").collect()) == ["a", "b", "c", "d", "e"]


def test_clusters_move_on_between_batches(spark):
    folder = run_folder(spark, "test-clusters")
    hour = dt.timedelta(hours=1)
    parts = [[(1, START, [1.0, 0.0]), (2, START + hour, [0.99, 0.1])], [(3, START + 2 * hour, [0.98, 0.15]), (4, START + 3 * hour, [0.0, 1.0])], [(5, START + 200 * hour, [1.0, 0.0])]]
    stream = _files(spark, folder, parts, "item_id bigint, published_at timestamp, embedding array<double>")
    none = spark.createDataFrame([], "item_id bigint, story_id bigint, same boolean")
    got = {r["item_id"]: r["story_id"] for r in jobs.clustered_stream(stream, f"{folder}/out", none, 0.9, 0.8).collect()}
    assert got[1] == got[2] == got[3] and len({got[1], got[4], got[5]}) == 3


def test_repeats_and_late_items_find_their_originals(spark):
    folder = run_folder(spark, "test-late-links")
    hour = dt.timedelta(hours=1)
    unit = [1.0, 0.0]
    parts = [
        [(10, START + 50 * hour, 7, unit), (11, START + 51 * hour, None, unit), (12, START, None, None)],
        [(13, START + 49 * hour, 7, None), (10, START + 50 * hour, 7, unit), (14, START + 20 * hour, 1 << 40, [0.0, 1.0])],
        [(15, START + 20 * hour, None, [0.0, 1.0]), (11, START + 51 * hour, None, unit), (16, START - 90 * hour, 7, None), (16, START - 90 * hour, 7, None)],
    ]
    stream = _files(spark, folder, parts, "item_id bigint, published_at timestamp, simhash bigint, embedding array<double>")
    found = linking.linked_stream(stream, f"{folder}/out", dedup.Nearness(48, 3, 0.95), salts=2).collect()
    assert len(found) == 7 and {r[0]: r[1] for r in found} == {10: None, 11: 10, 12: None, 13: 10, 14: None, 15: 14, 16: None}


def _batch(rows):
    frame = pd.DataFrame(rows, columns=["item_id", "at", "arrived", "simhash", "probe"])
    return frame.assign(arrived=pd.to_datetime(frame["arrived"], unit="ms"), published_at=pd.to_datetime(frame["at"], unit="us"), unit=None)


class _State:
    """What a group's state is asked for, without a query around it."""

    def __init__(self, watermark=0):
        self.value, self.due, self.hasTimedOut, self.watermark = None, None, False, watermark

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.due = None

    def setTimeoutTimestamp(self, at):
        self.due = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_kept_originals_follow_the_rate_of_arrival():
    """Ten thousand originals, one a second, kept for a minute."""
    group, state, most = linking.Originals(dedup.Nearness(48, 3, None), 60_000), _State(), 0
    for second in range(0, 10_000, 10):
        list(group((1,), iter([_batch([(i, i, i * 1000, i, False) for i in range(second, second + 10)])]), state))
        most = max(most, len(state.value[0]))
    assert most <= 70 and state.due == 9_999_000 + 60_000
    asked = list(group((1,), iter([_batch([(20_000, 9_995, 9_999_500, 9_995, True), (20_001, 5, 9_999_500, 5, True)])]), state))[0]
    assert asked["original_id"].notna().tolist() == [True, False] and asked["original_id"][0] in range(9_930, 10_000)
    state.hasTimedOut = True
    assert list(group((1,), iter([]), state)) == [] and not state.exists


def test_a_timer_closes_a_story(spark):
    folder = run_folder(spark, "test-closed")
    hour = dt.timedelta(hours=1)
    parts = [[(1, 1, START, [1.0, 0.0]), (1, 2, START + 2 * hour, [0.0, 1.0]), (2, 3, START, [1.0, 1.0])], [(2, 4, START + 5 * hour, [3.0, 1.0]), (2, 5, START + 30 * hour, [0.0, 0.0])], [(3, 6, START + 200 * hour, [1.0, 0.0]), (2, 7, START + 8 * hour, [2.0, 1.0])]]
    stream = _files(spark, folder, parts, "story_id bigint, item_id bigint, published_at timestamp, embedding array<double>")
    rows = linking.closed_stories(stream, f"{folder}/out", 6, "24 hours").collect()
    assert sorted((r["story_id"], (r["last_updated_at"] - START) / hour, r["n"], r["centroid"]) for r in rows) == [(1, 2.0, 2, [0.5, 0.5]), (2, 8.0, 3, [2.0, 1.0]), (2, 30.0, 1, [0.0, 0.0])]


def test_episodes_do_not_depend_on_the_order_of_arrival():
    rng = random.Random(3)
    rows = [(rng.randrange(400), [float(rng.randrange(9))]) for _ in range(60)]
    results = []
    for _ in range(4):
        rng.shuffle(rows)
        group, state = linking.Episodes(5_000_000), _State()
        for a in range(0, 60, 7):
            assert not len(list(group((1,), iter([pd.DataFrame([(at * 1_000_000, v) for at, v in rows[a : a + 7]], columns=["at", "embedding"])]), state))[0])
        state.watermark, state.hasTimedOut = 10**9, True
        closed = list(group((1,), iter([]), state))[0]
        results.append(sorted(zip(closed["first_seen_at"], closed["n"], closed["centroid"].map(tuple))))
        assert not state.exists and closed["n"].sum() == 60
    assert all(r == results[0] for r in results)
