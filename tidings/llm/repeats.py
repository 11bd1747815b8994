"""Finding runs of units (bytes or words) that also start earlier, from the coarse to the fine.

Every string of a given number of units picks one of the shorter runs in it, the one whose identifier
is smallest; equal strings pick the same place. Neighbouring strings that pick the same run form a
stretch.

1. A sketch of all picked runs, merged over the partitions, takes out those that occur once: a string
   occurs at most as often as the run it picks.
2. The remaining stretches are grouped as a whole. Where all stretches with the same picked run are
   equal, all but the earliest are repeats from end to end.
3. Only where they differ, the earliest of each kind are grouped string by string.

Each level is reduced inside a partition before it is shuffled: of equal members only the earliest is
sent, and of a picked run with differing stretches only two kinds, which is enough to show it. So a
picked run or a string gets a few rows from a partition, however many copies there are.

Identifiers are hashes of 64 bits; a string is named by two of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tidings.llm import buffers, sketch
from tidings.llm.tables import checkpointed

FLUSH = 1 << 20
LAST = np.iinfo(np.int64).max
CLASS, SURE, OPEN = 0, 1, 2
ROW = "one long, two long, id long, text_key long, run long, kind int"


def picked(ids: np.ndarray, reach: int) -> np.ndarray:
    """For every place the first of the ``reach`` places from it on that has the smallest number."""
    value, place, width = ids, np.arange(len(ids), dtype=np.int64), 1
    while width < reach:
        step = min(width, reach - width)
        left, right = value[:-step], value[step:]
        take = left <= right
        place, value = np.where(take, place[:-step], place[step:]), np.where(take, left, right)
        width += step
    return place


def again(ids: np.ndarray) -> np.ndarray:
    """A second hash of identifiers, for the second row of the sketch."""
    return buffers.mix(ids ^ np.uint64(buffers.ODD[2]))


def counted_runs(make_units):
    def make():
        units = make_units()

        def of(data, offsets):
            ids = units.stretches(data, offsets)[0]
            return ids, again(ids)

        return of

    return make


def _rows(one, two, ids, keys, runs, kind):
    for a in range(0, len(one), 50_000):
        s = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(one[s]), pa.array(two[s]), pa.array(ids[s]), pa.array(keys[s]), pa.array(runs[s]), pa.array(np.full(len(one[s]), kind, dtype=np.int32))],
            ["one", "two", "id", "text_key", "run", "kind"],
        )


def _spread(ids, keys, runs, kind):
    """Rows that need no bucket any more, dealt out evenly."""
    yield from _rows(keys ^ runs, ids, ids, keys, runs, kind)


def _later(one, two, ids, keys, starts, within: bool):
    """Of rows sorted by (one, two, id, text_key, start): whether each begins its class, and whether it
    is later than the first of its class: in a later document or, with ``within``, at a later start."""
    fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(one)), 0))
    late = ids != ids[head]
    if within:
        late |= (keys != keys[head]) | (starts != starts[head])
    return fresh, late


def _ordered(one, two, ids, keys, starts, within: bool):
    """Sorted order, beginnings of classes, later rows; and the rows that stand for a class."""
    order = np.lexsort((starts, keys, ids, two, one))
    fresh, late = _later(one[order], two[order], ids[order], keys[order], starts[order], within)
    return order, fresh, late, fresh if within else ~late


def _joined(ids, keys, starts, sizes):
    """Stretches (in any order) as rows of (id, text_key, run), neighbours in a text put together."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts, sizes = ids[order], keys[order], starts[order], sizes[order]
    if not len(ids):
        return ids, keys, starts
    apart = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + sizes[:-1])])
    begin = np.flatnonzero(apart)
    last = np.append(begin[1:], len(ids)) - 1
    length = starts[last] + sizes[last] - starts[begin]
    pieces = (length - 1 >> buffers.RUN_BITS) + 1
    head, step = np.repeat(begin, pieces), buffers.repeat_ranges(np.zeros(len(begin), dtype=np.int64), pieces) << buffers.RUN_BITS
    rest = np.minimum(np.repeat(length, pieces) - step, 1 << buffers.RUN_BITS) - 1
    return ids[head], keys[head], (starts[head] + step << buffers.RUN_BITS) + rest


def stretch_rows(shared, make_units, cells: int, within: bool):
    """Stretches whose picked run may occur again, reduced inside the partition. Rows keep the order of
    the texts, which packs them well."""

    def reduced(held):
        one, two, ids, keys, starts, sizes = (np.concatenate(x) for x in zip(*held))
        order, fresh, late, stands = _ordered(one, two, ids, keys, starts, within)
        sure = order[late]
        yield from _spread(*_joined(ids[sure], keys[sure], starts[sure], sizes[sure]), SURE)
        # Of the kinds of stretches around a run the first and the last stand for all; the others
        # are known to differ.
        sorted_one, kind = one[order], np.cumsum(fresh)
        begin = np.concatenate([[True], sorted_one[1:] != sorted_one[:-1]])
        group = np.cumsum(begin) - 1
        first, last = kind[begin][group], kind[np.append(np.flatnonzero(begin)[1:], len(order)) - 1][group]
        inner = np.sort(order[stands & (kind != first) & (kind != last)])
        yield from _spread(ids[inner], keys[inner], (starts[inner] << buffers.RUN_BITS) + sizes[inner] - 1, OPEN)
        outer = np.sort(order[stands & ((kind == first) | (kind == last))])
        yield from _rows(one[outer].view(np.int64), two[outer].view(np.int64), ids[outer], keys[outer], (starts[outer] << buffers.RUN_BITS) + sizes[outer] - 1, CLASS)

    def run(batches):
        bits, units, held, n = shared.value, make_units(), [], 0
        for rows, data, offsets in buffers.byte_groups(batches):
            one, two, text, start, size = units.stretches(data, offsets)
            keep = sketch.passing(bits, cells, one, again(one))
            if not len(keep):
                continue
            ids, keys = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy(zero_copy_only=False)
            held.append((one[keep], two[keep], ids[text[keep]], keys[text[keep]], start[keep], size[keep]))
            n += len(keep)
            if n >= FLUSH:
                yield from reduced(held)
                held, n = [], 0
        if n:
            yield from reduced(held)

    return run


def refined(within: bool):
    """Rows sorted by (one, two, id, text_key, run): which stretches are repeats as a whole (SURE), and
    which must be taken apart (OPEN). The rows of a run may lie in several batches."""

    def settled(one, two, ids, keys, runs):
        fresh, late = _later(one, two, ids, keys, runs, within)
        bucket = np.cumsum(np.concatenate([[True], one[1:] != one[:-1]])) - 1
        parted = np.bincount(bucket, weights=fresh)[bucket] > 1
        sure = np.flatnonzero(late)
        yield from _spread(*_joined(ids[sure], keys[sure], runs[sure] >> buffers.RUN_BITS, (runs[sure] & (1 << buffers.RUN_BITS) - 1) + 1), SURE)
        open_ = np.flatnonzero(~late & parted)
        yield from _spread(ids[open_], keys[open_], runs[open_], OPEN)

    def run(batches):
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            plain = columns[5] != CLASS
            for kind in (SURE, OPEN):
                own = columns[5] == kind
                if own.any():
                    yield from _spread(columns[2][own], columns[3][own], columns[4][own], kind)
            fresh = [c[~plain] for c in columns[:5]]
            held = fresh if held is None else [np.concatenate(pair) for pair in zip(held, fresh)]
            if not len(held[0]):
                continue
            # The last bucket may go on in the next batch.
            whole = int(np.searchsorted(held[0], held[0][-1]))
            if whole:
                yield from settled(*(c[:whole] for c in held))
                held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield from settled(*held)

    return run


def string_rows(make_units, within: bool):
    """All strings of the stretches (text, id, text_key, open runs), reduced inside the partition."""

    def reduced(held):
        one, two, ids, keys, starts = (np.concatenate(x) for x in zip(*held))
        order, _, late, stands = _ordered(one, two, ids, keys, starts, within)
        sure = order[late]
        yield from _spread(*_joined(ids[sure], keys[sure], starts[sure], np.ones(len(sure), dtype=np.int64)), SURE)
        rest = np.sort(order[stands])
        yield from _rows(one[rest].view(np.int64), two[rest].view(np.int64), ids[rest], keys[rest], starts[rest] << buffers.RUN_BITS, CLASS)

    def run(batches):
        units, held, n = make_units(), [], 0
        for rows, data, offsets in buffers.byte_groups(batches):
            ids, keys = rows.column(1).to_numpy(zero_copy_only=False), rows.column(2).to_numpy(zero_copy_only=False)
            runs = rows.column(3)
            sizes = runs.value_lengths().to_numpy(zero_copy_only=False)
            first, count = buffers.unpacked_runs(runs.flatten().to_numpy(zero_copy_only=False))
            text = np.repeat(np.repeat(np.arange(rows.num_rows), sizes), count)
            start = buffers.repeat_ranges(first, count)
            if not len(start):
                continue
            one, two = units.strings(data, offsets, text, start)
            held.append((one, two, ids[text], keys[text], start))
            n += len(one)
            if n >= FLUSH:
                yield from reduced(held)
                held, n = [], 0
        if n:
            yield from reduced(held)

    return run


def keyed(documents: DataFrame) -> DataFrame:
    """(id, text_key, text, doc_id): a null doc_id sorts after all others; the hash of the text tells
    rows apart that share a doc_id."""
    text = documents["text"].cast("string")
    number = documents["doc_id"].cast("bigint")
    return documents.select(F.coalesce(number, F.lit(int(LAST))).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"), number.alias("doc_id"))


def repeats(documents: DataFrame, make_units, within: bool, cells: int) -> DataFrame:
    """(id, text_key, runs): packed starts of all strings that also start earlier, in a document with a
    smaller id or, with ``within``, earlier in the order (id, text_key, start)."""
    docs = keyed(documents)
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(sketch.merged_sketch(docs, counted_runs(make_units), cells))  # of fixed size
    sent = docs.select("id", "text_key", "text").mapInArrow(stretch_rows(shared, make_units, cells, within), ROW)
    # By the picked run alone, so that all its stretches meet.
    level = sent.repartition("one").sortWithinPartitions("one", "two", "id", "text_key", "run").mapInArrow(refined(within), ROW)
    runs = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("run")))
    by_text = checkpointed(level.groupBy("id", "text_key").agg(runs(SURE).alias("sure"), runs(OPEN).alias("open")))
    open_ = by_text.filter("size(open) > 0").select("id", "text_key", "open")
    # With doc_id, as in the callers' join: the texts are then shuffled once for both.
    strings = docs.join(open_, ["id", "text_key"]).select("text", "id", "text_key", "open", "doc_id").mapInArrow(string_rows(make_units, within), ROW)
    place = F.struct("id", "text_key", "run") if within else F.struct("id")
    least = F.min(F.when(F.col("kind") == CLASS, place)).over(Window.partitionBy("one", "two"))
    late = strings.withColumn("least", least).filter((F.col("kind") == SURE) | (place > F.col("least")))
    fine = late.groupBy("id", "text_key").agg(F.collect_list("run").alias("fine"))
    both = F.concat("sure", F.coalesce("fine", F.array().cast("array<long>")))
    return by_text.select("id", "text_key", "sure").join(fine, ["id", "text_key"], "left").select("id", "text_key", both.alias("runs"))
