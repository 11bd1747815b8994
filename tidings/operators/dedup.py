"""Near-duplicate linking: within a time window, every copy points at the earliest original.

An item is a duplicate only of an item that is itself an original, so the originals are the set a
single pass in (time, id) order would keep. The same set is found here in parallel rounds: an undecided
item without an earlier undecided item near it is an original, and what an original covers is a copy.
Both questions are semi-joins on keys, which stop at the first match, so a group of copies costs rows,
not pairs, and the first round already decides all but the items whose earlier neighbours are copies.
The number of rounds is the longest chain of such items, whatever the number of items.

Fingerprints need these rounds for very large groups only. Items that could be near each other, over any
number of steps, form a group, and a group is passed once in the order of time, with only the originals of
its window held. Groups are found on distinct fingerprints per window slot, so copies add nothing.

Where vectors have no cells, every item is near many others of its window and these chains are long.
There the timeline is swept in slices instead: blocks of a slice meet blocks of the originals found so
far, and only what these do not cover settles among itself, in one task per slice of bounded size. An
item is compared with originals, not with all items of its window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidings.functions import vectors as vx
from tidings.operators import neighbours
from tidings.session import checkpointed

GROUP = 200_000  # items of a group up to which it is passed in one go
BUCKET = 1_000  # distinct fingerprints of a key up to which they are compared in pairs
SLICE = 20_000
DRAWN = 32  # rows drawn per slice to find where slices begin


class Nearness:
    """What counts as near: fingerprint distance, or cosine of unit vectors, inside a window."""

    def __init__(self, window_hours: int = 48, distance: int | None = 3, cosine: float | None = 0.95, intact: int = 2):
        self.window = window_hours * 3600 * 1_000_000
        self.distance, self.cosine, self.intact = distance, cosine, intact

    def prepare(self, items: DataFrame) -> DataFrame:
        """The rows of ``placed``."""
        return self.placed(items)[0]

    def placed(self, items: DataFrame) -> tuple[DataFrame, bool]:
        """(rows, crowded): crowded if the rows have vectors only, and these no cells.

        Rows are (item_id, at, simhash, unit, slot, keys, probes): time in microseconds, its window slot, keys.

        ``keys`` are where an item lies: all keys of its fingerprint and the cell of its vector.
        ``probes`` are where it looks: the same fingerprint keys, and every cell that may hold a vector
        near its own. So of two items either finds the other, and only the looking side is repeated.
        """
        has_hash, has_vector = self.distance is not None and "simhash" in items.columns, self.cosine is not None and "embedding" in items.columns
        hash_col = F.col("simhash") if has_hash else F.lit(None).cast("bigint")
        unit = vx.unit_vector(F.col("embedding")) if has_vector else F.lit(None).cast("array<float>")
        base = items.select("item_id", F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), hash_col.alias("simhash"), unit.alias("unit"))
        base = base.withColumn("slot", F.floor(F.col("at") / self.window).cast("bigint"))
        none = F.array().cast("array<bigint>")
        by_hash = neighbours.simhash_keys(F.col("simhash"), self.distance, self.intact) if has_hash else none
        if not has_vector:
            return base.withColumn("keys", F.array_distinct(by_hash)).withColumn("probes", F.col("keys")), False
        radius = neighbours.chord(self.cosine)
        placed = neighbours.place(checkpointed(base), "item_id", "unit", radius)
        own = F.when(F.col("home").isNotNull(), F.array("home")).otherwise(none)
        keyed = placed.rows.withColumn("keys", F.array_distinct(F.concat(by_hash, own)))
        probes = F.array_distinct(F.concat(by_hash, placed.reach(F.col("unit"), radius)))
        return keyed.withColumn("probes", probes).drop("home"), placed.tree is None and not has_hash

    def near(self, a: str, b: str) -> Column:
        tests = []
        if self.distance is not None:
            tests.append(vx.hamming(F.col(f"{a}.simhash"), F.col(f"{b}.simhash")) <= self.distance)
        if self.cosine is not None:
            products = F.zip_with(F.col(f"{a}.unit"), F.col(f"{b}.unit"), lambda x, y: x.cast("double") * y.cast("double"))
            tests.append(F.aggregate(products, F.lit(0.0), lambda t, x: t + x) >= self.cosine)
        return reduce(lambda x, y: x | y, [F.coalesce(t, F.lit(False)) for t in tests])


def _lying(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "at", "simhash", "unit", "slot", F.explode("keys").alias("key"))


def _looking(rows: DataFrame, slots: tuple[int, ...]) -> DataFrame:
    """A row per key and slot in which the item looks."""
    spread = rows.select("item_id", "at", "simhash", "unit", F.explode(F.array(*[F.col("slot") + s for s in slots])).alias("slot"), "probes")
    return spread.select("item_id", "at", "simhash", "unit", "slot", F.explode("probes").alias("key"))


def _covered(late: DataFrame, early: DataFrame, rule: Nearness, how: str) -> DataFrame:
    """Rows of ``late`` joined with the earlier rows of ``early`` that are near them in the window."""
    left, right = _looking(late, (-1, 0)).alias("c"), _lying(early).alias("o")
    later = F.struct("c.at", "c.item_id") > F.struct("o.at", "o.item_id")
    same = (F.col("c.key") == F.col("o.key")) & (F.col("c.slot") == F.col("o.slot"))
    return left.join(right, same & later & (F.col("c.at") - F.col("o.at") <= rule.window) & rule.near("c", "o"), how)


def _with_earlier(late: DataFrame, early: DataFrame, rule: Nearness) -> DataFrame:
    """Item ids of ``late`` that have an earlier near item in ``early``."""
    return _covered(late, early, rule, "left_semi").select("item_id")


def originals(prepared: DataFrame, rule: Nearness) -> DataFrame:
    """Item ids of the originals. ``prepared`` must be a written table."""
    undecided, found = prepared, []
    while True:
        rest = checkpointed(undecided.join(_with_earlier(undecided, undecided, rule), "item_id", "left_semi"))
        free = undecided.join(rest.select("item_id"), "item_id", "left_anti")
        found.append(free.select("item_id"))
        if rest.isEmpty():
            break
        undecided = checkpointed(rest.join(_with_earlier(rest, free, rule), "item_id", "left_anti"))
        if undecided.isEmpty():
            break
    return reduce(DataFrame.union, found)


def canonical_items(items: DataFrame, rule: Nearness) -> DataFrame:
    """(item_id, canonical_item_id): null for originals, else the earliest original it copies."""
    placed, crowded = rule.placed(items)
    prepared = checkpointed(placed)
    if crowded:
        links = swept(prepared.select("item_id", "at", "unit"), rule)
        return prepared.select("item_id").join(links, "item_id", "left")
    links = _in_rounds(prepared, rule) if "embedding" in items.columns and rule.cosine is not None else _in_groups(prepared, rule)
    return prepared.select("item_id").join(links, "item_id", "left")


def _in_rounds(prepared: DataFrame, rule: Nearness) -> DataFrame:
    """(item_id, canonical_item_id) of the copies among ``prepared``, a written table."""
    keep = checkpointed(originals(prepared, rule))
    kept = prepared.join(keep, "item_id", "left_semi")
    rest = prepared.join(keep, "item_id", "left_anti")
    return _covered(rest, kept, rule, "inner").groupBy(F.col("c.item_id").alias("item_id")).agg(F.min(F.struct("o.at", "o.item_id"))["item_id"].alias("canonical_item_id"))


# --- groups of fingerprints


def _near_prints(rows: DataFrame, rule: Nearness) -> DataFrame:
    """(a, b): fingerprints linked so that all near ones of neighbouring slots are connected. Pairs are
    verified where few share a key; of many, each is linked with the first, which may connect too much."""
    nodes = rows.select("simhash", "slot", "keys").dropDuplicates(["simhash", "slot"])
    spread = nodes.select("simhash", F.explode(F.array(F.col("slot"), F.col("slot") - 1)).alias("slot"), "keys")
    spread = checkpointed(spread.select("simhash", "slot", F.explode("keys").alias("key")).distinct())
    sizes = spread.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("simhash").alias("first")).filter("n > 1")
    shared = checkpointed(spread.join(sizes, ["key", "slot"]))
    few = shared.filter(F.col("n") <= BUCKET)
    pairs = few.select("key", "slot", F.col("simhash").alias("a")).join(few.select("key", "slot", F.col("simhash").alias("b")), ["key", "slot"])
    pairs = pairs.filter((F.col("a") < F.col("b")) & (vx.hamming(F.col("a"), F.col("b")) <= rule.distance)).select("a", "b")
    stars = shared.filter((F.col("n") > BUCKET) & (F.col("simhash") != F.col("first"))).select(F.col("first").alias("a"), F.col("simhash").alias("b"))
    return pairs.union(stars).distinct()


def _groups(edges: DataFrame) -> DataFrame:
    """(simhash, root): equal roots where ``edges`` (a, b) connect. In every round each node moves to the
    neighbour, or itself, with the smallest hash of that round; the rounds grow with the logarithm."""
    open_edges = checkpointed(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    moves: list[DataFrame] = []
    while not open_edges.isEmpty():
        hashed = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))
        nearest = open_edges.groupBy("a").agg(F.min(hashed("b")).alias("n"))
        move = checkpointed(nearest.select(F.col("a").alias("simhash"), F.least("n", hashed("a"))["to"].alias("root")))
        drawn = open_edges.join(move.toDF("a", "ra"), "a").join(move.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        moves.append(move)
        open_edges = checkpointed(drawn.filter("a <> b").distinct())
    roots = moves.pop() if moves else open_edges.toDF("simhash", "root")
    while moves:
        roots = moves.pop().join(roots.toDF("root", "last"), "root", "left").select("simhash", F.coalesce("last", "root").alias("root"))
    return checkpointed(roots)


def _in_groups(prepared: DataFrame, rule: Nearness) -> DataFrame:
    """(item_id, canonical_item_id) of the copies among ``prepared``, a written table.

    Groups that are very large, or have an id that is null or stands for different rows, go in rounds."""
    rows = prepared.filter("simhash is not null and at is not null")
    roots = _groups(_near_prints(rows, rule))
    grouped = checkpointed(rows.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash")))
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = grouped.groupBy("item_id").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.min("simhash").alias("c"), F.max("simhash").alias("d"))
    repeated = repeated.filter("item_id is null or a < b or c < d").select(F.col("item_id").alias("_id"))
    odd = grouped.join(repeated, F.col("item_id").eqNullSafe(F.col("_id")), "left_semi").select("root").distinct().withColumn("odd", F.lit(True))
    kinds = checkpointed(sizes.join(odd, "root", "left").select("root", ((F.col("n") > GROUP) | F.col("odd").isNotNull()).alias("apart")))
    plain = grouped.join(kinds.filter("not apart"), "root", "left_semi").select("root", "at", "item_id", "simhash")
    shape = T.StructType([prepared.schema["item_id"], T.StructField("canonical_item_id", prepared.schema["item_id"].dataType)])
    links = plain.repartition("root").sortWithinPartitions("root", "at", "item_id").mapInPandas(_passed(rule), shape).distinct()
    if kinds.filter("apart").isEmpty():
        return links
    # An id of different rows may lie in several groups, one of which may have no other item.
    single = grouped.join(odd, "root", "left_semi").select("root").union(kinds.filter("apart").select("root")).distinct()
    apart = checkpointed(grouped.join(single, "root", "left_semi").select(*prepared.columns))
    return links.union(_in_rounds(apart, rule))


def _passed(rule: Nearness):
    """Rows in the order of (root, at, item_id): each group's earliest original near a row, if any. Equal
    rows are one. Only originals of the window are held, also from one batch to the next."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, last, link = None, None, None
        prints, ats, ids, first, held = np.zeros(64, dtype="uint64"), [], [], 0, 0
        for part in parts:
            copies, found = [], []
            for own, at, item, simhash in zip(part["root"].tolist(), part["at"].tolist(), part["item_id"].tolist(), part["simhash"].to_numpy("int64").view("uint64")):
                if own != root:
                    root, last, ats, ids, first, held = own, None, [], [], 0, 0
                if (at, item) != last:
                    last = (at, item)
                    while first < held and ats[first] < at - rule.window:
                        first += 1
                    near = np.flatnonzero(np.bitwise_count(prints[first:held] ^ simhash) <= rule.distance) if first < held else ()
                    link = ids[first + near[0]] if len(near) else None
                    if link is None:
                        if held == len(prints):  # room for as many as are in the window
                            prints, ats, ids = prints[first:held], ats[first:], ids[first:]
                            first, held = 0, len(ids)
                            prints = np.r_[prints, np.zeros(held + 64, dtype="uint64")]
                        prints[held] = simhash
                        ats.append(at)
                        ids.append(item)
                        held += 1
                if link is not None:
                    copies.append(item)
                    found.append(link)
            if copies:
                yield pd.DataFrame({"item_id": copies, "canonical_item_id": found})

    return run


# --- the timeline in slices


def _begins(rows: DataFrame, size: int) -> list[tuple]:
    """(at, item_id) at which slices of about ``size`` rows begin, all but the first."""
    slices = -(-rows.count() // size)
    if slices < 2:
        return []
    drawn = rows.select("at", "item_id").orderBy(F.xxhash64("item_id"), "item_id").limit(DRAWN * slices).collect()
    places = sorted((r["at"], r["item_id"]) for r in drawn)
    return sorted(set(places[DRAWN::DRAWN]))


def swept(rows: DataFrame, rule: Nearness, size: int = SLICE) -> DataFrame:
    """(item_id, canonical_item_id) of the copies among ``rows`` (item_id, at, unit), a written table."""
    spark, held = rows.sparkSession, rows.filter("item_id is not null and at is not null and unit is not null")
    held = checkpointed(held.repartitionByRange("at", "item_id").sortWithinPartitions("at", "item_id"))  # a slice lies in few files
    begins = [None, *_begins(held, size), None]
    shape = T.StructType([rows.schema["item_id"], T.StructField("at", T.LongType()), T.StructField("original_id", rows.schema["item_id"].dataType)])
    place = lambda b: F.struct(F.lit(b[0]).cast("bigint").alias("at"), F.lit(b[1]).cast(rows.schema["item_id"].dataType).alias("item_id"))
    links, kept = [], []
    for begin, end in zip(begins, begins[1:]):
        inside = [F.col("at") >= begin[0], F.struct("at", "item_id") >= place(begin)] if begin else []
        inside += [F.col("at") <= end[0], F.struct("at", "item_id") < place(end)] if end else []
        slice_ = held.filter(reduce(Column.__and__, inside, F.lit(True)))
        kept = [(k, last) for k, last in kept if begin is None or last >= begin[0] - rule.window]
        if kept:
            late = checkpointed(neighbours.packed(slice_.repartition(spark.sparkContext.defaultParallelism), ["item_id", "at"], "unit"))
            early = reduce(DataFrame.union, [k for k, _ in kept]).withColumnsRenamed({"item_ids": "kept_ids", "ats": "kept_ats", "units": "kept_units"})
            met = late.crossJoin(early).mapInPandas(_earliest(rule), shape)
            found = checkpointed(met.groupBy("item_id").agg(F.min(F.struct("at", "original_id"))["original_id"].alias("canonical_item_id")))
            links.append(found)
            slice_ = slice_.join(found, "item_id", "left_anti")
        settled = checkpointed(slice_.coalesce(1).mapInPandas(_settled(rule), T.StructType([*rows.schema.fields, T.StructField("canonical_item_id", rows.schema["item_id"].dataType)])))
        links.append(settled.filter("canonical_item_id is not null").select("item_id", "canonical_item_id"))
        own = settled.filter("canonical_item_id is null")
        last = own.agg(F.max("at")).first()[0]
        if last is not None:
            kept.append((checkpointed(neighbours.packed(own, ["item_id", "at"], "unit")), last))
    return reduce(DataFrame.union, links).groupBy("item_id").agg(F.min("canonical_item_id").alias("canonical_item_id"))


def _near_blocks(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, rule: Nearness) -> np.ndarray:
    """Which rows of ``b`` are near which of ``a`` and not more than the window before."""
    gap = a_at[:, None] - b_at[None, :]
    return ~(a @ b.T < rule.cosine) & (gap >= 0) & (gap <= rule.window)


def _earliest(rule: Nearness):
    """Of every row of a block the earliest row near it of a block of kept ones, which are all earlier."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                ids, kept_ids, kept_ats = np.array(list(row.item_ids)), np.array(list(row.kept_ids)), np.asarray(row.kept_ats)
                order = np.lexsort((kept_ids, kept_ats))
                late, early = np.reshape(row.units, (len(ids), -1)), np.reshape(row.kept_units, (len(order), -1))[order]
                near = _near_blocks(late, early, np.asarray(row.ats), kept_ats[order], rule)
                copies = np.flatnonzero(near.any(axis=1))
                first = order[near[copies].argmax(axis=1)]
                yield pd.DataFrame({"item_id": ids[copies], "at": kept_ats[first], "original_id": kept_ids[first]})

    return run


def _settled(rule: Nearness):
    """One row after the other in the order of time: the earliest kept row near it, or it is kept. Rows of
    one id are kept or not as a whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([p for p in parts if len(p)] or [pd.DataFrame({"item_id": [], "at": [], "unit": []})])
        if not len(rows):
            return
        rows = rows.sort_values(["at", "item_id"], kind="stable", ignore_index=True)
        ids, at, units = rows["item_id"].to_numpy(), rows["at"].to_numpy("int64"), np.stack(rows["unit"].to_numpy()).astype("float64")
        heads = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])])
        ends = np.r_[heads[1:], len(ids)]
        kept, links = np.zeros(0, dtype="int64"), np.full(len(ids), -1)
        for a in range(0, len(heads), neighbours.BLOCK):
            first, last = heads[a], ends[min(a + neighbours.BLOCK, len(heads)) - 1]
            kept = kept[at[kept] >= at[first] - rule.window]
            before = _near_blocks(units[first:last], units[kept], at[first:last], at[kept], rule)
            among = _near_blocks(units[first:last], units[first:last], at[first:last], at[first:last], rule)
            fresh = np.zeros(last - first, dtype=bool)
            for head, end in zip(heads[a : a + neighbours.BLOCK], ends[a : a + neighbours.BLOCK]):
                own = slice(head - first, end - first)
                near = np.flatnonzero(before[own].any(axis=0))
                if len(near):
                    links[head:end] = kept[near[0]]
                    continue
                near = np.flatnonzero(among[own].any(axis=0) & fresh)
                if len(near):
                    links[head:end] = first + near[0]
                else:
                    fresh[own] = True
            kept = np.r_[kept, first + np.flatnonzero(fresh)]
        rows["canonical_item_id"] = [ids[n] if n >= 0 else None for n in links]
        rows["canonical_item_id"] = rows["canonical_item_id"].astype(object if ids.dtype == object else "Int64")
        yield rows[["item_id", "at", "unit", "canonical_item_id"]]

    return run


def canonical_match(items: DataFrame, pool: DataFrame, rule: Nearness) -> DataFrame:
    """For each item the earliest near member of ``pool`` inside the window, before or after it.

    (item_id, canonical_item_id); items without a match are left out. The pool holds originals, so
    it has few near members per key; the matches of an item are reduced as they are found.
    """
    tagged = items.withColumn("_pool", F.lit(False)).unionByName(pool.withColumn("_pool", F.lit(True)), allowMissingColumns=True)
    ids = tagged.withColumn("item_id", F.struct("_pool", "item_id"))
    prepared = checkpointed(rule.prepare(ids))
    queries = prepared.filter(~F.col("item_id._pool")).withColumn("item_id", F.col("item_id.item_id"))
    members = prepared.filter("item_id._pool").withColumn("item_id", F.col("item_id.item_id"))
    left, right = _looking(queries, (-1, 0, 1)).alias("c"), _lying(members).alias("o")
    return (
        left.join(right, ["key", "slot"])
        .filter((F.col("c.item_id") != F.col("o.item_id")) & (F.abs(F.col("c.at") - F.col("o.at")) <= rule.window) & rule.near("c", "o"))
        .groupBy(F.col("c.item_id").alias("item_id"))
        .agg(F.min(F.struct("o.at", "o.item_id"))["item_id"].alias("canonical_item_id"))
    )
