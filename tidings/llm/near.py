"""Near copies by word shingles: every pair of texts whose sets of five words are similar enough.

All shingles have one order: by how often they lead in the corpus (in powers of two, those that few sets
hold are equal), then by hash. Two sets that reach the similarity share a shingle among the first few of
both (a fifth and one, for 4/5), so only those are grouped. That loses no pair. Groups are linked by
rounds of stars: all sets of a group meet its first 1, 8, 64, ... sets, pairs that meet are verified on
the whole sets, a set that has met its group leaves it, and so does a group whose sets are all connected.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidings.llm import buffers
from tidings.llm.graph import components
from tidings.llm.simhash import first_of_groups
from tidings.llm.tables import Passing, checkpointed, documents_of

SHINGLE = 5
PART, WHOLE = 4, 5  # the least similarity is 4/5
PARITY_BITS = 9
PARITIES = [f"p{i}" for i in range((1 << PARITY_BITS) // 64)]
HEAVY = 8
MOST_HEAVY = 1 << 19  # bounds a broadcast; only the order hangs on it, not the result
SEEN = 1 << 18
GROWTH = 8  # of the centres a group has in each round


class Shingles:
    """Sets of hashes of runs of words; a text with fewer words has its whole sequence as one run."""

    def __init__(self, size: int):
        self.size = size
        self.separator, self.lower = buffers.separators("space"), buffers.lower_table()
        self.bytes, self.first, self.second, self.set = (buffers.Rolling(i) for i in range(1, 5))

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, text) without repeats, sorted by text and hash."""
        data = self.lower[data]
        starts, ends, first = buffers.word_spans(data, offsets, self.separator)
        word = self.bytes.runs(self.bytes.prefix(data), starts, ends)
        n = np.diff(first)
        counts = np.where(n >= self.size, n - self.size + 1, np.minimum(n, 1))
        at, text = buffers.repeat_ranges(first[:-1], counts), np.repeat(np.arange(len(n)), counts)
        found = self.first.runs(self.first.prefix(word), at, np.minimum(at + self.size, first[text + 1]))
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        return found[new], text[new]

    def names(self, found: np.ndarray, text: np.ndarray, texts: int):
        """Hash and size of each text's set."""
        edges = np.searchsorted(text, np.arange(texts + 1))
        return self.set.runs(self.set.prefix(buffers.mix(found.copy())), edges[:-1], edges[1:]).view(np.int64), np.diff(edges)


def named(size: int):
    def run(batches):
        shingles = Shingles(size)
        for rows, data, offsets in buffers.byte_groups(batches):
            found, text = shingles.of(data, offsets)
            names, sizes = shingles.names(found, text, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(names), pa.array(sizes)], ["doc_id", "text_key", "set", "n"])

    return run


def classes_of(found: np.ndarray, heavy) -> np.ndarray:
    """The class of each hash: 0 if it is not among the sorted ``heavy`` ones."""
    hashes, classes = heavy
    if not len(hashes):
        return np.zeros(len(found), dtype=np.uint8)
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    return np.where(hashes[at] == found, classes[at], 0)


def leading_count(sizes: np.ndarray, part: int, whole: int) -> np.ndarray:
    """How many of a set's first shingles a similar set must share one of: it holds part/whole of them."""
    return np.where(sizes > 0, sizes - -(-part * sizes // whole) + 1, 0)


def leading_counts(size: int, part: int, whole: int):
    """(shingle, c): how many texts of a batch a shingle leads by the order of hashes."""

    def run(batches):
        shingles = Shingles(size)
        for rows, data, offsets in buffers.byte_groups(batches):
            found, text = shingles.of(data, offsets)
            sizes = np.bincount(text, minlength=rows.num_rows)
            place = np.arange(len(found)) - (np.cumsum(sizes) - sizes)[text]
            led, c = np.unique(found[place < leading_count(sizes, part, whole)[text]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(led.view(np.int64)), pa.array(c)], ["shingle", "c"])

    return run


def leading(size: int, part: int, whole: int, heavy):
    """(shingle, set, n, place): the shingles of each set that one of a similar set must be among.
    Sets that the task has just sent are not sent again."""

    def run(batches):
        shingles, frequent, seen = Shingles(size), heavy.value, set()
        for rows, data, offsets in buffers.byte_groups(batches):
            found, text = shingles.of(data, offsets)
            names, sizes = shingles.names(found, text, rows.num_rows)
            new = np.zeros(rows.num_rows, dtype=bool)
            for i, name in enumerate(names.tolist()):
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            if len(seen) > SEEN:
                seen = set()
            order = np.lexsort((found, classes_of(found, frequent), text))
            place = np.arange(len(found)) - (np.cumsum(sizes) - sizes)[text]
            sent = (place < leading_count(sizes, part, whole)[text]) & new[text]
            keep, place = order[sent], place[sent]
            yield pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), *[pa.array(v) for v in (names[text[keep]], sizes[text[keep]].astype(np.int32), place.astype(np.int32))]], ["shingle", "set", "n", "place"])

    return run


def whole_sets(size: int):
    def run(batches):
        shingles = Shingles(size)
        for rows, data, offsets in buffers.byte_groups(batches):
            found, text = shingles.of(data, offsets)
            names, sizes = shingles.names(found, text, rows.num_rows)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            bit = (found >> np.uint64(64 - PARITY_BITS)).astype(np.int64) + (text << PARITY_BITS)
            odd = (np.bincount(bit, minlength=rows.num_rows << PARITY_BITS) & 1).astype(np.uint8)
            parities = np.packbits(odd.reshape(rows.num_rows, -1), axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes), *[pa.array(p) for p in parities.T.copy()], lists], ["set", "n", *PARITIES, "shingles"])

    return run


def parities_allow(n: Column, m: Column, one: str, other: str, part: int, whole: int) -> Column:
    """Whether sets of n and m shingles can be similar: their parities differ in no more bits than the
    sets do in shingles. ``one`` and ``other`` name the columns of a parity."""
    apart = sum((F.bit_count(F.col(one.format(p)).bitwiseXOR(F.col(other.format(p)))) for p in PARITIES), F.lit(0))
    return apart * (part + whole) <= (whole - part) * (n + m)


def similar(pairs: DataFrame, sets: DataFrame, part: int, whole: int, held: Passing) -> DataFrame:
    """The rows (a, b, ...) whose sets are similar enough: shared * whole >= part * all of both."""
    of = lambda side: sets.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"), *[F.col(p).alias(f"{p}_{side}") for p in PARITIES])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    close = held.write(both.filter(parities_allow(both["n_a"], both["n_b"], "{}_a", "{}_b", part, whole)).select(*pairs.columns))
    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("set").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    found = held.write(close.join(one, "a").join(two, "b").filter(shared * (part + whole) >= part * (F.size("of_a") + F.size("of_b"))).select(*pairs.columns))
    held.drop(close)
    return found


def may_reach(n: Column, m: Column, i: Column, j: Column, part: int, whole: int) -> Column:
    """Whether sets of n and m shingles whose first shared ones stand at i and j can be similar."""
    return F.least(n - i, m - j) * (part + whole) >= (n + m) * part


def nearer_roots(found: DataFrame) -> DataFrame:
    """(root, next): each root of ``found`` (from, to) goes to the linked root, or itself, that has the
    smallest hash, and on to where that one goes. Centres have the smallest hashes of their groups, so
    a star falls together at once; what a long chain leaves apart is only looked at again."""
    both = found.select(F.col("from").alias("root"), F.col("to").alias("other")).union(found.select(F.col("to").alias("root"), F.col("from").alias("other")))
    of = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
    step = both.groupBy("root").agg(F.min(of("other")).alias("least")).select("root", F.least("least", of("root"))["to"].alias("next"))
    onward = step.select(F.col("root").alias("next"), F.col("next").alias("last"))
    return step.join(onward, "next", "left").select("root", F.coalesce("last", "next").alias("next")).filter("root <> next")


def roots_of(rows: DataFrame, sets: DataFrame, part: int, whole: int, held: Passing) -> DataFrame:
    """(set, root) of all sets that a similar pair links; ``rows`` are (shingle, set, n, place).

    Roots inside the rounds are only as good as the links so far and spare pairs that are known to be
    connected; the components of all links are taken once, after the last round. In the first round a
    row meets one centre. The rows that are left after it carry the parities of their sets, so that
    the join of the later rounds gives only pairs that these allow.
    """
    left, links, stars = held.write(rows.withColumn("root", F.col("set"))), [], 1
    sketches, carried = sets.select("set", *PARITIES), []
    while True:
        apart = left.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
        still = held.write(left.join(apart, "shingle", "left_semi"))
        held.drop(left)
        left = still
        if left.isEmpty():
            break
        rank = F.row_number().over(Window.partitionBy("shingle").orderBy(F.xxhash64("set"), "set"))
        centres = left.withColumn("rank", rank).filter(F.col("rank") <= stars)
        centres = held.write(centres.select("shingle", F.col("set").alias("to"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("root").alias("other"), *[F.col(p).alias(f"{p}_to") for p in carried]))
        met = left.join(centres, "shingle").filter(F.col("root") != F.col("other"))
        met = met.filter(may_reach(F.col("n"), F.col("m"), F.col("place"), F.col("at"), part, whole))
        if carried:
            met = met.filter(parities_allow(F.col("n"), F.col("m"), "{}", "{}_to", part, whole))
        forth, back = F.struct(F.col("set").alias("s"), F.col("root").alias("r")), F.struct(F.col("to").alias("s"), F.col("other").alias("r"))
        met = met.select(F.least(forth, back).alias("x"), F.greatest(forth, back).alias("y"))
        pairs = held.write(met.select(F.col("x.s").alias("a"), F.col("y.s").alias("b"), F.col("x.r").alias("from"), F.col("y.r").alias("to")).distinct())
        found = similar(pairs, sets, part, whole, held)
        links.append(found.select("a", "b"))
        moved = held.write(nearer_roots(found))
        done = centres.select("shingle", F.col("to").alias("set"))
        rest = left.join(done, ["shingle", "set"], "left_anti").join(moved, "root", "left")
        if not carried:
            rest, carried = rest.join(sketches, "set"), PARITIES
        still = held.write(rest.select("shingle", "set", "n", "place", *carried, F.coalesce("next", "root").alias("root")))
        held.drop(left, centres, pairs, moved)
        left, stars = still, stars * GROWTH
    every = reduce(DataFrame.union, links) if links else rows.select(F.col("set").alias("a"), F.col("set").alias("b"))
    return components(every, held.write).withColumnRenamed("node", "set")


def heavy_shingles(docs: DataFrame, shingle: int, part: int, whole: int):
    """Hashes, sorted, and classes of the shingles that lead more than ``HEAVY`` texts; bounded."""
    counts = docs.select("text").mapInArrow(leading_counts(shingle, part, whole), "shingle long, c long").groupBy("shingle").agg(F.sum("c").alias("c"))
    most = counts.filter(F.col("c") > HEAVY).orderBy(F.desc("c"), "shingle").limit(MOST_HEAVY).toArrow()
    hashes, classes = most["shingle"].to_numpy().view(np.uint64), 1 + np.log2(np.maximum(most["c"].to_numpy(), 1)).astype(np.uint8)
    order = np.argsort(hashes)
    return hashes[order], classes[order]


def near_groups(documents: DataFrame, shingle: int = SHINGLE, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """(doc_id, text_key, root): documents with equal roots are connected by similar pairs.

    Words run between white space, ASCII letters without case. Null, empty and wordless texts are one
    group. Rows are told apart by doc_id, which may be null, and text; rows that repeat both give
    repeated rows. Further columns are not read; an empty table gives no rows. Sets and shingles are
    named by hashes of 64 bits.
    """
    docs, spark = documents_of(documents), documents.sparkSession
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, shingle, part, whole))
    with Passing(spark) as held:
        marked = held.write(docs.mapInArrow(named(shingle), "doc_id long, text_key long, set long, n long"))
        sent = held.write(docs.select("doc_id", "text").mapInArrow(leading(shingle, part, whole, heavy), "shingle long, set long, n int, place int"))
        meeting = held.write(sent.groupBy("shingle").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high").select("shingle"))
        rows = held.write(sent.join(meeting, "shingle", "left_semi").distinct())
        held.drop(sent, meeting)
        one = marked.join(rows.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min("text_key").alias("text_key")).select("text_key")
        texts = docs.select("text_key", "text").join(held.write(one), "text_key", "left_semi").dropDuplicates(["text_key"])
        sets = held.write(texts.mapInArrow(whole_sets(shingle), f"set long, n long, {', '.join(f'{p} long' for p in PARITIES)}, shingles array<long>"))
        roots = roots_of(rows, sets, part, whole, held)
        return checkpointed(marked.join(roots, "set", "left").select("doc_id", "text_key", F.coalesce("root", "set").alias("root")))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """The documents, all columns as they came, with one document of each group of near copies."""
    return first_of_groups(documents, near_groups(documents, **options))
