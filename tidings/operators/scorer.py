"""Scores of many searches over blocks of items, best first.

A block of items is cut into words once, and these become postings of the words that are asked for. All
searches of plain words meet it together, as arrays of pairs of search and item. An item is a candidate if
it holds all words of the search, or if both have a vector; of the latter only those whose cosine, with the
most that words could add, reaches the search's last kept score. What words could add at most is known from
how often they occur and how densely, and only candidates that could still be among the best are ranked by
all their close pairs, the most promising of each search first. The best of each search are kept over all
blocks that a task sees; a search that a block cannot change skips it, and a block that changes none is not
cut into words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

# Weight of an unlabelled word, the sum of 1/n^2, and the reach of word distance.
WORD_WEIGHT = 0.1
SERIES = 1.64493406685
MAX_DISTANCE = 100
VECTOR_SHARE, TEXT_SHARE = 0.6, 0.4

FULL = -40.0  # the exponential of this is nothing beside 1 in double precision

# By distance: the logarithm of what a close pair leaves open; the sum over all distances of one side.
LEFT_OPEN = np.log1p(-WORD_WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(np.arange(MAX_DISTANCE + 1) / 1.5 - 2))))
ONE_SIDE = -LEFT_OPEN[1:].sum()

# By the gap between two places: the most that a place between them gets from both; what a place beyond the
# first gets from the second and all farther ones. A gap beyond reach is FAR.
FAR = 2 * MAX_DISTANCE + 2
_GIVES = np.concatenate([[0.0], -LEFT_OPEN[1:], np.zeros(FAR)])
BETWEEN = np.array([0.0, 0.0, *[(_GIVES[1:g] + _GIVES[g - 1 : 0 : -1]).max() for g in range(2, FAR + 1)]])
BEYOND = np.array([_GIVES[g + 1 :].sum() for g in range(FAR + 1)])

SLACK = 1e-9  # room for rounding in what words could add at most
COSINE_SLACK = 1e-12  # and in cosines of equal vectors
UNSEEN = 1e-15  # what is open may differ by this from its float
FIRST_RANKED = 32  # items that a search ranks first in a block, twice as many each time
KEPT_BLOCKS = 16  # query blocks that a task keeps parsed
CHUNK, COSINES = 8_192, 2 << 20  # searches that meet a block at a time, and their cosines
PAIRS = 1 << 18  # pairs looked at in one go
OCCURRENCES = 1 << 17  # and occurrences of their words
TABLE = 16 << 20  # bytes of a block's table of frequent words


def expanded(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all places start, start + 1, ... of every owner."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sizes add up to about ``most`` at most."""
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]))


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, ascending."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Postings:
    """Occurrences (word, item, position) of the asked words in texts, whose words a blank parts; sorted,
    positions from 1. A cell is a word in an item."""

    def __init__(self, texts: list, numbers: dict[str, int]):
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        sizes = np.asarray(pc.list_value_length(pieces), dtype=np.int64)
        found = pieces.flatten().dictionary_encode()
        known = np.array([numbers.get(w, -1) for w in found.dictionary.to_pylist()], dtype=np.int64)
        word = known[np.asarray(found.indices)] if len(known) else np.zeros(0, dtype=np.int64)
        del pieces, found
        places = np.flatnonzero(word >= 0)
        bits = int(len(word)).bit_length()
        order = np.sort((word[places] << bits) | places)
        word, places = order >> bits, order & ((1 << bits) - 1)
        item, start = np.repeat(np.arange(len(sizes)), sizes)[places], np.cumsum(sizes) - sizes
        self.items, self.item, self.position = len(sizes), item, places - start[item] + 1
        self.first = np.searchsorted(word, np.arange(len(numbers) + 1))

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[number], self.first[number + 1])
        return self.item[own], self.position[own]

    @cached_property
    def cells(self) -> Cells:
        return Cells(self)


class Cells:
    """Of every cell: its item, its first occurrence, their number, and the most that they all could add to
    one occurrence of another word."""

    def __init__(self, postings: Postings):
        item, position, words = postings.item, postings.position, len(postings.first) - 1
        self.items = postings.items
        key = np.repeat(np.arange(words), np.diff(postings.first)) * self.items + item
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        self.start, self.key = np.flatnonzero(new), key[new]
        self.item, self.n = item[self.start], np.diff(np.append(self.start, len(key)))
        self.first = np.searchsorted(self.start, np.append(postings.first, len(key)))  # one word more, which no item holds
        gap = np.full(len(key) + 2, FAR)
        gap[1:-2] = np.where(new[1:], FAR, np.minimum(np.diff(position), FAR)) if len(key) else gap[1:-2]
        beyond = BEYOND[gap]
        around = np.maximum(BETWEEN[gap[1:-1]] + beyond[:-2] + beyond[2:], _GIVES[1] + beyond[1:-1])
        self.dense = np.maximum.reduceat(around, self.start) if len(key) else np.zeros(0)
        held = np.diff(self.first)
        some, self.most_n, self.most_dense = np.flatnonzero(held), np.zeros(len(held), dtype=np.int64), np.zeros(len(held))
        if len(some):  # of a word in any item
            self.most_n[some], self.most_dense[some] = np.maximum.reduceat(self.n, self.first[some]), np.maximum.reduceat(self.dense, self.first[some])
        # Frequent words have a table, the others are sought.
        frequent = np.argsort(-held, kind="stable")[: TABLE // (4 * max(1, self.items))]
        frequent = frequent[held[frequent] > 0]
        self.row = np.full(len(held), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.table = np.full((max(1, len(frequent)), self.items), -1, dtype=np.int32)
        owner, cell = expanded(self.first[frequent], held[frequent])
        self.table[owner, self.item[cell]] = cell

    def at(self, word: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The cell of every pair of word and item, -1 if there is none."""
        row = self.row[word]
        cell = self.table[row, item].astype(np.int64)
        rare = np.flatnonzero(row < 0)
        if len(rare):
            key = word[rare] * self.items + item[rare]
            place = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            cell[rare] = np.where(self.key[place] == key, place, -1) if len(self.key) else -1
        return cell


def single_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank by occurrences of one word: of these the n-th counts 1/n^2."""
    return np.concatenate([[0.0], np.cumsum(WORD_WEIGHT / np.arange(1, counts.max(initial=0) + 1) ** 2)])[counts] / SERIES


def mean_ranks(postings: Postings, words: list[int]) -> np.ndarray:
    """The mean of the words' ranks by occurrences."""
    return sum((single_ranks(np.bincount(postings.of(w)[0], minlength=postings.items)) for w in words), 0.0) / len(words)


def close_ranks(postings: Postings, words: list[int]) -> np.ndarray:
    """Rank by nearness of all items: close pairs of different words add up, nearer ones weigh more."""
    held = [postings.of(w) for w in words]
    item, position = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    word = np.repeat(np.arange(len(words)), [len(h[0]) for h in held])
    order = np.lexsort((position, item))
    return nearness(item[order], position[order], word[order], postings.items)


def nearness(item: np.ndarray, position: np.ndarray, word: np.ndarray, items: int, need: np.ndarray | None = None) -> np.ndarray:
    """The rank by nearness of occurrences in order of item and position. An item whose rank is 1 to the
    last digit is not looked at any further; one that cannot leave open as little as ``need`` has no rank."""
    miss = np.zeros(items)
    if not len(item):
        return miss
    new = np.append(True, (item[1:] != item[:-1]) | (word[1:] != word[:-1]))
    run = np.cumsum(new)  # of one word: what it is close to comes after it
    at, to = np.arange(len(item)), np.append(np.flatnonzero(new), len(item))[run]
    for step in range(len(item)):
        inside = to < len(item)
        at, to = at[inside], to[inside]
        gap, own = position[to] - position[at], item[at]
        near = (item[to] == own) & (gap <= MAX_DISTANCE)  # places of an item ascend: wider steps are farther still
        at, to, gap, own = at[near], to[near], gap[near], own[near]
        if not len(at):
            break
        if need is not None and step & (step + 1) == 0:  # a place has one other at each greater distance at most
            lost = (miss - np.bincount(own, weights=BEYOND[gap - 1], minlength=items)) * (1 + SLACK) > need
            if lost.any():
                miss[lost], keep = 0.0, ~lost[own]
                at, to, gap, own = at[keep], to[keep], gap[keep], own[keep]
        pairs = word[to] != word[at] if step else slice(None)
        miss += np.bincount(own[pairs], weights=LEFT_OPEN[gap[pairs]], minlength=items)
        full = miss <= FULL
        if full.any():
            keep = ~full[own]
            at, to = at[keep], to[keep]
        to = to + 1
    return 1 - np.exp(miss)


def holding(postings: Postings, terms: list[list[int]]) -> np.ndarray:
    """Which items hold a run of words (a term of one or more)."""
    if len(terms) == 1:
        out = np.zeros(postings.items, dtype=bool)
        out[postings.of(terms[0])[0]] = True
        return out
    span = int(postings.position.max(initial=0)) + len(terms) + 2
    places = None
    for back, word in enumerate(terms):
        item, position = postings.of(word)
        own = item * span + position + len(terms) - back
        places = own if places is None else np.intersect1d(places, own, assume_unique=True)
    out = np.zeros(postings.items, dtype=bool)
    out[np.unique(places // span)] = True
    return out


class Search:
    """One search: alternatives of (negated, word numbers), and all its words."""

    def __init__(self, alternatives: list, numbers: dict[str, int]):
        self.alternatives = [[(bool(t["negated"]), [numbers.setdefault(w, len(numbers)) for w in t["words"]]) for t in a] for a in alternatives]
        self.words = list(dict.fromkeys(w for a in self.alternatives for _, words in a for w in words))
        self.close = len(self.alternatives) == 1 and len(self.words) > 1
        self.plain = all(len(a) for a in self.alternatives) and len(self.alternatives) < 2 and all(not negated and len(words) == 1 for a in self.alternatives for negated, words in a)

    def ranks(self, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
        """(rank, matched) of every item."""
        if not self.words:
            return np.zeros(postings.items), np.zeros(postings.items, dtype=bool)
        held = np.zeros(postings.items, dtype=bool)
        for word in self.words:
            held[postings.of(word)[0]] = True
        matched = np.zeros(postings.items, dtype=bool)
        for terms in self.alternatives:
            every = np.ones(postings.items, dtype=bool)
            for negated, words in terms:
                every &= holding(postings, words) != negated
            matched |= every
        rank = close_ranks(postings, self.words) if self.close else mean_ranks(postings, self.words)
        return np.where(held, rank, 0.0), matched & held


def all_ranks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(query_id, item_id, matched, rank) of every item that holds a word of a search."""
    for part in parts:
        for row in part.itertuples(index=False):
            numbers: dict[str, int] = {}
            searches, ids = [Search(json.loads(t), numbers) for t in row.termss], np.array(row.item_ids)
            postings = Postings(row.longs, numbers)
            for query, search in zip(row.query_ids, searches):
                held = np.unique(np.concatenate([postings.of(w)[0] for w in search.words])) if search.words else np.zeros(0, dtype=np.int64)
                if len(held):
                    rank, matched = search.ranks(postings)
                    yield pd.DataFrame({"query_id": [query] * len(held), "item_id": ids[held], "matched": matched[held], "rank": rank[held]})


class Block:
    """Items beside searches: those with a vector first. Postings are made when the first search needs them."""

    def __init__(self, ids, haves, units: np.ndarray, longs: list, shorts: list):
        haves = np.asarray(haves, dtype=bool)
        order = np.argsort(~haves, kind="stable")
        ids = np.array(ids)
        self.ids, self.held, self.items = (ids if ids.dtype.kind in "if" else ids.astype(object))[order], int(haves.sum()), len(haves)
        self.units = np.asarray(units, dtype="float64").reshape(self.held, -1) if self.held else None
        self.texts = [[texts[n] for n in order] for texts in (longs, shorts)]
        self.least = self.ids.min() if self.items else None

    def postings(self, numbers: dict[str, int]) -> list[Postings]:
        """Of the whole texts and of the short ones, kept for the searches of the same numbers."""
        if getattr(self, "numbers", None) is not numbers:
            self.numbers, self.made = numbers, [Postings(texts, numbers) for texts in self.texts]
            pa.default_memory_pool().release_unused()  # what cutting texts took
        return self.made


class Asked:
    """The searches of a block, and the best ``k`` items of each so far: higher scores first, the lower item
    id among equals. ``know`` names the last of k items found beforehand. Searches of the same plain words
    without a vector are one."""

    def __init__(self, ids, haves, units, termss, k: int):
        numbers: dict[str, int] = {}
        haves = np.asarray(haves, dtype=bool)
        units = np.asarray(units, dtype="float64").reshape(int(haves.sum()), -1) if haves.any() else np.zeros((0, 0))
        place, self.others, self.own, known = np.cumsum(haves) - 1, {}, [], {}
        words, rows = [], []
        for n, (terms, have) in enumerate(zip(termss, haves.tolist())):
            search = Search(json.loads(terms), numbers)
            key = n if have or not search.plain else tuple(sorted(search.words))
            if key not in known:
                known[key] = len(words)
                if not search.plain:
                    self.others[len(words)] = search
                words.append(search.words if search.plain else [])
                rows.append(place[n] if have else -1)
            self.own.append(known[key])
        self.ids, self.own, self.k, self.numbers = np.asarray(ids), np.array(self.own, dtype=np.int64), k, numbers
        rows = np.array(rows, dtype=np.int64)
        self.units, self.have = units[rows[rows >= 0]], rows >= 0
        self.row = np.cumsum(self.have) - 1  # of the vector, if there is one
        self.plain = np.ones(len(words), dtype=bool)
        self.plain[list(self.others)] = False
        self.worded, self.close = np.array([len(w) > 0 for w in words], dtype=bool), np.array([len(w) > 1 for w in words], dtype=bool)
        self.sizes = np.array([max(1, len(w)) for w in words], dtype=np.int64)
        self.words = np.array([x for w in words for x in w or [len(numbers)]], dtype=np.int64)  # a word that no item holds for none
        self.starts, self.ordered = np.cumsum(self.sizes) - self.sizes, False
        self.cap = TEXT_SHARE * np.where(self.close, 1.0, np.where(self.worded, WORD_WEIGHT * (1 + SLACK), 0.0))
        self.cap[~self.plain] = TEXT_SHARE * (1 + SLACK)
        self.count, self.scores, self.best = np.zeros(len(words), dtype=np.int64), None, None
        self.last, self.last_id = np.full(len(words), -np.inf), None

    def know(self, floors: dict) -> None:
        """Of searches, by id: score and item id of the last of ``k`` items that are somewhere."""
        for n, query in zip(self.own.tolist(), self.ids.tolist()):
            if query in floors:
                self.last[n], item_id = floors[query]
                if self.last_id is None:
                    self.last_id = np.zeros(len(self.last), dtype=np.array(item_id).dtype if isinstance(item_id, int) else object)
                self.last_id[n] = item_id

    def _ready(self, ids: np.ndarray) -> None:
        if self.best is None:
            self.best, self.scores = np.zeros((len(self.sizes), self.k), dtype=ids.dtype), np.full((len(self.sizes), self.k), -np.inf)
        if self.last_id is None:
            self.last_id = np.zeros(len(self.sizes), dtype=ids.dtype)

    def beaten(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether no item of at most this score, and of the same score from this id on, is among the best."""
        last = self.last[search]
        out, equal = score < last, np.flatnonzero(score == last)
        out[equal] = ids[equal] > self.last_id[search[equal]]
        return out

    def add(self, search: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = np.flatnonzero(~self.beaten(search, score, ids))
        if not len(better):
            return
        search, score, ids = search[better], score[better], ids[better]
        touched = distinct(search)
        owner, place = expanded(np.zeros(len(touched), dtype=np.int64), self.count[touched])
        search = np.concatenate([touched[owner], search])
        score, ids = np.concatenate([self.scores[touched[owner], place], score]), np.concatenate([self.best[touched[owner], place], ids])
        order = np.lexsort((ids, -score, search))
        search, score, ids = search[order], score[order], ids[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        kept = place < self.k
        search, place = search[kept], place[kept]
        self.scores[search, place], self.best[search, place] = score[kept], ids[kept]
        self.count[touched] = np.bincount(np.searchsorted(touched, search), minlength=len(touched))
        whole = touched[self.count[touched] == self.k]
        score, ids = self.scores[whole, -1], self.best[whole, -1]
        risen = np.flatnonzero((score > self.last[whole]) | ~self.beaten(whole, score, ids))
        self.last[whole[risen]], self.last_id[whole[risen]] = score[risen], ids[risen]

    def meet(self, block: Block) -> None:
        if block.items:
            self._ready(block.ids)
            for own in portions(np.where(self.have, block.held, 0) + COSINES // CHUNK, COSINES):
                Meeting(self, block, own).run()

    def found(self, searches: int = 1) -> Iterator[pd.DataFrame]:
        """(query_id, item_id, score) of what is kept, of so many searches at a time."""
        for a in range(0, len(self.ids), searches):
            own = self.own[a : a + searches]
            owner, place = expanded(np.zeros(len(own), dtype=np.int64), self.count[own])
            if len(owner):
                yield pd.DataFrame({"query_id": self.ids[a + owner], "item_id": self.best[own[owner], place], "score": self.scores[own[owner], place]})


class Meeting:
    """Some searches of ``asked``, one after the other, beside a block of items. Pairs are a search and an item."""

    def __init__(self, asked: Asked, block: Block, own: slice):
        self.asked, self.block, self.first = asked, block, own.start
        self.searches = np.arange(own.start, own.stop)
        self.last, self.cap = asked.last[own], asked.cap[own]
        rows = asked.row[own][asked.have[own]]
        self.have = asked.have[own] if block.held else np.zeros(len(self.searches), dtype=bool)
        self.cosines = VECTOR_SHARE * (asked.units[rows[0] : rows[-1] + 1] @ block.units.T) if self.have.any() else np.zeros((0, block.held))
        self.vector = np.cumsum(self.have) - 1

    def run(self) -> None:
        asked, block = self.asked, self.block
        by_vector = np.zeros(len(self.searches), dtype=bool)
        by_vector[self.have] = ~(self.cosines.max(axis=1, initial=0.0) + COSINE_SLACK + self.cap[self.have] < self.last[self.have])
        by_words = asked.worded[self.searches] & ~asked.beaten(self.searches, self.cap, np.full(len(self.searches), block.least))
        for n in [n for n in asked.others if self.first <= n < self.first + len(self.searches)]:
            self.add_any(n)
        by_vector &= asked.plain[self.searches]
        found = [self.nearest(np.flatnonzero(by_vector))] if by_vector.any() else []
        if by_words.any():
            found += [self.holders(cells, np.flatnonzero(by_words)) for cells in self.cells]
        if found:
            pairs = distinct(np.concatenate(found))
            for own in portions(np.ones(len(pairs), dtype=np.int64), PAIRS):
                self.rank(self.searches[pairs[own] // block.items], pairs[own] % block.items)

    @cached_property
    def postings(self) -> list[Postings]:
        return self.block.postings(self.asked.numbers)

    @cached_property
    def cells(self) -> list[Cells]:
        cells, asked = [p.cells for p in self.postings], self.asked
        if not asked.ordered:  # words of a search from its rarest on, as the first block has them
            owner = np.repeat(np.arange(len(asked.sizes)), asked.sizes)
            asked.words, asked.ordered = asked.words[np.lexsort((np.diff(cells[0].first)[asked.words], owner))], True
        return cells

    def base(self, search: np.ndarray, item: np.ndarray) -> np.ndarray:
        """What the vectors give."""
        out, own = np.zeros(len(search)), search - self.first
        both = np.flatnonzero(self.have[own] & (item < self.block.held))
        out[both] = self.cosines[self.vector[own[both]], item[both]]
        return out

    def hopeful(self, search: np.ndarray, item: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The pairs that could be among the best if words gave at most ``most``."""
        base = self.base(search, item)
        return np.flatnonzero(~self.asked.beaten(search, base + COSINE_SLACK * (base != 0) + most, self.block.ids[item]))

    def holders(self, cells: Cells, own: np.ndarray) -> np.ndarray:
        """Keys of the pairs whose item holds all words of the search, from the rarest word on."""
        asked, items = self.asked, self.block.items
        searches = self.searches[own]
        owner, place = expanded(asked.starts[searches], asked.sizes[searches])
        held = np.diff(cells.first)[asked.words[place]]
        heads = np.cumsum(asked.sizes[searches]) - asked.sizes[searches]
        least = np.minimum.reduceat((held << 32) | np.arange(len(held)), heads)
        rarest, sizes = asked.words[place[least & 0xFFFFFFFF]], least >> 32
        some = np.flatnonzero(sizes)
        searches, rarest, sizes, out = searches[some], rarest[some], sizes[some], [np.zeros(0, dtype=np.int64)]
        for part in portions(sizes, PAIRS):
            owner, cell = expanded(cells.first[rarest[part]], sizes[part])
            search, item = searches[part][owner], cells.item[cell]
            most, size = asked.cap[search], asked.sizes[search]
            one, two = np.flatnonzero(size == 1), np.flatnonzero(size == 2)
            most[one] = TEXT_SHARE * single_ranks(cells.n[cell[one]]) * (1 + SLACK)
            first = asked.starts[search[two]]  # of two words either has the most that the other could add
            other = asked.words[first] + asked.words[first + 1] - rarest[part][owner[two]]
            sum_of = np.minimum(cells.n[cell[two]] * cells.most_dense[other], cells.dense[cell[two]] * cells.most_n[other])
            most[two] = TEXT_SHARE * np.minimum(1.0, -np.expm1(-sum_of) * (1 + SLACK))
            kept = self.hopeful(search, item, most)
            search, item = search[kept], item[kept]
            for n in range(int(asked.sizes[search].max(initial=0))):
                more = np.flatnonzero(asked.sizes[search] > n)
                if not len(more):
                    break
                gone = more[cells.at(asked.words[asked.starts[search[more]] + n], item[more]) < 0]
                if len(gone):
                    search, item = np.delete(search, gone), np.delete(item, gone)
            out.append((search - self.first) * items + item)
        return np.concatenate(out)

    def nearest(self, own: np.ndarray) -> np.ndarray:
        """Keys of the pairs that both have a vector and could be among the best: all whose cosine leaves
        room, or those of these that hold words, one that is not the most frequent, if there are fewer."""
        asked, items, held = self.asked, self.block.items, self.block.held
        cosines, last, cap = self.cosines[self.vector[own]] + COSINE_SLACK, self.last[own, None], self.cap[own, None]
        open_pairs = ~(cosines + cap < last)
        some = np.flatnonzero(asked.worded[self.searches[own]] & (open_pairs.sum(axis=1) > FIRST_RANKED))
        out = []
        if len(some):
            searches = self.searches[own[some]]
            owner, place = expanded(asked.starts[searches], asked.sizes[searches])
            heads, word = np.cumsum(asked.sizes[searches]) - asked.sizes[searches], asked.words[place]
            sizes = []
            for cells in self.cells:
                size = np.searchsorted(cells.key, word * items + held) - cells.first[word]
                top = np.maximum.reduceat((size << 32) | np.arange(len(size)), heads) & 0xFFFFFFFF
                size[top[asked.close[searches]]] = 0
                sizes.append(size)
            fewer = np.add.reduceat(sizes[0] + sizes[1], heads) < open_pairs[some].sum(axis=1)
            for cells, size in zip(self.cells, sizes):
                size = np.where(fewer[owner], size, 0)
                for part in portions(size, PAIRS):
                    pair, cell = expanded(cells.first[word[part]], size[part])
                    at, item = some[owner[part][pair]], cells.item[cell]
                    room = open_pairs[at, item]
                    out.append(distinct(own[at[room]] * items + item[room]))
            open_pairs[some[fewer]] = ~(cosines[some[fewer]] < last[some[fewer]])
        at, item = np.nonzero(open_pairs)
        return np.concatenate([*out, own[at] * items + item])

    def most(self, cells: Cells, search: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, occurrences): no less than the rank by nearness, or the rank by occurrences of one word.
        An occurrence has one other at each distance and side at most; one of a pair is not of the item's
        most frequent word; and an occurrence gets no more from another word than that could add to any."""
        asked = self.asked
        total, most, dense = np.zeros(len(search), dtype=np.int64), np.zeros(len(search), dtype=np.int64), np.zeros(len(search))
        for n in range(int(asked.sizes[search].max(initial=0))):
            more = np.flatnonzero(asked.sizes[search] > n)
            cell = cells.at(asked.words[asked.starts[search[more]] + n], item[more])
            more, cell = more[cell >= 0], cell[cell >= 0]
            dense[more] += total[more] * cells.dense[cell]
            total[more] += cells.n[cell]
            most[more] = np.maximum(most[more], cells.n[cell])
        sum_of = np.minimum(ONE_SIDE * np.minimum(total, 2 * (total - most)), dense)
        return np.where(asked.close[search], np.minimum(1.0, -np.expm1(-sum_of) * (1 + SLACK)), single_ranks(total)), total

    def rank(self, search: np.ndarray, item: np.ndarray) -> None:
        """Adds the pairs, of one search the most promising first, until no other could be among the best."""
        asked, ids = self.asked, self.block.ids
        kept = self.hopeful(search, item, asked.cap[search])
        search, item = search[kept], item[kept]
        worded = np.flatnonzero(asked.worded[search])
        ranks, occurrences = np.zeros((2, len(search))), np.zeros(len(search), dtype=np.int64)
        for n, cells in enumerate(self.cells if len(worded) else []):
            ranks[n, worded], total = self.most(cells, search[worded], item[worded])
            occurrences[worded] += total
        base, rank = self.base(search, item), ranks.max(axis=0)
        known = ~asked.close[search] | (rank == 0)
        asked.add(search[known], (base + TEXT_SHARE * rank)[known], ids[item[known]])
        rest = np.flatnonzero(~known)
        rest = rest[self.hopeful(search[rest], item[rest], TEXT_SHARE * rank[rest])]
        rest = rest[np.lexsort((ids[item[rest]], -(base + TEXT_SHARE * rank)[rest], search[rest]))]
        turn = np.frexp((np.arange(len(rest)) - np.searchsorted(search[rest], search[rest])) // FIRST_RANKED + 1)[1]
        for now in range(1, int(turn.max(initial=0)) + 1):
            left = np.flatnonzero(turn >= now)
            left = left[self.hopeful(search[rest[left]], item[rest[left]], TEXT_SHARE * rank[rest[left]])]
            rest, turn = rest[left], turn[left]
            some = rest[turn == now]
            for part in portions(occurrences[some], OCCURRENCES):
                own = some[part]
                need = np.log(np.maximum(1 - (asked.last[search[own]] - COSINE_SLACK - base[own]) / TEXT_SHARE, 0.0) + UNSEEN)
                exact = np.zeros(len(own))
                for postings, most in zip(self.postings, ranks):
                    able = self.hopeful(search[own], item[own], TEXT_SHARE * most[own])
                    exact[able] = np.maximum(exact[able], pair_ranks(postings, asked, search[own[able]], item[own[able]], need[able]))
                asked.add(search[own], base[own] + TEXT_SHARE * exact, ids[item[own]])

    def add_any(self, n: int) -> None:
        """All items, with alternatives, phrases and excluded words."""
        asked, block, every = self.asked, self.block, np.arange(self.block.items)
        base = self.base(np.full(block.items, n), every)
        if base.max(initial=0.0) + COSINE_SLACK + asked.cap[n] < asked.last[n]:
            return
        (long, in_long), (short, in_short) = (asked.others[n].ranks(p) for p in self.postings)
        allowed = np.flatnonzero((self.have[n - self.first] & (every < block.held)) | in_long | in_short)
        asked.add(np.full(len(allowed), n), (base + TEXT_SHARE * np.maximum(long, short))[allowed], block.ids[allowed])


def pair_ranks(postings: Postings, asked: Asked, search: np.ndarray, item: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Rank by nearness of every pair of search and item; 0 for pairs that cannot leave open as little as ``need``."""
    cells = postings.cells
    pair, place = expanded(asked.starts[search], asked.sizes[search])
    word = asked.words[place]
    cell = cells.at(word, item[pair])
    held = np.flatnonzero(cell >= 0)
    pair, word, cell = pair[held], word[held], cell[held]
    owner, at = expanded(cells.start[cell], cells.n[cell])
    pair, word, position = pair[owner], word[owner], postings.position[at]
    place_bits, word_bits = int(position.max(initial=0)).bit_length(), len(asked.numbers).bit_length()
    if len(search).bit_length() + place_bits + word_bits < 64:
        key = np.sort((((pair << place_bits) | position) << word_bits) | word)
        pair, position, word = key >> (place_bits + word_bits), (key >> word_bits) & ((1 << place_bits) - 1), key & ((1 << word_bits) - 1)
    else:
        order = np.lexsort((position, pair))
        pair, position, word = pair[order], position[order], word[order]
    return nearness(pair.astype(np.int32), position.astype(np.int32), word.astype(np.int32), len(search), need)


def best_items(k: int):
    """(query_id, item_id, score): of every search the best ``k`` among the blocks of one task, which come
    beside blocks of searches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[tuple, Asked] = {}
        for part in parts:
            for row in part.itertuples(index=False):
                key = (tuple(row.query_ids), tuple(row.termss))
                if key not in parsed:
                    if len(parsed) == KEPT_BLOCKS:
                        for asked in parsed.values():
                            yield from asked.found()
                        parsed.clear()
                    parsed[key] = Asked(row.query_ids, row.query_haves, row.query_units, row.termss, k)
                parsed[key].meet(Block(row.item_ids, row.haves, row.units, row.longs, row.shorts))
        pa.default_memory_pool().release_unused()  # the worker stays
        for asked in parsed.values():
            yield from asked.found()

    return run


def best_rows(asked: Asked, size: int):
    """(query_id, item_id, score): of every search in ``asked`` the best among the items (item_id, have,
    unit, long, short) of one task, ``size`` items at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), size):
                own = part.iloc[a : a + size]
                units = [np.asarray(v, dtype="float64") for v, have in zip(own["unit"], own["have"]) if have]
                asked.meet(Block(own["item_id"], own["have"], np.concatenate(units) if units else np.zeros(0), own["long"].tolist(), own["short"].tolist()))
        pa.default_memory_pool().release_unused()  # the worker stays
        yield from asked.found(CHUNK)

    return run
