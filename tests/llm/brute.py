"""Brute-force versions of the operators, straight from their rules, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text: str) -> int:
    words = SPACE.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def simhash_rows(documents):
    """{(doc_id, fingerprint, component_id)} of rows (doc_id, text) with distinct ids."""
    prints = {d: simhash(t) for d, t in documents}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    component = roots(ids, links)
    return {(d, f"{prints[d]:016x}", component[d]) for d in ids}


def contamination_rows(documents, benchmark, window=13):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = LETTERS.findall(lower(text))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[a : a + window])].add("" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for d, text in documents:
        w, hit, items = LETTERS.findall(lower(text)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    items |= windows[tuple(w[a : a + n])]
        out.append((d, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def _id(d):
    return math.inf if d is None else d


def word_repeats(documents, n=50):
    """Kept words of each row: windows that start in a document with a smaller id lose theirs."""
    first = {}
    cut = [SPACE.findall(t or "") for _, t in documents]
    for (d, _), w in zip(documents, cut):
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            first[key] = min(first.get(key, math.inf), _id(d))
    out = []
    for (d, _), w in zip(documents, cut):
        gone = {i for a in range(len(w) - n + 1) if first[tuple(w[a : a + n])] < _id(d) for i in range(a, a + n)}
        out.append((d, len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def word_repeat_rows(documents, n=50):
    return [(d, words, gone, sha(" ".join(kept))) for d, words, gone, kept in word_repeats(documents, n)]


def byte_repeat_rows(documents, n=100):
    """Rows (doc_id, text) with distinct ids."""
    first, out = {}, []
    for d, t in sorted(documents, key=lambda x: x[0]):
        raw, gone = (t or "").encode(), set()
        for a in range(len(raw) - n + 1):
            if raw[a : a + n] in first:
                gone |= set(range(a, a + n))
            else:
                first[raw[a : a + n]] = d
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(raw), len(gone), spans, sha(bytes(b for i, b in enumerate(raw) if i not in gone))))
    return out


def base_scores(documents, folds=7, held=2):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}"""
    out_of = {d: zlib.crc32(str(d).encode()) % folds == held for d, _ in documents}
    tokens = {d: [*SPACE.findall(lower(t)), None] for d, t in documents}
    counts = Counter(x for d, own in tokens.items() if not out_of[d] for x in own)
    total, space = sum(counts.values()), sum(counts.values()) + len(counts) + 1
    return {d: (out_of[d], len(own), sum(counts[x] > 0 for x in own), total, sum(math.log10((counts[x] + 1) / space) for x in own)) for d, own in tokens.items()}


def vector_rows(vectors, cosine=0.98):
    """Rows (vec_id, vector, label) with distinct ids."""
    good = {}
    for v, x, label in vectors:
        a = None if x is None or any(e is None for e in x) else np.array(x, dtype=np.float64)
        if a is not None and len(a) and label is not None and np.isfinite(a).all() and (a != 0).any():
            good[v] = (a, label)
    ids = sorted(good)
    links = []
    for i, p in enumerate(ids):
        for q in ids[i + 1 :]:
            (a, la), (b, lb) = good[p], good[q]
            if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links.append((p, q))
    component = roots([v for v, _, _ in vectors], links)
    n = Counter(x for link in links for x in link)
    return {(v, n[v], component[v], component[v] == v) for v, _, _ in vectors}


def floors(vector):
    """The vector in 256ths, or None if it is null or holds a null or a non-finite component."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [max(-(1 << 24), min(1 << 24, math.floor(float(np.float32(x)) * 256))) for x in vector]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def integer_clusters(rows, clusters, rounds, salt):
    """([(vec_id, cluster, distance)], centroids) of rows (vec_id, vector)."""
    kept = [(i, v) for i, v in ((i, floors(v)) for i, v in rows) if v is not None and len(v) == 64]
    named = sorted(kept, key=lambda r: (r[0] is None, sha(f"{salt}{r[0]}"), r[1]))
    centroids = [v for _, v in named[:clusters]]

    def nearest(v):
        return min((apart(v, c), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for n, own in members.items():
            centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def part_codes(rows, parts, entries, rounds):
    """([(vec_id, label, code, error)], codebooks) of rows (vec_id, vector, label)."""
    kept = sorted(((i, floors(v), label) for i, v, label in rows if floors(v) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    dims = len(fit[0][1]) if fit else 0
    fit, width = [r for r in fit if len(r[1]) == dims], dims // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in fit]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, p):
        return min((apart(part, e), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[p], p)[1]].append(c[p])
            books[p] = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else e for n, e in enumerate(books[p])]
    out = []
    for (i, _, label), c in zip(fit, cut):
        found = [nearest(part, p) for p, part in enumerate(c)]
        out.append((i, label, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out + [(i, label, None, None) for i, v, label in kept if len(v) != dims], books


def five_words(text):
    """Sets of five words, lower case; fewer words are one shingle, none is the empty set."""
    own = SPACE.findall(lower(text))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def near_kept(rows):
    """The smallest doc_id of every group that links of similarity 4/5 or more, or equal sets, make."""
    sets = {d: five_words(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(roots(ids, links).values()))
