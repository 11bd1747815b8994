"""Clusters by bit planes and codes by bounds against plain integer loops and SQL."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tests.harness import DATA, connect, rows_of
from tests.llm import brute
from tidings.llm import bitplanes, codes, integers, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(dims=64, n=300, seed=3):
    """(vec_id, vector, label): clustered, copied, repeated, and those that are left out."""
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(9, dims))
    rows = [(i * 2 - 40, (centers[i % 9] * 0.2 + draw.normal(size=dims) * 0.05).astype("float32").tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(1001 + i, rows[4][1], 1) for i in range(60)] + [rows[5], rows[5], (None, rows[6][1], 2), (None, rows[8][1], None)]
    odd = [(2000, None, 1), (2001, [math.nan] * dims, 1), (2002, [*rows[0][1][:-1], math.inf], 1), (2003, [None, *rows[0][1][1:]], 1), (2004, [], 1), (2005, [0.25] * 3, 9), (2006, [0.0] * dims, 1)]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as cluster", "'v' as v", "'n' as near", "'s' as sums", "'p' as planes").repartition(3)


def test_planes_give_exact_products_and_sums():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1 << 20, (50, 64)), draw.integers(0, 1 << 20, (7, 64))
    left, right = bitplanes.planes_of(a, 20), bitplanes.planes_of(b, 20)
    assert (bitplanes.dot_products(left, right) == a @ b.T).all()
    cluster = draw.integers(0, 5, 50)
    sums = bitplanes.component_sums(left, cluster, 6)
    assert all((sums[c, :64] == a[cluster == c].sum(axis=0)).all() and sums[c, 64] == (cluster == c).sum() for c in range(6))


def test_clusters_are_those_of_the_plain_loop(spark):
    rows = vectors()
    found = bitplanes.clustered(frame(spark, rows), 12, 3)
    want, centroids = brute.integer_clusters([(i, v) for i, v, _ in rows], 12, 3, "2:")
    assert sorted(map(tuple, found.assigned.collect()), key=repr) == sorted(want, key=repr)
    assert found.centroids == centroids


def test_clusters_with_less_than_asked_and_wide_values(spark):
    rows = [(1, [1e30] + [0.0] * 63, 1), (2, [-1e30] + [0.0] * 63, 1), (3, [5.0] * 64, 1)]
    found = bitplanes.clustered(frame(spark, rows))
    want, _ = brute.integer_clusters([(i, v) for i, v, _ in rows], 40, 5, "2:")
    assert sorted(map(tuple, found.assigned.collect())) == sorted(want)
    assert bitplanes.clustered(frame(spark, [(1, None, 1), (2, [1.0], 2)])) is None


@pytest.mark.parametrize("dims, parts, entries, rounds", [(64, 16, 64, 2), (64, 16, 16, 4), (12, 3, 40, 3), (6, 6, 1, 1)])
def test_codes_are_those_of_the_plain_loop(spark, dims, parts, entries, rounds):
    rows = vectors(dims)
    found = codes.coded(frame(spark, rows), parts, entries, rounds)
    want, books = brute.part_codes(rows, parts, entries, rounds)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted(want, key=repr)
    assert found.codebooks.tolist() == books
    assert all(sum(s) == found.settled[0][2] for s in found.settled)


def test_bounds_settle_parts_once_entries_stand(spark):
    rows = [(i, [float(i % 8)] * 16, 1) for i in range(400)]
    settled = codes.coded(frame(spark, rows), 16, 8, 3).settled
    assert settled[-1] == (400 * 16, 0, 0)


def test_kept_entries_shrink_within_their_range():
    needs = np.zeros(18, dtype=np.int64)
    needs[1] = 1000
    assert codes.next_kept(needs, 16, 64) == 8
    needs[12] = 100
    assert codes.next_kept(needs, 16, 64) == 12
    needs[17] = 100
    assert codes.next_kept(needs, 16, 64) == 16


def test_nothing_to_code(spark):
    assert codes.coded(frame(spark, [(1, None, 1), (2, [1.0], 2)])) is None
    with pytest.raises(ValueError):
        codes.coded(frame(spark, [(1, [1.0], 1)]), 1, 300)


@pytest.mark.parametrize("name", ["op12_popcount_clusters", "op13_bounded_codes"])
def test_queries_are_those_of_the_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    frame_ = queries.QUERIES[name](spark, folder)
    cursor = connect(folder).execute(queries.ORACLES[name])
    assert rows_of(frame_.columns, map(tuple, frame_.collect())) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("rows", [[], vectors()])
def test_digests(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {tuple(r) for r in bitplanes.op12_popcount_clusters(spark, str(tmp_path)).collect()}
    want, centroids = brute.integer_clusters([(i, v) for i, v, _ in rows], 40, 5, "2:")
    total = lambda c: sum(d for _, k, d in want if c in (k, None))
    digest = lambda numbers: hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    assert found == {(i, c, d, total(c), total(None), digest(centroids[c])) for i, c, d in want}
    coded = [tuple(r) for r in codes.op13_bounded_codes(spark, str(tmp_path)).collect()]
    want, books = brute.part_codes(rows, 16, 64, 2)
    label_error = lambda label: (lambda e: sum(e) if e else None)([e for _, of, _, e in want if of == label and e is not None])
    book = digest(n for part in books for entry in part for n in entry)
    assert sorted(coded, key=repr) == sorted(((i, c, e, label_error(of), book) for i, of, c, e in want), key=repr)


def test_integers_round_down(spark):
    rows = [(1, [-0.001, 0.0, 0.999 / 256, 1 / 256, -1 / 256, 1e38, -1e38], 1)]
    assert integers.integer_rows(frame(spark, rows)).first()["v"] == [-1, 0, 0, 1, -1, integers.LIMIT, -integers.LIMIT]
