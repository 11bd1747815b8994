"""Vectors against all pairs; the licence scan against SQL and by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.harness import DATA, connect, rows_of
from tests.llm import brute
from tests.llm.conftest import frame_of
from tidings.llm import graph, licences, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def spread_of(draw, center, cosine):
    """A vector at about the given cosine to ``center``."""
    side = draw.normal(size=len(center))
    side -= side @ center / (center @ center) * center
    side *= np.linalg.norm(center) / np.linalg.norm(side)
    return cosine * center + math.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("dims", [64, 5, 1, 20])
def test_vector_links(spark, dims):
    draw = np.random.default_rng(dims)
    rows, centers = [], [draw.normal(size=dims) for _ in range(12)]
    for i in range(160):
        center = centers[i % 12] * draw.uniform(0.01, 100)
        rows.append((i, (spread_of(draw, center, draw.choice([0.999, 0.99, 0.982, 0.978, 0.9])) if dims > 1 else center).astype("float32").tolist(), int(i % 3)))
    copies = [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 3)] + [(300 + i, rows[0][1], rows[0][2]) for i in range(20)]
    odd = [(400, None, 1), (401, [0.0] * dims, 1), (402, [math.nan] * dims, 1), (403, [math.inf] * dims, 1), (404, [None] * dims, 1), (405, rows[1][1], None), (406, [], 1), (407, [*rows[1][1], 1.0], 1), (408, rows[1][1], 2)]
    all_rows = rows + copies + odd
    frame = spark.createDataFrame(all_rows, SCHEMA).selectExpr("*", "'x' as id", "'y' as block", "'z' as cell")
    found = {tuple(r) for r in vectors.linked(frame).collect()}
    want = brute.vector_rows(all_rows)
    assert found == want
    assert dims == 1 or sum(n > 0 for _, n, _, _ in want) > 40


def test_vector_rows_without_id_and_repeats(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    found = sorted((tuple(r) for r in vectors.linked(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert found == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)], key=repr)


def test_no_vectors(spark):
    assert vectors.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (3000, 3000)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.roots({x for e in edges for x in e if e[0] != e[1]}, edges[:-2])
    assert {frozenset(n for n in found if found[n] == r) for r in found.values()} == {frozenset(n for n in want if want[n] == r) for r in want.values()}


def test_licence_scan_is_that_of_the_sql(spark):
    folder = f"{DATA}/sf0.001"
    sql = connect(folder)
    frame = queries.QUERIES["op3_licence_scan"](spark, folder)
    cursor = sql.execute(queries.ORACLES["op3_licence_scan"])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    filler = "plain words about nothing in particular " * 30
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/file", filler),
        (3, "a/b/COPYING", "Notice:\n" + gpl),
        (4, "a/file", filler),
        (5, "a/b/own", filler + "\nLicensed under CC BY 4.0.\n"),
        (6, "z/file", filler),
        (7, "ab/file", filler),
        (8, "a/empty", ""),
        (9, "a/none", None),
        (10, None, gpl),
        (11, "a/b/shout", gpl.upper()),
        (12, "file", filler),
    ]
    found = {r["file"]: (r["licence"], r["origin"], r["from_path"]) for r in licences.scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert found[1] == ("MIT", "notice", "a/LICENSE") and found[3][:2] == ("GPL-3.0", "notice")
    assert found[2] == ("GPL-3.0", "inherited", "a/b/COPYING")
    assert found[4] == found[8] == found[9] == ("MIT", "inherited", "a/LICENSE")
    assert found[5][:2] == ("CC-BY-4.0", "notice")
    assert found[6] == found[7] == found[12] == (None, "none", None)
    assert found[10][:2] == ("GPL-3.0", "notice") and found[11][:2] == ("GPL-3.0", "notice")


def test_licences_of_odd_documents(spark, rows, empty):
    frame = frame_of(spark, [*rows, rows[0], (None, rows[0][1])], clashing=True)
    assert licences.scan(licences.tree_of(frame)).count() >= len(rows) + 2
    assert licences.scan(licences.tree_of(empty)).count() == 0
