"""Vantage-point trees against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censa.llm import vantage_trees as vt

NAN, INF = float("nan"), float("inf")
R = np.random.default_rng(5)
CENTERS = R.standard_normal((12, 6))
ROWS = [(k, (CENTERS[k % 12] + 0.15 * R.standard_normal(6)).tolist()) for k in range(600)]
ROWS += [(1000 + k, CENTERS[0].tolist()) for k in range(60)] + [(100, ROWS[100][1]), (100, ROWS[101][1]), (None, ROWS[200][1]), (None, CENTERS[0].tolist())]
ROWS += [(2000, None), (2100, []), (2200, [NAN] * 6), (2300, [INF] + [1.0] * 5), (2400, [None] + [1.0] * 5), (2500, [0.0] * 6), (2600, [1e30] * 6), (2700, [1.0, 2.0]), (2701, [1.0, 3.0]), (2800, [7.0] * 9)]


def brute(rows, k):
    fine = [(n, i, e) for n, (i, e) in enumerate(rows) if e and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    out = defaultdict(list)
    for n, q, e in fine:
        if q is not None and q % 100 == 0:
            near = []
            for m, i, x in fine:
                if m != n and len(x) == len(e):
                    s = 0.0
                    for a, b in zip(e, x, strict=True):
                        s += (a - b) * (a - b)
                    near.append((math.sqrt(s), math.inf if i is None else i))
            out[q] += [(r + 1, i, d) for r, (d, i) in enumerate(sorted(near)[:k])]
    return {q: sorted(v) for q, v in out.items() if v}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r.rank, math.inf if r.vec_id is None else r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<double>").repartition(3)
    return df.select("*", *(F.lit("odd").alias(c) for c in ("h1", "shard", "rank", "score", "place", "dim", "near")))


ASKED = "vec_id % 100 = 0"


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "leaf_rows": 8}, {"shard_rows": 64, "sample_rows": 100, "chunk_values": 300, "leaf_rows": 4}])
def test_factor_one_is_exact(table, sizes):
    assert found(vt.nearest(table, ASKED, 5, 1.0, **sizes)) == brute(ROWS, 5)


def test_odd_tables(spark, table):
    assert vt.nearest(table.limit(0), ASKED).count() == 0
    assert vt.nearest(table.where("vec_id = 100 AND false"), ASKED).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert vt.nearest(one, ASKED).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (200, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(vt.nearest(few, ASKED)) == {0: [(1, 1, 0.0), (2, 200, 0.0)], 200: [(1, 0, 0.0), (2, 1, 0.0)]}


def test_copies_of_a_query_do_not_hide_others(spark):
    rows = [(k, [1.0, 1.0]) for k in range(0, 5000, 10)] + [(7, [1.0, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 10)
    assert found(vt.nearest(df, ASKED)) == want and len(want) == 50
    assert vt._first_copies(vt.usable(df), 11).count() == 12


def test_relaxed_search_compares_less_and_finds_most(spark):
    r = np.random.default_rng(3)
    centers = r.standard_normal((60, 16))
    x = centers[np.arange(6000) % 60] + 0.4 * r.standard_normal((6000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = {(q, i) for q in range(0, 6000, 100) for i in np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist()}
    compared, recall = [], []
    for factor in (1.0, 1.5, 2.5):
        args = (11, factor, 4000, 500, vt.CHUNK_VALUES, 32)
        _, visits = vt._looked_up(df, ASKED, *args)
        compared.append(visits.agg(F.sum("compared")).first()[0])
        got = {(a.query_id, a.vec_id) for a in vt.nearest(df, ASKED, 10, *args[1:]).collect()}
        recall.append(len(got & want) / len(want))
    assert recall[0] == 1 and min(recall) >= 0.9
    assert compared[2] < compared[1] < compared[0] < 0.6 * 60 * 6000


@given(st.integers(0, 10**6), st.integers(1, 120), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_tree_search_is_complete(seed, n, leaf):
    r = np.random.default_rng(seed)
    x = r.integers(-3, 4, (n, 2)).astype(float)  # many ties
    q = r.integers(-3, 4, (7, 2)).astype(float)
    best = vt.Best(q, 4, np.full(7, np.inf))
    tree = vt.Tree(x, leaf)
    vt.search(tree, x, np.arange(n), best, 1.0)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(n))
    leaf_of, _ = tree.route(x)
    assert all((leaf_of[rows] == k).all() for k, rows in enumerate(tree.leaves))
    for k in range(7):
        d = vt.distances(x, q[k])
        want = sorted(zip(d.tolist(), range(n), strict=True))[:4]
        assert list(zip(best.d[k][best.has[k]].tolist(), best.ids[k][best.has[k]].tolist(), strict=True)) == want
