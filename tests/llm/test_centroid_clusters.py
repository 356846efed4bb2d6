"""Delta Lloyd against a plain version that compares everything in every round."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censa.llm import centroid_clusters as cc

NAN, INF = float("nan"), float("inf")


def rows_of(dim, n, seed):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((5, dim))
    rows = [(k, (centers[k % 5] + 0.3 * r.standard_normal(dim)).tolist()) for k in range(n)]
    rows += [(1000 + k, centers[0].tolist()) for k in range(30)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1])]
    return rows + [(2000, None), (2001, []), (2002, [1.0] * (dim + 1)), (2003, [NAN] * dim), (2004, [INF] + [0.0] * (dim - 1)), (2005, [None] + [0.0] * (dim - 1)), (2006, [0.0] * dim), (2007, [-1e30] + [1e30] * (dim - 1))]


def plain(rows, clusters, rounds, dim):
    kept = [(i, [max(min(math.floor(v * 256), cc.REACH), -cc.REACH) for v in e]) for i, e in rows if e is not None and len(e) == dim and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    c = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, o, strict=True)), k) for k, o in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for k in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == k]
            if mine:
                c[k] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = [near(x) for _, x in kept]
    per = Counter()
    for d, k in last:
        per[k] += d
    fits = lambda n: n if n < 2**63 else None
    return Counter((i, k, d, fits(per[k]), fits(sum(per.values())), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, last, strict=True))


@pytest.mark.parametrize("dim,clusters,rounds", [(4, 7, 5), (8, 3, 2), (3, 500, 3), (4, 7, 0)])
def test_against_plain(spark, dim, clusters, rounds):
    rows = rows_of(dim, 90, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).select("*", *(F.lit("odd").alias(c) for c in ("x", "cluster", "before", "distance", "label")))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    out = cc.centroid_clusters(df, clusters, rounds, dim)
    assert out.columns == names
    assert Counter(tuple(r) for r in out.collect()) == plain(rows, clusters, rounds, dim)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>")
    (one,) = cc.centroid_clusters(df).collect()
    assert (one.vec_id, one.cluster, one.distance, one.inertia) == (1, 0, 0, 0)
    assert cc.centroid_clusters(df.limit(0)).count() == 0
    (lone,) = cc.centroid_clusters(df.withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert tuple(lone) == (None,) * 6


@given(st.integers(0, 10**6), st.integers(1, 9), st.sampled_from([3, 40, 1 << 23]))
@settings(max_examples=150, deadline=None)
def test_only_what_changed_is_compared(seed, k, reach):
    r = np.random.default_rng(seed)
    x, c = r.integers(-reach, reach, (60, 3)), r.integers(-reach, reach, (k, 3))
    full = lambda c: min_of(((x[:, None] - c[None]) ** 2).sum(2))
    owner, distance = full(c)
    after = c.copy()
    changed = np.flatnonzero(r.random(k) < 0.4)
    after[changed] += r.integers(-2, 3, (len(changed), 3))
    found = cc.reassigned(x, owner, distance, after, changed)
    assert all((a == b).all() for a, b in zip(found, full(after), strict=True))
    assert (cc.squared(x, c) == ((x[:, None] - c[None]) ** 2).sum(2)).all()


def min_of(d):
    k = d.argmin(1)
    return k, d[np.arange(len(d)), k]
