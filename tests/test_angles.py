"""The pruned similarity join against all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censa.operators import angles, pairs, pools


def clustered(seed, n, clusters, size, spread):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((clusters, size))
    x = centers[r.integers(0, clusters, n)] + spread * r.standard_normal((n, size))
    x[1] = x[0]
    return x


def table(spark, x, extra=()):
    rows = [(k - 5, f"g{k % 7}" if k % 11 else None, v.tolist()) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "spot_id long, photo string, embedding array<double>").repartition(4)


def all_pairs(x, cutoff, group=True):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    g = [f"g{k % 7}" if k % 11 else None for k in range(len(x))]
    a, b = np.nonzero(np.triu(s >= cutoff, 1))
    return {(i - 5, j - 5) for i, j in zip(a.tolist(), b.tolist(), strict=True) if not group or g[i] != g[j]}


ODD = [(10_000, "g1", None), (10_001, "g1", [0.0] * 8), (10_002, "g2", [1.0, 2.0]), (10_003, "g1", [1.0, 2.0]), (None, "g1", [1.0] * 8)]


@pytest.mark.parametrize("cutoff", [0.35, 0.6, 0.8, 0.9, 0.95, 1 - 1e-9])
@pytest.mark.parametrize("block", [20, 5000])
def test_equal_to_all_pairs(spark, cutoff, block):
    x = clustered(1, 500, 20, 8, 0.25)
    found = angles.pairs_above(table(spark, x, ODD), cutoff, group="photo", block=block).collect()
    want = all_pairs(x, cutoff) | {(10_002, 10_003)}
    assert sorted((r.a, r.b) for r in found) == sorted(want)


def test_alike_vectors_are_cut_by_hash(spark):
    x = np.tile(np.arange(1.0, 9.0), (300, 1)) + 1e-4 * np.random.default_rng(2).standard_normal((300, 8))
    t = table(spark, x)
    assert angles.pairs_above(t, 0.9, block=25).count() == 300 * 299 // 2
    assert angles.pairs_above(t.limit(0), 0.9).count() == 0
    dealt = angles.parts(angles.cells(t.select(F.col("spot_id").alias("id"), F.lit("").alias("grp"), F.col("embedding").alias("e")), 0.9, 25), 25)
    assert dealt.groupBy("cell", "i", "j").count().agg(F.max("count")).first()[0] <= 3 * 25


def test_cells_hold_what_they_must(spark):
    x = clustered(3, 400, 12, 6, 0.3)
    state = angles.cells(table(spark, x).select(F.col("spot_id").alias("id"), "photo", F.col("photo").alias("grp"), F.col("embedding").alias("e")), 0.9, 30).collect()
    home = {r.id: r.cell for r in state if r.home}
    assert len(home) == 400 == sum(r.home for r in state) and len(set(home.values())) > 5
    there = {(r.id, r.cell) for r in state}
    assert len(there) == len(state)
    assert all(((a, home[b]) in there) != ((b, home[a]) in there) or home[a] == home[b] for a, b in all_pairs(x, 0.9, group=False))


def test_work_is_far_below_all_pairs(spark):
    n = 6000
    x = clustered(4, n, 60, 32, 0.2)
    cost = angles.work(table(spark, x), 0.9, block=200)
    assert cost["rows"] < 3 * n and cost["met"] < n * n / 20 and cost["full"] <= cost["met"]
    # Where pivots do not part the rows, bounds on the leading axes save the full products.
    noise = np.random.default_rng(5).standard_normal((2000, 64))
    cost = angles.work(table(spark, noise), 0.9, block=500)
    assert 2000 * 1999 // 2 <= cost["met"] <= 2000**2 and cost["full"] < cost["met"] / 20


@given(st.integers(0, 10**6), st.sampled_from([0.2, 0.5, 0.9, 0.99]), st.integers(2, 6), st.floats(0.05, 1.0))
@settings(max_examples=200, deadline=None)
def test_visits_and_bounds_lose_nothing(seed, cutoff, size, spread):
    x = clustered(seed, 60, 5, size, spread)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rho = math.acos(cutoff)
    chosen = angles.pivots_of(x, 8, rho / 4)
    a = angles.angles(x, x[chosen])
    s = x @ x.T
    for reach in (0.0, rho, 2 * rho, angles.best_reach(a, rho)[0], math.pi):
        own, visits = angles.own_cell(a, reach), angles.visited(a, reach, rho)
        for i, j in zip(*np.nonzero(s >= cutoff), strict=True):
            assert visits[i, own[j]] and visits[j, own[i]]
    left, right = angles.on_axes(x, x)
    i, j, sims, n = angles.reaching(left, right, cutoff)
    near = np.abs(s - cutoff) < 1e-9
    assert set(zip(i.tolist(), j.tolist(), strict=True)) ^ set(zip(*(v.tolist() for v in np.nonzero(s >= cutoff)), strict=True)) <= set(zip(*(v.tolist() for v in np.nonzero(near)), strict=True))
    assert n >= len(i) and np.allclose(sims, s[i, j])


def test_best_of_groups_looks_at_few_balls(spark):
    """Every vector a query, every group; the same rows as all pairs give, from a fraction of the comparisons."""
    x = clustered(6, 1200, 15, 16, 0.15)
    x[300:340] = x[300]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    group = np.array([f"g{k % 3}" if k % 10 else "lone" if k else "single" for k in range(len(x))])
    sides = spark.createDataFrame([(k, str(g), v.tolist()) for k, (g, v) in enumerate(zip(group, x, strict=True))] + [(9000, None, x[0].tolist()), (9001, "g1", None)], "id long, grp string, e array<double>").repartition(3)
    s = u @ u.T
    want = {}
    for g in np.unique(group):
        cols = np.flatnonzero(group == g)
        top = s[:, cols].max(1)
        first = (s[:, cols] >= top[:, None] - 1e-12).argmax(1)
        want |= {(q, g): (int(cols[first[q]]), top[q]) for q in range(len(x)) if group[q] != g}
    for block in (5000, 100):
        found = pairs.best_in_groups(sides, sides, block).collect()
        assert {(r.q, r.g_group): r.g for r in found} == {k: g for k, (g, _) in want.items()} and len(found) == len(want)
        assert all(abs(r.sim - want[r.q, r.g_group][1]) < 1e-9 for r in found)
        if block == 5000:
            large = [r.compared for r in found if r.g_group in ("g0", "g1", "g2")]
            assert max(r.compared for r in found if r.g_group == "single") == 1 and np.mean(large) < 0.4 * 360
        links = pairs.mutual_in_groups(sides, block).collect()
        mutual = {(q, g) for (q, gg), (g, _) in want.items() if group[q] < gg and want[g, group[q]][0] == q}
        assert sorted((r.q, r.g) for r in links) == sorted(mutual)


class Count:
    """A scorer of two numbers: the mean similarity of those spots of the pool that reach a cut."""

    merge, width = "sum", 2

    def part(self, similarities, starts):
        over = similarities >= 0.5
        return np.stack([np.add.reduceat(over.astype(float), starts, axis=1), np.add.reduceat(np.where(over, similarities, 0.0), starts, axis=1)], 2)

    def pool(self, numbers, offsets, sizes):
        mean = numbers[:, 1] / np.maximum(numbers[:, 0], 1)
        return np.add.reduceat(mean, offsets[:-1]) / np.diff(offsets)


@pytest.mark.parametrize("scorer,plain", [
    (pools.SoftChamfer(), lambda s: s.max(1).mean()),
    (pools.SoftDensity(0.2), lambda s: np.log(np.exp((s - 1) / 0.2).mean(1)).mean()),
    (Count(), lambda s: np.mean([r[r >= 0.5].mean() if (r >= 0.5).any() else 0.0 for r in s])),
])
@pytest.mark.parametrize("block", [5000, 13])
def test_scorers_over_pools(spark, scorer, plain, block):
    """Ragged pools, photos split over blocks, the query's own photo left out; a scorer of one's own works too."""
    x = clustered(9, 120, 6, 5, 0.4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    photo = [f"p{k % 7 if k % 3 else 0}" for k in range(len(x))]
    owner = {f"p{k}": k // 3 for k in range(7)}
    rows = [(k, p, owner[p], v.tolist()) for k, (p, v) in enumerate(zip(photo, x, strict=True))] + [(900, None, 1, x[0].tolist()), (901, "p1", None, x[0].tolist()), (902, "p1", 0, None)]
    out = {(r.photo, r.owner): (r.score, r["size"]) for r in pools.pooled(spark.createDataFrame(rows, "id long, grp string, owner long, e array<double>"), scorer, block).collect()}
    want = {}
    for p in owner:
        mine = [k for k, q in enumerate(photo) if q == p]
        for o in (0, 1, 2):
            pool = [k for k, q in enumerate(photo) if owner[q] == o and q != p]
            if mine and pool:
                want[p, o] = (pytest.approx(plain(u[mine] @ u[pool].T), abs=1e-9), len(pool))
    assert out == want and ("p6", 2) not in out


def test_pools_meet_in_few_blocks(spark, monkeypatch):
    """Rows are sent to few blocks, also of a large table, and a photo larger than its share of a block is cut."""
    sent, dealt = [], pools._dealt
    monkeypatch.setattr(pools, "_dealt", lambda *a: sent.append(a[-1]) or dealt(*a))
    x = clustered(3, 600, 6, 5, 0.4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    photo = np.array(["p0" if k % 4 else f"p{1 + k % 3}" for k in range(600)])
    owner = {"p0": "o", "p1": "o", "p2": "r", "p3": "r"}
    rows = [(k, p, owner[p], v.tolist()) for k, (p, v) in enumerate(zip(photo, x, strict=True))]
    found = {(r.photo, r.owner): (r.score, r["size"]) for r in pools.pooled(spark.createDataFrame(rows, "id long, grp string, owner string, e array<double>"), pools.SoftChamfer(), 5).collect()}
    assert sent == [15]
    of = np.array([owner[p] for p in photo])
    assert found == {(p, o): (pytest.approx((u[photo == p] @ u[(of == o) & (photo != p)].T).max(1).mean()), int(((of == o) & (photo != p)).sum())) for p in owner for o in "or"}


def test_rows_of_a_block_are_held_once():
    """800,000 rows of six columns: as arrays, and once more when joined, they would be 77 MB."""
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(2800, 4))
    side = lambda rows, group: pa.table({"id": pa.array(rows), "grp": pa.array(group), "e": pa.array(x[rows].tolist(), pa.list_(pa.float64()))})
    left, right = side(np.arange(2000), ["q"] * 2000), side(np.arange(2000, 2800), [f"g{k // 2}" for k in range(800)])
    tracemalloc.start()
    out = pairs._best_of_blocks(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 800_000 and peak < 50 << 20
