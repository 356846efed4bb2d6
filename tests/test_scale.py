"""Operators that split hot groups give what a plain loop gives, on small blocks."""

from itertools import combinations, groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from censa.operators import aggregates as A
from censa.operators import angles
from censa.operators import joins as J
from censa.operators import metrics as M
from censa.operators import pairs as P
from censa.operators import quality as Q
from censa.operators import ranking as R
from censa.operators import sampling as N
from censa.sources import sinks


def vectors(seed=1, n=60, size=4):
    rng = np.random.default_rng(seed)
    # A third of all vectors are of one photo; rows 3 and 4 are equal.
    rows = [(int(i), "hot" if i % 3 == 0 else f"p{i % 7}", rng.normal(size=size)) for i in rng.permutation(n)]
    e = {i: x for i, _, x in rows}
    e[4] = e[3]
    return [(i, g, e[i] / np.linalg.norm(e[i])) for i, g, _ in rows]


def sides(spark, rows):
    return spark.createDataFrame([(i, g, x.tolist()) for i, g, x in rows], "id long, grp string, e array<double>")


def plain_best(rows):
    """(q, g_group): (g, sim), the least id of equals."""
    out = {}
    for q, qg, x in rows:
        for g, gg, y in sorted(rows, key=lambda r: r[0]):
            if qg != gg and ((q, gg) not in out or x @ y > out[q, gg][1] + 1e-12):
                out[q, gg] = (g, x @ y)
    return out


@pytest.mark.parametrize("block", [5, 1000])
def test_best_and_mutual_with_a_hot_group(spark, block):
    rows = vectors()
    best, group = plain_best(rows), {i: g for i, g, _ in rows}
    found = P.best_in_groups(sides(spark, rows), sides(spark, rows), block).collect()
    assert {(r.q, r.g_group): r.g for r in found} == {k: g for k, (g, _) in best.items()} and len(found) == len(best)
    mutual = {(q, g) for (q, gg), (g, _) in best.items() if group[q] < gg and best[g, group[q]][0] == q}
    links = P.mutual_in_groups(sides(spark, rows), block).collect()
    assert sorted((r.q, r.g) for r in links) == sorted(mutual)
    assert all(r.q_group == group[r.q] and r.g_group == group[r.g] for r in links)


def shuffled(node):
    """Rows that the exchanges of an executed plan wrote."""
    own = node.metrics().get("shuffleRecordsWritten")
    kind = node.getClass().getSimpleName()
    below = [node.plan()] if kind.endswith("QueryStageExec") else [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.children().apply(k) for k in range(node.children().size())]
    return (own.get().value() if own.isDefined() else 0) + sum(map(shuffled, below))


def test_mutual_links_of_large_groups_stay_in_tasks(spark):
    """Groups of some thousand rows meet whole: each row goes to few tasks, and only links leave them, of equals those of the least ids."""
    rng = np.random.default_rng(11)
    x = rng.integers(-2, 3, (12_600, 6)).astype(float)
    x[~x.any(1)] = 1
    x[::50] = x[0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    group = rng.permutation(12_600) % 6
    rows = spark.createDataFrame([(k, f"g{g}", v.tolist()) for k, (g, v) in enumerate(zip(group, x, strict=True))], "id long, grp string, e array<double>").repartition(3)
    links = P.mutual_in_groups(rows).select("q", "g", "q_group", "g_group")
    found = sorted(map(tuple, links.collect()))
    want = []
    for a, b in combinations(range(6), 2):
        i, j = np.flatnonzero(group == a), np.flatnonzero(group == b)
        s = u[i] @ u[j].T
        forth, back = (s >= s.max(1, keepdims=True) - 1e-12).argmax(1), (s >= s.max(0) - 1e-12).argmax(0)
        want += [(int(i[q]), int(j[g]), f"g{a}", f"g{b}") for q, g in enumerate(forth) if back[g] == q]
    assert found == sorted(want) and len(found) > 500
    assert 12_600 < shuffled(links._jdf.queryExecution().executedPlan()) < 8 * 12_600


def test_every_two_cells_are_on_one_line(spark):
    assert [P._prime(k) for k in (1, 2, 4, 5, 6, 8, 24, 26)] == [1, 2, 5, 5, 7, 11, 29, 29]
    for q in (2, 5, 7):
        cells = spark.range(q * q).select(P._lines(F.floor(F.col("id") / q), F.col("id") % q, q).alias("l")).collect()
        assert all(len(set(a.l) & set(b.l)) == 1 for a, b in combinations(cells, 2)) and {k for c in cells for k in c.l} == set(range(q * q + q))
        # Those of slope 0, where a cell meets itself, come first.
        assert all(c.l[0] < q and min(c.l[1:]) >= q for c in cells)
    sizes = spark.createDataFrame([(f"g{k}", 100) for k in range(40)] + [("huge", 900)], "grp string, n long")
    placed, split = P._cells(sizes, 4900, 5, 450)
    cells = {r.grp: r.cells for r in placed.collect()}
    assert split and len(cells) == 41 and len(set(cells["huge"])) == 2 and len({c for own in cells.values() for c in own}) == 25
    assert P._cells(sizes.where("n < 500"), 4000, 5, 450)[1] is False


@pytest.mark.parametrize("block", [7, 1000])
def test_top_pairs_of_blocks_hold_the_top_of_all(spark, block):
    rows = vectors(2)
    table = spark.createDataFrame([(i, g, x.tolist()) for i, g, x in rows], "spot_id long, photo string, embedding array<double>")
    pairs = sorted((-(x @ y), min(i, j), max(i, j)) for (i, a, x), (j, b, y) in combinations(rows, 2) if a != b)
    found = angles.pairs_above(table, -2.0, group="photo", block=block, most=5).orderBy(F.col("sim").desc(), "a", "b").limit(5).collect()
    assert [(r.a, r.b) for r in found] == [(a, b) for _, a, b in pairs[:5]]
    each = R.first_per(angles.pairs_above(table, -2.0, group="photo", block=block, most=1, per_group=True), ["group_a", "group_b"], F.col("sim").desc(), "a", "b").collect()
    best = {}
    for (i, a, x), (j, b, y) in combinations(rows, 2):
        if a != b:
            key = min(a, b), max(a, b)
            best[key] = max(best.get(key, -2.0), x @ y)
    assert {(r.group_a, r.group_b): r.sim for r in each} == pytest.approx(best)


@pytest.mark.parametrize("falling", [False, True])
def test_running_sums_with_a_hot_value_and_nulls(spark, falling):
    rng = np.random.default_rng(5)
    rows = [(None if i % 11 == 0 else 1.5 if i % 3 == 0 else float(rng.normal()), int(i), int(rng.integers(0, 5))) for i in rng.permutation(200)]
    df = spark.createDataFrame(rows, "v double, t long, x int")
    key = lambda r: ((r[0] is None) if falling else (r[0] is not None), -(r[0] or 0) if falling else (r[0] or 0), r[1])
    total, expected = 0, {}
    for r in sorted(rows, key=key):
        total += r[2]
        expected[r[1]] = total
    out = R.running(df, "v", "t", falling, s=F.col("x"), n=F.lit(1)).collect()
    assert {r.t: r.s for r in out} == expected and len(out) == 200
    assert {r.s_all for r in out} == {total} and {r.n_all for r in out} == {200} and max(r.n for r in out) == 200
    assert R.running(df.limit(0), "v", "t", falling, s=F.col("x")).count() == 0


def test_value_at(spark):
    values = [0.5, 0.5, 0.5, 1.0, 2.0, None, 7.0, 8.0, 9.0, 100.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    own = sorted(v for v in values if v is not None)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert R.value_at(df, "v", share, "o").first().o == own[int(share * (len(own) - 1))]
    assert R.value_at(df.limit(0), "v", 0.5, "o").collect() in ([], [(None,)])


def test_negatives_are_of_other_labels(spark):
    q = spark.createDataFrame([(i, i % 3) for i in range(40)], "query long, label long")
    c = spark.createDataFrame([(100 + i, i % 3) for i in range(300)], "candidate long, candidate_label long")
    out = N.negatives(q, c, 3).collect()
    assert len(out) == 120 and len(set(out)) == 120
    assert all((r.candidate - 100) % 3 != r["query"] % 3 for r in out)
    assert sorted(out) == sorted(N.negatives(q.repartition(7), c.repartition(5), 3).collect())
    assert N.negatives(q, c.limit(0), 3).count() == 0


def test_checksum_ignores_order_and_sees_every_row(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("r"))
    one = {r.k: r.checksum for r in A.checksum(df, ["k"], F.col("r")).collect()}
    assert one == {r.k: r.checksum for r in A.checksum(df.orderBy(F.desc("r")).repartition(5), ["k"], F.col("r")).collect()}
    for other in (df.union(df.where("r = '7'")), df.where("r <> '7'")):
        changed = {r.k: r.checksum for r in A.checksum(other, ["k"], F.col("r")).collect()}
        assert changed[0] == one[0] and changed[1] != one[1]


def test_prefix_metrics_over_ties(spark):
    rows = [(1.0, 1, True), (1.0, 2, False), (0.5, 3, True), (0.5, 4, True), (0.1, 5, False)]
    df = spark.createDataFrame(rows, "s double, t long, y boolean")
    assert M.tpr_at_fpr(df, "s", "y", 0.5, "t").first().tpr == 1.0
    assert M.tpr_at_fpr(df, "s", "y", 0.0, "t").first().tpr == pytest.approx(1 / 3, abs=1e-6)
    assert M.abstain_point(df, "s", "y", "t", 0.7).first().n == 5
    assert M.abstain_point(df.limit(0), "s", "y", "t", 0.7).first().n == 0


def test_places_of_several_factors(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), None if i % 13 == 0 else float(rng.integers(0, 6)), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    found = {(r.id, r.factor): r.place for r in R.each_place(df, ["id"], ["a", "b"]).collect()}
    for k in (1, 2):
        own = [-1e9 if r[k] is None else r[k] for r in rows]
        expected = {(r[0], k - 1): (sum(x < v for x in own) + (sum(x == v for x in own) - 1) / 2) / 89 for r, v in zip(rows, own, strict=True)}
        assert {x: p for x, p in found.items() if x[1] == k - 1} == pytest.approx(expected)
    assert R.each_place(df.limit(1), ["id"], ["b"]).first().place == 0
    assert R.each_place(df.limit(0), ["id"], ["a"]).count() == 0


def test_isolation_and_distinctiveness(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 0.3, 0.4), (1, 3, 0.0, 1.0), (1, 4, None, 9.0), (2, 1, 0.5, None)]
    df = spark.createDataFrame(rows, "image long, spot long, t double, u double")
    out = {(r.image, r.spot): r.isolation for r in Q.isolation(df, "image", "spot", "t", "u").collect()}
    at = np.array([[0, 0], [0.3, 0.4], [0, 1], [0.5, 3]])
    for k in range(4):
        assert out[1, k + 1] == pytest.approx(np.sort(np.hypot(*(at - at[k]).T))[1:].mean())
    assert out[2, 1] == 1.0
    score = Q.distinctiveness(df, "image", "spot", {"size": "t"}, {"size": 1.0, "rarity": 1.0})
    assert {(r.image, r.spot): r.distinctiveness for r in score.collect()} == pytest.approx({(1, 4): 0.25, (1, 1): 0.4375, (1, 3): 0.4375, (1, 2): 0.625, (2, 1): 0.75})
    assert Q.distinctiveness(df, "image", "spot", {}, {"rarity": 2.0}).first().distinctiveness == 0.5


def test_one_row_per_key_does_not_depend_on_partitions(spark):
    table, changes = spark.createDataFrame([(1, "old")], "k long, v string"), spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, None)], "k long, v string")
    for n in (1, 7):
        assert sorted(map(tuple, sinks.upsert(table, changes.repartition(n), ["k"]).collect())) == [(1, "x"), (2, "z")]
        assert sorted(map(tuple, sinks.insert_missing(table, changes.repartition(n), ["k"]).collect())) == [(1, "old"), (2, "z")]


SHAPES = {
    "log_normal": lambda r, n: np.exp(2 * r.normal(size=n)),
    "outlier": lambda r, n: np.r_[r.normal(size=n - 1), 1e9],
    "equal": lambda r, n: np.full(n, 3.0),
    "half_equal": lambda r, n: np.where(np.arange(n) % 2, 3.0, r.normal(size=n)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ranges_are_of_equal_depth(spark, shape):
    """The fullest range holds less than twice the mean, whatever the values, and one group of many as well."""
    n = 40_000
    values = SHAPES[shape](np.random.default_rng(3), n)
    df = spark.createDataFrame([("hot" if k % 10 else f"g{k % 70}", float(v), k) for k, v in enumerate(values)], "g string, v double, k long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for order in ([F.col("v"), "k"], ["g", F.col("v").desc(), "k"]):
            sizes = [r["count"] for r in R.in_ranges(df, *order).groupBy("_b").count().collect()]
            assert len(sizes) == 32 and sum(sizes) == n and max(sizes) < 2 * n / 32
        # Rows alike in value and tie are dealt out too.
        out = R.running(df.withColumn("k", F.lit(0)), "v", "k", s=F.lit(1))
        assert out.agg(F.max("s"), F.min("s"), F.countDistinct("s")).first() == (n, 1, n)
        sums = R.prefix_sums(df, ["g"], [F.col("v"), F.col("k")], s=F.col("k")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    total = {}
    for r in sorted(sums, key=lambda r: (r.g, r.v, r.k)):
        total[r.g] = total.get(r.g, 0) + r.k
        assert r.s == total[r.g]
    assert all(r.s_all == total[r.g] for r in sums)


def test_sums_by_group_with_null_groups(spark):
    rows = [(None, 1.0, 2), ("a", None, 3), (None, None, 4), ("a", 2.0, 5), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, v double, x int")
    out = {(r.g, r.v): (r.s, r.s_all) for r in R.prefix_sums(df, ["g"], [F.col("v")], s=F.col("x")).collect()}
    assert out == {(None, None): (4, 6), (None, 1.0): (6, 6), ("a", None): (3, 8), ("a", 2.0): (8, 8), ("b", 1.0): (None, None)}
    assert {r.g: r.q for r in R.quantile_at(df, ["g"], "v", 0.5, "q").collect()} == {None: 1.0, "a": 2.0, "b": 1.0}


def test_curves_by_group_match_plain_ones(spark):
    rng = np.random.default_rng(11)
    rows = [("hot" if k % 5 else "cold", float(rng.integers(0, 9)), k, None if k % 17 == 0 else bool(rng.random() < 0.4)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, t long, y boolean")
    found = {r.g: r.aurc for r in M.risk_coverage(df, "s", "y", "t", "g").collect()}
    for g in ("hot", "cold"):
        own = [r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))]
        risks = [1 - np.mean([y for y in own[: k + 1] if y is not None]) if any(y is not None for y in own[: k + 1]) else None for k in range(len(own))]
        area = sum((a + b) / 2 / len(own) for a, b in zip(risks[:-1], risks[1:], strict=True) if a is not None and b is not None)
        assert found[g] == pytest.approx(area, abs=1e-6)


def test_exact_negatives_whatever_the_labels(spark):
    """Every query gets as many as there are, up to k; nine tenths of all candidates are of one label, and some have none."""
    cand = [(k, "hot" if k % 10 else f"c{k % 7}" if k % 20 else None) for k in range(400)]
    quer = [(1000 + k, ("hot", "c0", "none", None, "c3")[k % 5]) for k in range(100)]
    c = spark.createDataFrame(cand, "candidate long, candidate_label string").repartition(3)
    q = spark.createDataFrame(quer, "query long, label string").repartition(3)
    for each in (1, 5, 38, 1000):
        out = {}
        for r in N.negatives(q, c, each).collect():
            out.setdefault(r["query"], []).append(r.candidate)
        for query, label in quer:
            others = {k for k, own in cand if own != label}
            assert len(out[query]) == len(set(out[query])) == min(each, len(others)) and set(out[query]) <= others
    used = {r.candidate for r in N.negatives(q, c, 5).where("query % 5 = 0").collect()}
    assert len(used) == 40  # hot queries take from all forty others
    only = c.where("candidate_label = 'hot'")
    assert N.negatives(q.where("label = 'hot'"), only, 3).count() == 0 and N.negatives(q, c.limit(0), 3).count() == 0


def test_candidate_pairs_keep_positives(spark):
    gallery = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d"), (6, "d")], "image long, label string")
    queries = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c"), (10, "z")], "query long, label string")
    out = sorted(tuple(r) for r in N.candidate_pairs(queries, gallery, 10).collect())
    # 3 is the only photo of b, and z has none; 9 is no photo of the gallery itself.
    assert out == [(1, "a", True, 1), (1, "b", False, 1), (1, "c", False, 1), (1, "d", False, 2), (9, "a", False, 2), (9, "b", False, 1), (9, "c", True, 1), (9, "d", False, 2)]
    assert len([r for r in N.candidate_pairs(queries, gallery, 2).collect() if not r.same]) == 4


def test_nearest_points_of_many_clicks(spark):
    rng = np.random.default_rng(8)
    pts = [(int(i) % 2, int(i), *map(float, p)) for i, p in enumerate(rng.integers(-20, 20, (300, 2)) / 10)]
    clk = [(int(i) % 3, int(i), *map(float, p)) for i, p in enumerate(rng.integers(-40, 40, (200, 2)) / 20)] + [(0, 999, 50.0, 50.0)]
    points = spark.createDataFrame(pts, "im long, pt long, x double, y double")
    clicks = spark.createDataFrame(clk, "im long, ck long, x double, y double")
    found = {(r.im, r.ck): (r.pt, r.distance) for r in J.nearest_point(clicks, points, "im", "ck", "pt", 0.25).collect()}
    assert len(found) == len(clk)
    for im, ck, x, y in clk:
        near = sorted((round((x - a) ** 2 + (y - b) ** 2, 9), p) for i, p, a, b in pts if i == im)
        near = [n for n in near if n[0] <= 0.0625]
        assert found[im, ck] == ((near[0][1], pytest.approx(near[0][0] ** 0.5)) if near else (None, None))
    assert sum(p is None for p, _ in found.values()) > 60


def test_resamples_are_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "DRAWS", 7)
    rng = np.random.default_rng(2)
    k, n = rng.integers(0, 30, 40), rng.integers(30, 60, 40)
    per = spark.createDataFrame([(f"c{i}", int(a), int(b)) for i, (a, b) in enumerate(zip(k, n, strict=True))], "c string, k long, n long")
    drawn = N.resampled(per, "c", 300)
    assert {r[0] for r in drawn.groupBy("rep").agg(F.sum("times")).select("sum(times)").collect()} == {40}
    assert drawn.groupBy("rep", "c").count().agg(F.max("count")).first()[0] == 1 and drawn.select("rep").distinct().count() == 300
    rows = spark.createDataFrame([(f"c{i}", bool(j < a)) for i, (a, b) in enumerate(zip(k, n, strict=True)) for j in range(b)], "c string, hit boolean")
    found = N.cluster_bootstrap(rows, "c", "hit", 2000).first()
    picks = rng.integers(0, 40, (4000, 40))
    v = k[picks].sum(1) / n[picks].sum(1)
    spread = v.std()
    assert abs(found.mean - v.mean()) < 0.1 * spread and abs(found.lo - np.quantile(v, 0.025)) < 0.2 * spread and abs(found.hi - np.quantile(v, 0.975)) < 0.2 * spread
    assert N.resampled(per.limit(0), "c", 5).count() == 0


def test_gate_is_fitted_on_other_individuals(spark):
    rng = np.random.default_rng(4)
    n = 900
    who, near = rng.integers(0, 60, n), rng.random(n) < 0.5
    cos = np.clip(rng.normal(0.6, 0.1, n), -0.2, 1)
    d2 = np.where(near, rng.random(n) * 0.01, 0.2 + rng.random(n))
    y = near ^ (rng.random(n) < 0.05)
    rows = [(int(w), float(c), None if k % 50 == 0 else float(d), bool(t)) for k, (w, c, d, t) in enumerate(zip(who, cos, d2, y, strict=True))] + [(1, None, 0.1, True), (1, 0.5, 0.1, None)]
    edges = spark.createDataFrame(rows, "who long, cos double, d2 double, y boolean").repartition(3)
    out = {r.fold: r for r in M.gate_fit(edges, "who", "cos", "d2", "y", [0.12, 0.25, 1.0, 1e6], [k / 20 for k in range(1, 20)], (1e6, 0.5)).collect()}
    assert set(out) == {-1, 0, 1, 2, 3, 4} and sum(r.n for f, r in out.items() if f >= 0) == n == out[-1].n
    # Position tells the classes apart: a narrow gate beats none, on the folds held out as well.
    assert all(r.sigma <= 0.25 and r.f_test > 0.85 and r.f_test > r.f_current for r in out.values())
    q = np.clip(cos, 0, None) * np.where(np.arange(n) % 50 == 0, 1.0, np.exp(-d2 / (2 * out[-1].sigma ** 2)))
    kept = [t / 20 for t in range(1, 20) if y[np.floor(q * 1000 + 1e-9) >= round(t * 50)].mean() >= 0.9]
    assert out[-1].good_threshold == kept[0]


def test_isolation_of_large_images(spark, monkeypatch):
    rng = np.random.default_rng(12)
    clusters = rng.random((30, 2))
    places = np.concatenate([np.round(clusters[rng.integers(0, 30, 900)] + 1e-4 * rng.normal(size=(900, 2)), 6), np.full((90, 2), 0.25), rng.random((10, 2)) * 2])
    d = np.sort(np.sqrt(((places[:, None] - places[None]) ** 2).sum(2)), axis=1)[:, 1:4]
    assert Q.nearest_means(places, 3) == pytest.approx(d.mean(1), abs=1e-12)
    for n in (1, 2, 3, 5):
        few = np.sort(np.sqrt(((places[:n, None] - places[None, :n]) ** 2).sum(2)), axis=1)[:, 1:4]
        assert Q.nearest_means(places[:n], 3) == pytest.approx(few.mean(1) if n > 1 else [1.0])
    rows = [(k % 2, k, *map(float, p)) for k, p in enumerate(places)] + [(7, 1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "image long, spot long, t double, u double")
    whole = {(r.image, r.spot): r.isolation for r in Q.isolation(df, "image", "spot", "t", "u").collect()}
    monkeypatch.setattr(Q, "FEW", 10_000)
    assert whole == pytest.approx({(r.image, r.spot): r.isolation for r in Q.isolation(df, "image", "spot", "t", "u").collect()}, abs=1e-12)
    assert len(whole) == len(rows) and whole[7, 1] == 1.0


def test_isolation_of_an_image_of_200_000_spots():
    rng = np.random.default_rng(13)
    places = np.concatenate([rng.random((100_000, 2)), 0.5 + 1e-5 * rng.normal(size=(60_000, 2)), np.full((40_000, 2), 0.75)])
    found = Q.nearest_means(places, 3)
    for k in (0, 5, 99_999, 120_000, 199_999):
        assert found[k] == pytest.approx(np.sort(np.sqrt(((places - places[k]) ** 2).sum(1)))[1:4].mean(), abs=1e-12)


def test_repeated_clicks_are_not_broadcast(spark):
    """Clicks are repeated for the cells they reach, so their files' size says nothing: the first plan must not broadcast them."""
    import __spark_entry__

    plan = __spark_entry__.queries()["join_nearest_point"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    odd = spark.createDataFrame([(1, 1, None, 0.0), (1, 2, float("nan"), 0.0), (1, 3, 0.01, 0.0), (None, 4, 0.0, 0.0)], "im long, ck long, x double, y double")
    points = spark.createDataFrame([(1, 7, 0.0, 0.0), (None, 8, 0.0, 0.0)], "im long, pt long, x double, y double")
    assert {r.ck: r.pt for r in J.nearest_point(odd, points, "im", "ck", "pt", 0.03).collect()} == {1: None, 2: None, 3: 7, 4: None}


def test_contributors_by_team(spark):
    """Individuals and contributors meet by teams: the relation is the same, counts are multiplied and not joined, and parts lose nothing."""
    from censa.operators import aggregates as A
    from censa.plans.roles import role

    sf = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in role(spark, sf, "individual_contributors").collect()}
    teams, members = role(spark, sf, "individual_teams"), role(spark, sf, "team_contributors")
    for joined in (teams.join(members, "team"), J.fan_out(teams, members, "team", "individual_id")):
        rows = [tuple(r) for r in joined.select("individual_id", "contributor_id").collect()]
        assert len(rows) == len(whole) and set(rows) == whole
    individuals = spark.createDataFrame([(k,) for k in range(4)], "individual_id long")
    images = spark.createDataFrame([(10, 0), (11, 0), (12, 1)], "image_id long, individual_id long")
    teams = spark.createDataFrame([(0, 5), (1, 6), (3, 5)], "individual_id long, team long")
    members = spark.createDataFrame([(5, 1), (5, 2), (5, 3)], "team long, contributor_id long")
    names = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "contributor_id long, name string")
    assert sorted(map(tuple, A.fanout(individuals, images, teams, members, names).collect())) == [(0, 6, 2, 2), (1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 2)]
    assert sorted(map(tuple, A.roster(individuals, images, teams, members, names).collect())) == [(0, 2, "a; b"), (1, 1, None), (2, 0, None), (3, 0, "a; b")]


def test_few_blocks_for_large_tables():
    """A row is sent to each block of the other side: eight times the rows must not mean eight times the copies of each."""
    assert [P._blocks(n, 4000) for n in (0, 1, 4000, 4001, 32_000, 50_000, 256_000, 600_000)] == [1, 1, 1, 2, 8, 8, 8, 19]


def test_tasks_that_number_spots_are_of_bounded_size(spark, monkeypatch):
    """A large table of spots is dealt into tasks of about as many rows, which windows by image keep; the rows are the same."""
    from censa.plans import CATALOGUES, roles

    sf = "/root/testdata/sf0.001"
    for name in ("blend_weights", "sink_delta_merge"):
        query = next(c.queries[name] for c in CATALOGUES if name in c.queries)
        want = sorted(query(spark, sf).collect())
        monkeypatch.setattr(roles, "TASK_ROWS", 400)
        rows = query(spark, sf)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1200 and sorted(rows.collect()) == want
        monkeypatch.undo()


def test_openset_pairs_are_dealt_and_whole(spark):
    """No task holds a site, and a product in blocks loses nothing; a candidate without another photo is skipped even if its photo is listed twice."""
    from censa.plans import CATALOGUES
    from censa.plans.extended import join_openset_pairs

    left = spark.createDataFrame([(q, q % 2) for q in range(70)] + [(7, 1), (99, None)], "q long, site int")
    right = spark.createDataFrame([(c * 9_000 - 40_000, c % 3, c) for c in range(40)], "c long, site int, x int")
    assert sorted(J.product_in_blocks(left, right, "site", "q", "c").select("q", "c", "x").collect()) == sorted(left.join(right, "site").select("q", "c", "x").collect())
    assert J.product_in_blocks(left, right.limit(0), "site", "q", "c").count() == 0

    # Candidates come in the same runs for one query after the other, of a multiple of eight but for the rest.
    q, c = spark.range(400).selectExpr("id AS q", "0 AS site"), spark.range(203).selectExpr("id * 31 AS c", "0 AS site")
    rows = J.product_in_blocks(q, c, "site", "q", "c").collect()
    runs = {(k, tuple(r.c for r in own)) for k, own in groupby(rows, lambda r: r.q)}
    assert {len(x) for _, x in runs} == {200, 3} and len({x for _, x in runs}) == 2 and len(runs) == 800

    photos = [(1, 10, "flagged_uncertain"), (1, 10, "confirmed"), (1, 10, "confirmed"), (2, 10, "flagged_uncertain"), (3, 11, "confirmed"), (None, 12, "confirmed"), (None, 12, "confirmed"), (None, 11, "flagged_uncertain")]
    images = spark.createDataFrame(photos, "image_id long, individual_id long, status string")
    individuals = spark.createDataFrame([(10, 0), (11, 0), (12, 0)], "individual_id long, site_id int")
    assert sorted(map(tuple, join_openset_pairs(images, individuals).collect())) == [(1, 11, False), (2, 10, True), (2, 11, False)]

    pairs = next(c.queries["join_openset_pairs"] for c in CATALOGUES if "join_openset_pairs" in c.queries)(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4


def test_candidates_are_left_out_by_block_and_not_by_row(spark):
    """A product lists plain numbers, and what a query may not meet is taken from its block before; a candidate that comes twice is there twice."""
    from censa.plans import CATALOGUES

    left = spark.createDataFrame([(q, q % 2) for q in range(60)] + [(7, 1), (99, None)], "q long, site int")
    right = spark.createDataFrame([(c * 700 - 9_000, c % 3, c if c % 4 else None) for c in [*range(60), 5, 9]], "c long, site int, u long")
    want = sorted(left.join(right, "site").where("u IS NULL OR u <> q").select("q", "c").collect())
    assert sorted(J.product_in_blocks(left, right, "site", "q", "c", unless="u").select("q", "c").collect()) == want
    assert sorted(J.product_in_blocks(left, right.withColumn("u", F.lit(None).cast("long")), "site", "q", "c", unless="u").select("q", "c").collect()) == sorted(left.join(right, "site").select("q", "c").collect())

    pairs = next(c.queries["join_openset_pairs"] for c in CATALOGUES if "join_openset_pairs" in c.queries)(spark, "/root/testdata/sf0.001")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(_block")]
    assert "Filter" not in above and "inline" not in plan


def test_distinctiveness_moves_rows_once(spark, monkeypatch):
    """Neighbours come from one window and places from small tables, so rows are dealt by image and not moved again; hulls are measured together."""
    from censa.operators import geometry as G

    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 5, 9):
        points = rng.integers(0, 5, (200, m, 2)).astype(float)
        points[:20] = points[:20, :1]
        z = points[..., 0] + 1j * points[..., 1]
        turn = np.exp(1j * np.linspace(0, 2 * np.pi, 7200, endpoint=False))
        for own, found in zip(z, G.hull_areas(z), strict=True):
            support = own[np.argmax((own[:, None] * turn.conj()).real, axis=0)]  # corners in turn
            assert found == pytest.approx(abs((support.conj() * np.roll(support, -1)).imag.sum()) / 2, abs=1e-9)
    rows = [(k % 9, k, float(rng.integers(0, 5)), float(rng.normal())) for k in range(300)] + [(None, 400, 0.0, 0.0), (None, 401, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "image long, spot long, t double, u double").withColumn("w", F.col("spot") * 2)
    moves = lambda out: out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    found = Q.isolation(df, "image", "spot", "t", "u", keep=("w",))
    assert moves(found) == 1
    kept = {r.spot: (r.w, r.isolation) for r in found.collect()}
    assert len(kept) == len(rows) and all(w == 2 * s for s, (w, _) in kept.items()) and kept[400][1] == kept[401][1] == 1.0
    monkeypatch.setattr(Q, "FEW", 20)
    for r in Q.isolation(df, "image", "spot", "t", "u", keep=("w",)).collect():
        assert (r.w, r.isolation) == (kept[r.spot][0], pytest.approx(kept[r.spot][1]))
    assert moves(Q.distinctiveness(df, "image", "spot", {"size": "t", "isolation": "u"}, {"size": 1.0, "isolation": 0.5})) == 0


def test_spots_are_dealt_whatever_the_partitions(spark, monkeypatch):
    """With more shuffle partitions than tasks, too, a large table is dealt into bounded tasks, which are not put together again."""
    from censa.plans import CATALOGUES, roles

    query = next(c.queries["sink_delta_merge"] for c in CATALOGUES if "sink_delta_merge" in c.queries)
    want = sorted(query(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(roles, "TASK_ROWS", 400)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rows = query(spark, "/root/testdata/sf0.001")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 800 and sorted(rows.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
