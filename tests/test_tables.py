"""Sources, sinks, workflow steps and the stream, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from censa.operators import angles, ranking, workflow
from censa.sources import sinks, tables
from censa.streaming import activity


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_review_store(spark, tmp_path):
    path = tmp_path / "store.json"
    member = lambda i, s: {"image": i, "spot": s}
    path.write_text(json.dumps({"rev": 1, "individuals": {"aa_1": {"images": {"aa_1_1": {"decision": "accept", "reasons": []}, "aa_1_2": {"decision": "reject", "reasons": ["blur", "dup"]}}, "matches": [{"match_id": "m", "accepted": True, "members": [member("aa_1_1", 1), member("aa_1_2", 2), member("aa_1_2", 3)]}, {"match_id": "n", "members": []}]}}}))
    store = tables.read_review_store(spark, str(path))
    assert rows(tables.match_verdicts(store), "sid_a", "spot_a", "sid_b", "spot_b", "pair_kind") == [("aa_1_1", 1, "aa_1_2", 2, "cross_image"), ("aa_1_1", 1, "aa_1_2", 3, "cross_image"), ("aa_1_2", 2, "aa_1_2", 3, "same_image")]
    assert rows(tables.reason_counts(tables.image_decisions(store))) == [("blur", 1), ("dup", 1)]
    assert tables.match_verdicts(tables.read_review_store(spark, str(tmp_path / "none.json"))).count() == 0


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"task": "a", "n": 1}\nnot json\n{"task": "b", "n": 2}\n')
    assert rows(tables.read_jsonl(spark, str(tmp_path / "log.jsonl"), "task string, n int")) == [("a", 1), ("b", 2)]
    (tmp_path / "map.csv").write_text("﻿Label,x\nKF-1,1\nSA-2,2\n", encoding="utf-8")
    assert rows(tables.read_label_map(spark, str(tmp_path / "map.csv"), "Label", {"KF-": "kf"}, "sasa")) == [("KF-1", "kf"), ("SA-2", "sasa")]


def test_merge_databases(spark):
    a = spark.createDataFrame([("x_1", 1, False)], "image_id string, n int, is_synthetic boolean")
    b = spark.createDataFrame([("y_g1",)], "image_id string")
    assert rows(sinks.merge_databases([{"images": b}, {"images": a}])["images"]) == [("x_1", 1, False), ("y_g1", None, True)]
    with pytest.raises(ValueError, match="unknown columns"):
        sinks.merge_databases([{"images": a}, {"images": b.withColumn("odd", F.lit(1))}])


def test_upsert_empty_and_roster(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(sinks.upsert(t, t.limit(0), ["k"])) == [(1, "a"), (2, "b")]
    assert rows(sinks.upsert(t.limit(0), t, ["k"])) == [(1, "a"), (2, "b")]
    sinks.roster_csv(t, str(tmp_path / "r"), "k")
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 2


def test_alias_cycle_ends(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "z")], "alias string, keep string")
    out = dict(rows(workflow.chase_aliases(m)))
    assert out["a"] == out["b"] == "c" and set(out) == {"a", "b", "x", "y"}


def test_stale_revision_is_rejected(spark):
    t = spark.createDataFrame([(1, 3), (2, 5)], "k int, rev int")
    good, bad = workflow.guarded(t, spark.createDataFrame([(1, 3), (2, 4), (9, 1)], "k int, rev int"), "k")
    assert rows(good, "k") == [(1,)] and rows(bad, "k") == [(2,), (9,)]


@pytest.mark.parametrize("conf,target,most,n", [([0.9, 0.05, 0.03], 0.9, 9, 1), ([0.3, 0.3, 0.3, 0.1], 0.9, 9, 3), ([0.1] * 20, 0.99, 6, 6)])
def test_coverage(spark, conf, target, most, n):
    df = spark.createDataFrame([("q", float(c), k) for k, c in enumerate(conf)], "q string, c double, k int")
    assert ranking.coverage(df, "q", "c", "k", target, most).count() == n


def test_blocks_lose_no_pair(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "spot_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted((i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.5)
    for block in (7, 1000):
        assert rows(angles.pairs_above(df, 0.5, block=block), "a", "b") == want


def test_size_percentile_keeps_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 1.0), (5, 2.0)], "k int, v double")
    assert rows(ranking.size_percentile(df, "v", ["k"]).where("pct IS NOT NULL"), "k", "pct") == [(1, 50.0), (4, 0.0), (5, 100.0)]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = activity.read_log(spark, str(tmp_path / "in"), files=1)
    activity.fan_out(stream, str(tmp_path / "cp"), lambda df, _: got.append(df.count())).awaitTermination(120)
    assert sum(got) == log.count() and len(got) >= 2
    query = activity.windowed_counts(stream, late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == log.count()
