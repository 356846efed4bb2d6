"""Queries with SQL against DuckDB, the rest of the queries and the pipeline on the smallest tables."""

from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from censa.llm import quality, registry, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    out = registry.QUERIES[name](spark, SF)
    key = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(key(r) for r in out.select(*names).collect()) == sorted(map(key, found.fetchall()))
    assert sorted(out.columns) == sorted(names)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], SF).cache())
    raw, good, single, clean, mix, bins = (s.collect() for s in states)
    assert all(s.columns == names for s in states[:-1])
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r.doc_id for r in good} == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in good}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = {r.doc_id for r in single}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    links = {(a, b) for ids in by.values() for a in ids for b in ids if a < b and alike(a, b) >= 0.8}
    exact = [(a, b) for a, b in links if alike(a, b) == 1]
    assert not [p for p in exact if p[0] in kept and p[1] in kept]
    assert not [p for p in links if p[0] in kept and p[1] in kept]
    linked = {x for p in links for x in p}
    assert set(sets) - linked <= kept
    assert Counter(r.doc_id for r in clean) == Counter(kept)
    text = {r.doc_id: r.text for r in single}
    for r in clean:
        base = secret_scan.base_spans(text[r.doc_id])
        assert (r.text != text[r.doc_id]) >= bool(base) and r.n_chars == len(r.text)
        assert not any(text[r.doc_id][v:e] in r.text for _, _, e, v in base)
    copies = Counter(r.doc_id for r in mix)
    assert set(copies) <= kept and max(copies.values()) <= 3
    words = defaultdict(int)
    for r in bins:
        words[r.doc_id] += r.size
    size = {r.doc_id: len(r.text.split()) for r in clean}
    assert words == {d: n * size[d] for d, n in copies.items()}
    assert corpus_pipeline.run(spark, SF).count() == len(bins)
