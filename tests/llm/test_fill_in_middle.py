"""Fill-in-middle against a plain version that lists all units."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from censa.llm import fill_in_middle as fim

ROWS = [(k, "word é\n\U0001f600 " * k) for k in range(40)] + [(100, None), (101, ""), (102, "a <S> b"), (103, "<P"), (104, "x" * 300_000), (7, "same id"), (7, "same id"), (None, "no id"), (None, None), (105, "<S<P<M" * 50)]


def plain(doc, text, unit=fim.CODE_POINT):
    """By the definition, over a list of all units."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    ends = [0] + [m.end() for m in re.finditer(unit, text)]
    n = len(ends) - 1
    if not text or h[2] % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, text
    a, b = sorted(ends[x % (n + 1)] for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", [fim.CODE_POINT, r"\S+\s*", r"[^\n]+\n?"])
def test_against_plain(spark, unit):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).select("*", *(F.lit("odd").alias(c) for c in ("n", "form", "output", "digest")))
    out = fim.fill_in_middle(docs, unit)
    rows = out.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == Counter(plain(d, t, unit) for d, t in ROWS)
    assert Counter((r.doc_id, r.again) for r in rows) == Counter((d, t or "") for d, t in ROWS)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0), unit).count() == 0


def test_units_must_not_be_empty(spark):
    with pytest.raises(ValueError):
        fim.fill_in_middle(spark.createDataFrame(ROWS, "doc_id long, text string"), r"\s*")


@given(st.text(alphabet="ab<>PSM\n\U0001f600", max_size=30), st.integers(0, 2**128 - 1))
@settings(max_examples=300, deadline=None)
def test_round_trip_of_parts(text, seed):
    pattern = re.compile(fim.CODE_POINT)
    n, form, a, m, output = fim.transform(text, f"{seed:032x}", pattern)
    assert n == len(text) == fim.count_units(pattern, text)
    if form == "plain":
        assert output == text
        return
    parts = re.split("<[PSM]>", output)
    assert len(parts) == 4 and parts[0] == ""
    first, second, middle = parts[1:]
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    assert (prefix + middle + suffix, len(prefix), len(middle)) == (text, a, m)


def test_runs_are_handed_on(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "ab " * 50) for k in range(200)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(fim, "RUN", 1000)
    assert Counter(tuple(r) for r in fim.fill_in_middle(docs).collect()) == Counter(plain(k, "ab " * 50) for k in range(200))
