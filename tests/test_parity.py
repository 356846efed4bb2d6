"""Every query with SQL gives the rows and types that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from censa.plans import CATALOGUES

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
CASES = [(name, c) for c in CATALOGUES for name in c.queries]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def query_of(name):
    return next(c.queries[name] for c in CATALOGUES if name in c.queries)


def canonical(rows, names):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name,catalogue", CASES, ids=[n for n, _ in CASES])
def test_query(spark, duck, name, catalogue):
    out = catalogue.queries[name](spark, SF)
    rows = out.collect()
    if name not in catalogue.sql:
        assert out.columns
        return
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + catalogue.sql[name]).fetchall()}
    assert {c: TYPES[t] for c, t in out.dtypes} == kinds
    found = duck.execute(catalogue.sql[name])
    names = [d[0] for d in found.description]
    assert canonical([tuple(r) for r in rows], out.columns) == canonical(found.fetchall(), names)


@pytest.mark.parametrize("name,table,key", [("fn_polyline", "lineitem", "l_orderkey"), ("fn_clip_polygon", "orders", "o_orderkey"), ("rebin_axis", "lineitem", "l_orderkey"), ("geom_bin_spots", "lineitem", "l_orderkey"), ("build_embeddings", "lineitem", "l_orderkey"), ("ml_distinct", "lineitem", "l_orderkey")])
def test_queries_cover_all_images(spark, name, table, key):
    rows = query_of(name)(spark, SF)
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    assert rows.select("image_id").distinct().count() == whole.select(key).distinct().count()
    if "spot_id" in rows.columns:
        assert rows.count() == whole.count() == rows.select("image_id", F.col("spot_id")).distinct().count()
