"""Connected components of an edge table by alternating large-star and small-star steps, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 40) - 1))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge; ids without edges are not listed.

    Self loops, repeated edges and edges with a null end are ignored; an empty table gives an empty result.
    A hub's neighbours are never gathered: each step needs only the minimum neighbour (combined map-side) and a
    join whose two sides are plain tables, so that adaptive execution can split a hub's rows.
    """
    now = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(_minimum(both), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(_minimum(large), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        after = written(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        for old in (now, least, large, low):
            discard(old)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
