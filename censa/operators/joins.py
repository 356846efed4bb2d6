"""Joins of the workflow and of photo pairs. Only equi-joins: wider conditions are rewritten into keys first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_all(left: DataFrame, *rights: tuple[DataFrame, str]) -> DataFrame:
    """`left` joined to each (table, key) on the left; nothing on the left is lost."""
    for right, key in rights:
        left = left.join(right, key, "left")
    return left


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(table, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


#: Parts that each key of `fan_out` is dealt to.
SALTS = 32


def fan_out(left: DataFrame, right: DataFrame, key: str, by: str, turn: bool = False) -> DataFrame:
    """A join of few keys with many rows on both sides: rows of `left` are dealt to parts by a column, those of `right` go to each.

    The result is as large as the product within a key; neither side is gathered by key, and the partitions keep their number.
    It lists for a row of `left` those of `right`; with `turn` for a row of `right` those of `left`.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS))).repartition(n, key, "_part")
    each = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).repartition(n, key, "_part")
    held = dealt.hint("shuffle_hash").join(each, [key, "_part"]) if turn else dealt.join(each.hint("shuffle_hash"), [key, "_part"])
    return held.drop("_part")


#: Ids that differ by less stand in one block of `product_in_blocks`.
SPAN = 16_384


def product_in_blocks(left: DataFrame, right: DataFrame, key: str, query: str, candidate: str, unless: str | None = None) -> DataFrame:
    """`left` joined with all `right` of a key, where that product is the result: a block of neighbouring candidates for one query after the other.

    Queries are dealt to parts, blocks go to each, so no task holds a key. Candidates come in the same order again and again at
    a short distance, so files of the result take a small share of their size in another order. Parquet packs eight values
    at a time: only where a block is a multiple of that are its repetitions equal, so the rest of its candidates is a block
    of its own. `candidate` is a whole number. Where `right` has no more than it and the key, blocks are plain arrays of it.

    A candidate is left out for the query that equals its `unless`. That is looked up once for a query and a block, not for
    each of its rows, and it needs plain blocks.
    """
    own = [c for c in right.columns if c not in (key, unless)]
    plain = own == [candidate]
    block = F.collect_list(F.col(candidate) if plain else F.struct(*own)).alias("_block")
    gone = F.collect_list(F.when(F.col(unless).isNotNull(), F.struct(F.col(unless).alias("q"), F.col(candidate).alias("c"))) if unless else F.lit(None)).alias("_gone")
    blocks = right.groupBy(key, F.floor(F.col(candidate) / SPAN).alias("_span")).agg(block, *([gone] if unless else []))
    rest = F.size("_block") % 8
    even = F.size("_block") - rest
    also = ["_gone", F.col("_gone.q").alias("_to")] if unless else []
    blocks = blocks.select(key, F.explode(F.array(F.slice("_block", 1, even), F.slice("_block", even + 1, rest))).alias("_block"), *also).where(F.size("_block") > 0)
    met = fan_out(left, blocks, key, query, turn=True)
    if unless:
        others = lambda c: ~F.exists("_gone", lambda x: (x["q"] == F.col(query)) & (x["c"] == c))
        met = met.withColumn("_block", F.when(F.array_contains("_to", F.col(query)), F.filter("_block", others)).otherwise(F.col("_block")))
    return met.select(*left.columns, F.explode("_block").alias(candidate) if plain else F.inline("_block"))


def only_left(left: DataFrame, right: DataFrame, key: str, side: str) -> DataFrame:
    """Distinct keys of `left` that `right` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit(side))


def longest_prefix(texts: DataFrame, prefixes: DataFrame, key: list[str], longest: int) -> DataFrame:
    """Each text with its longest prefix of at most `longest` characters, if exactly one prefix has that length."""
    cut = texts.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("text"), F.lit(longest))), lambda k: F.substring("text", F.lit(1), k)))).where(F.length("text") > 0)
    hits = cut.join(prefixes, "prefix").withColumn("len", F.length("prefix"))
    best = F.max("len").over(Window.partitionBy(*key))
    hits = hits.withColumn("best", best).where("len = best")
    return hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("n = 1").drop("n", "best", "len")


def pairs_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Unordered pairs (a, b) of rows of a group, a's key being the smaller."""
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))


def adjacent(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each row of a group with the next one: (group, a, b)."""
    following = F.lead(key).over(Window.partitionBy(group).orderBy(key))
    return df.select(group, F.col(key).alias("a"), following.alias("b")).where("b IS NOT NULL")


def edge_sets(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """tp, fp and fn of a set of edges against the true set."""
    both = truth.select(key, F.lit(1).alias("t")).unionByName(found.select(key, F.lit(2).alias("t"))).groupBy(key).agg(F.bit_or("t").alias("t"))
    return both.agg(F.count_if(F.col("t") == 3).alias("tp"), F.count_if(F.col("t") == 2).alias("fp"), F.count_if(F.col("t") == 1).alias("fn"))


#: Cells of points are this many radii wide, so that few clicks look into more than one.
CELL = 8


def nearest_point(clicks: DataFrame, points: DataFrame, image: str, click: str, point: str, radius: float) -> DataFrame:
    """(image, click, point, distance): each click's nearest point of its image within the radius, of equals the least; else null.

    Both hold x and y. Points stand in cells, and a click looks into those that its radius reaches, so an image of many points and
    clicks is parted. Clicks are multiplied by this, which no estimate of their size knows: the hint keeps them from being broadcast.
    Distances are compared at nine decimals of their squares.
    """
    reach = math.sqrt(radius * radius + 1e-9)  # what may round to the radius is within reach
    width = CELL * reach
    cell = lambda c, d=0.0: F.floor((F.col(c) + d) / width).cast("long")
    about = lambda c: F.explode_outer(F.when(F.abs(c) < float("inf"), F.sequence(cell(c, -reach), cell(c, reach))))
    at = clicks.select(image, click, F.col("x").alias("_x"), F.col("y").alias("_y"))
    at = at.withColumn("_cx", about("_x")).withColumn("_cy", about("_y"))
    held = points.select(image, point, "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy"))
    square = F.round(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2), 9)
    near = at.hint("merge").join(held, [image, "_cx", "_cy"], "left").withColumn("_d", square)
    best = F.min(F.when(F.col("_d") <= round(radius * radius, 9), F.struct("_d", point)))
    return near.groupBy(image, click).agg(best.alias("_b")).select(image, click, F.col(f"_b.{point}").alias(point), F.sqrt("_b._d").alias("distance"))
