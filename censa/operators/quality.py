"""Quality scores of images and distinctiveness of spots, as column arithmetic and ranks within an image."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .aggregates import quantile_index
from .ranking import places_beside, rank01


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def judged(column: str) -> Column:
    """1 for a good axis, 0.5 for one not judged, 0.4 for a bad one."""
    return F.when(F.col(column).isNull(), 0.5).when(F.col(column), 1.0).otherwise(0.4)


def geometric_mean(*columns: str, floor: float = 1e-4) -> Column:
    product = reduce(lambda a, b: a * b, (F.greatest(F.col(c), F.lit(floor)) for c in columns))
    return F.pow(product, F.lit(1.0 / len(columns)))


def calibrate(df: DataFrame, sharpness: str, defects: dict[str, tuple[str, float]], q: float = 0.9) -> DataFrame:
    """One row: the median of the sharpness, and for each defect its nearest-rank quantile, not below a floor."""
    out = df.agg(F.greatest(F.percentile(sharpness, F.lit(0.5)), F.lit(1e-6)).alias("blur_median"))
    for name, (column, floor) in defects.items():
        scale = quantile_index(df.withColumn("_all", F.lit(1)), ["_all"], column, q, name).select(F.greatest(F.col(name), F.lit(floor)).alias(name))
        out = out.join(F.broadcast(scale))  # one row is broadcast
    return out


def blend(df: DataFrame, group: list[str], tie: list[str], factors: dict[str, str | Column], weights: dict[str, float]) -> DataFrame:
    """Adds `blend`: the weighted mean of the factors' places (0 to 1) within the group."""
    for name, factor in factors.items():
        df = df.withColumn(f"_f_{name}", F.col(factor) if isinstance(factor, str) else factor)
    total = sum(weights.values())
    score = reduce(lambda a, b: a + b, (F.lit(weights[n] / total) * rank01(f"_f_{n}", tie, *group) for n in factors))
    return df.withColumn("blend", score).drop(*(f"_f_{n}" for n in factors))


#: The factors of a spot's distinctiveness. Rarity takes part only as a constant unless its column is given.
FACTORS = ("size", "elongation", "noncircularity", "irregularity", "rarity", "isolation")


#: Spots of an image that are compared within its rows; images of more are searched leaf by leaf.
FEW = 256
LEAF = 32


def nearest_means(places: np.ndarray, near: int) -> np.ndarray:
    """Mean distance of each place to its `near` nearest others, exact.

    Places are halved along their longer side down to leaves. A leaf's own places give a first bound on the distances, and
    only leaves whose boxes come within the largest of them are looked at; of equal places no more than can count are held.
    """
    some, of, count = np.unique(places, axis=0, return_inverse=True, return_counts=True)
    points = np.repeat(some, np.minimum(count, near + 1), axis=0)
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        side = points[rows]
        order = rows[np.argsort(side[:, np.argmax(np.ptp(side, axis=0))], kind="stable")]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    low, high = (np.array([f(points[r], axis=0) for r in leaves]) for f in (np.min, np.max))

    def means(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance of the last that counts, mean) of `own` among `other`, which holds it."""
        d = np.sqrt(((own[:, None] - other[None]) ** 2).sum(2))
        d = np.sort(np.partition(d, min(near, d.shape[1] - 1), axis=1)[:, : near + 1], axis=1)[:, 1:]
        return (d[:, -1] if d.shape[1] == near else np.full(len(own), np.inf)), (d.mean(1) if d.shape[1] else np.ones(len(own)))

    found = np.empty(len(points))
    for k, rows in enumerate(leaves):
        own = points[rows]
        reach = means(own, own)[0].max()
        gap = np.sqrt((np.maximum(np.maximum(low - high[k], low[k] - high), 0) ** 2).sum(1))
        found[rows] = means(own, points[np.concatenate([leaves[j] for j in np.flatnonzero(gap <= reach * (1 + 1e-9))])])[1]
    first = np.cumsum(np.minimum(count, near + 1)) - np.minimum(count, near + 1)
    return found[first][of.reshape(-1)]


def isolation(spots: DataFrame, image: str, spot: str, t: str, aside: str, near: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image, spot, keep, isolation): mean distance of a spot to its `near` nearest others of the image, 1 for a lone one or no image.

    Places are the share along the axis (unknown: 0.5) and the distance from it in half widths, within -3 and 3 (unknown: 0).
    Images of at most FEW spots, as photos have, hold their places in each row; a larger one is searched in one task, which
    holds its places and, at a time, the distances of a leaf to the leaves around it.
    """
    finite = lambda c, other: F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c)), F.lit(other))
    at = F.struct(finite(t, 0.5).cast("double").alias("t"), F.least(F.greatest(finite(aside, 0.0), F.lit(-3.0)), F.lit(3.0)).cast("double").alias("u"))
    rows = spots.select(image, spot, *keep, at.alias("p"))
    large = written(rows.groupBy(image).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(image))
    few = rows if large.isEmpty() else rows.join(large, image, "left_anti")
    few = few.withColumn("all", F.collect_list(F.when(F.col(image).isNotNull(), F.col("p"))).over(Window.partitionBy(image)))
    # The nearest place of all is the spot's own, at distance 0.
    apart = F.sort_array(F.transform("all", lambda q: F.sqrt(F.pow(q["t"] - F.col("p.t"), 2) + F.pow(q["u"] - F.col("p.u"), 2))))
    some = F.slice(apart, 2, near)
    mean = F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)
    out = few.select(image, spot, *keep, F.when(F.size("all") <= 1, 1.0).otherwise(mean).alias("isolation"))
    if large.isEmpty():
        return out

    def solve(part):
        places = np.stack([part.column(c).to_numpy() for c in ("_t", "_u")], 1)
        return part.select([image, spot, *keep]).append_column("isolation", pa.array(nearest_means(places, near)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.unionByName(rows.join(large, image, "left_semi").select(image, spot, *keep, F.col("p.t").alias("_t"), F.col("p.u").alias("_u")).groupBy(image).applyInArrow(solve, kinds))


def distinctiveness(spots: DataFrame, image: str, spot: str, factors: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """(image, spot, distinctiveness): the weighted mean of the factors' places (0 to 1) among all spots.

    `factors` names a numeric column for each factor; equal values share their mean place, and nulls are one value, the
    first. A weighted factor without a column counts 0.5, as a constant has no order.
    """
    used = {n: w for n, w in weights.items() if w and n in factors}
    total, constant = sum(weights.values()), 0.5 * sum(w for n, w in weights.items() if n not in factors)
    if not used:
        return spots.select(image, spot, F.lit(constant / total if total else None).cast("double").alias("distinctiveness"))
    places = places_beside(spots, {f"_place_{n}": factors[n] for n in used})
    score = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(f"_place_{n}") for n, w in used.items()))
    return places.select(image, spot, ((score + constant) / total).alias("distinctiveness"))
