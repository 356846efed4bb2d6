"""Spot embeddings from outlines and places, and generated populations to test with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import described, lists


def waves(x: np.ndarray, bands: int) -> np.ndarray:
    """sin and cos of each number at doubling frequencies."""
    angle = np.asarray(x, float)[:, None] * np.pi * 2.0 ** np.arange(bands)
    return np.hstack([np.sin(angle), np.cos(angle)])


def unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def conjunctive(a: np.ndarray, b: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Vectors whose dot products are the products of the two blocks' (lifted) cosines."""
    lift = lambda x: unit(np.hstack([x, np.full((len(x), 1), c)]))
    x, y = lift(a), lift(b)
    return (x[:, :, None] * y[:, None, :]).reshape(len(a), -1)


def build(spots: DataFrame, combine: str = "concat", order: int = 10, bands: int = 6) -> DataFrame:
    """(image_id, spot_id, embedding) from outline, axis_t, offset and side.

    Shape numbers are standardised over all spots: means and deviations are one small aggregate over positions, computed in
    Spark; each block has unit length. `combine` is concat or tensor.
    """

    @F.arrow_udf("array<double>")
    def describe(outline: pa.Array) -> pa.Array:
        return lists(described(outline, order))

    rows = spots.withColumn("_d", describe("outline")).persist()
    moments = rows.select(F.posexplode("_d").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("k").collect()  # one row for each of the descriptor's numbers
    mean, std = np.array([r.m for r in moments]), np.array([r.s for r in moments]) + 1e-8

    @F.arrow_udf("array<double>")
    def embed(d: pa.Array, t: pa.Array, offset: pa.Array, side: pa.Array) -> pa.Array:
        number = lambda v, other: np.nan_to_num(v.to_numpy(zero_copy_only=False).astype(float), nan=other)
        shape = unit((d.flatten().to_numpy(zero_copy_only=False).reshape(len(d), len(mean)) - mean) / std)
        left = pc.fill_null(pc.equal(side, "left"), False).to_numpy(zero_copy_only=False)
        place = unit(np.hstack([waves(number(t, 0.5), bands), waves(number(offset, 0.0), bands), np.where(left, 1.0, -1.0)[:, None]]))
        return lists(conjunctive(shape, place) if combine == "tensor" else np.hstack([shape, place]))

    return rows.select("image_id", "spot_id", embed("_d", "axis_t", "offset", "side").alias("embedding"))


def population(spark: SparkSession, individuals: int, photos: int, spots: int, seed: int = 0, noise: float = 0.05, lost: float = 0.15, parts: int = 8) -> DataFrame:
    """Generated identities and photos: (individual, photo, spot_id, x, y, t, embedding).

    Each identity is made from its own seed in whichever task it falls, so any number of them is made side by side. A photo
    turns and scales the pattern, loses some spots and adds noise.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                xy, code = rng.uniform(size=(spots, 2)) * [100, 30], unit(rng.normal(size=(spots, 16)))
                for p in range(photos):
                    keep = rng.uniform(size=spots) >= lost
                    keep[0] = True
                    turn, scale = rng.uniform(-np.pi, np.pi), rng.uniform(0.7, 1.4)
                    z = (xy[:, 0] + 1j * xy[:, 1] + rng.normal(size=spots) * noise * 10) * scale * np.exp(1j * turn)
                    e = unit(code + rng.normal(size=code.shape) * noise)
                    for s in np.flatnonzero(keep):
                        out.append((int(k), f"{k}_{p}", int(s), z[s].real, z[s].imag, xy[s, 0] / 100, e[s].tolist()))
            yield pd.DataFrame(out, columns=["individual", "photo", "spot_id", "x", "y", "t", "embedding"])

    return spark.range(individuals, numPartitions=parts).mapInPandas(make, "individual long, photo string, spot_id int, x double, y double, t double, embedding array<double>")
