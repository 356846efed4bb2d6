"""Scoring of photos against pools of spots by any scorer.

A pool is all that is known of an individual, spread over photos. A scorer says what a part of a pool tells a query vector,
how parts are merged (the greatest or the sum, number by number), and what the merged numbers of all vectors of a photo make
of the pool. Parts are photos, and photos too large for a block are cut further, so a pool of any size need not be in one task,
and a query's own photo is left out of its individual's pool by leaving out that part.

A scorer sees many parts at once (similarities of a block of query vectors to all rows of a block, with the first row of
each part), and many pools at once: their numbers lie one after another, with offsets, as in an Arrow list column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .pairs import BATCH, BLOCK, _blocks, _columns, _dealt


class Scorer(Protocol):
    #: "max" or "sum": how the numbers of parts become those of the pool.
    merge: str
    #: How many numbers a query vector has for a part.
    width: int

    def part(self, similarities: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """[vector, part, number] from [vector, row] similarities; part k begins at row starts[k]."""

    def pool(self, numbers: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A score for each pool: rows offsets[k] to offsets[k + 1] of `numbers` are those of the query's vectors; sizes are of the pools."""


class SoftChamfer:
    """The mean of each vector's greatest similarity."""

    merge, width = "max", 1

    def part(self, similarities, starts):
        return np.maximum.reduceat(similarities, starts, axis=1)[:, :, None]

    def pool(self, numbers, offsets, sizes):
        return np.add.reduceat(numbers[:, 0], offsets[:-1]) / np.diff(offsets)


class SoftDensity:
    """How densely a pool lies around the vectors: the mean of log(mean of exp((similarity - 1) / heat)), less sensitive to a single near spot."""

    merge, width = "sum", 1

    def __init__(self, heat: float = 0.1):
        self.heat = heat

    def part(self, similarities, starts):
        return np.add.reduceat(np.exp((similarities - 1) / self.heat), starts, axis=1)[:, :, None]

    def pool(self, numbers, offsets, sizes):
        each = np.log(numbers[:, 0] / np.repeat(sizes, np.diff(offsets)))
        return np.add.reduceat(each, offsets[:-1]) / np.diff(offsets)


def pooled(spots: DataFrame, scorer: Scorer, block: int = BLOCK) -> DataFrame:
    """(photo, owner, score, size): each photo against the pool of each owner, its own photo left out.

    `spots` holds (id, grp, owner, e), grp being the photo; rows without photo, owner or vector take no part. A photo stands in
    one block if it fits, else it is a part for each of several blocks. A task merges the photos of an owner that it holds, so
    that its rows go with owners. Owners without another photo have no row for that photo.
    """
    spots = spots.where("grp IS NOT NULL AND owner IS NOT NULL AND e IS NOT NULL")
    total = spots.count()
    blocks = _blocks(total, block)
    width = -(-max(total, 1) // blocks)
    each = spots.select(*(F.col(c).alias(c) for c in ("id", "grp", "e")))
    other = spots.select(*(F.col(c).alias(c) for c in ("id", "grp", "owner", "e")))
    cuts = spots.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / width).alias("cuts"))
    place = F.xxhash64("grp") % blocks + F.pmod(F.xxhash64("id"), "cuts")
    q = _dealt(each, F.col("id"), "i", "j", blocks, blocks)
    g = other.join(cuts, "grp").select("id", "grp", "owner", "e", F.pmod(place, F.lit(blocks)).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
    numbers = [f"v{k}" for k in range(scorer.width)]
    owner_type = to_arrow_type(spots.schema["owner"].dataType)
    merged, nothing = {"max": (np.maximum, -np.inf), "sum": (np.add, 0.0)}[scorer.merge]

    def solve(left, right):
        out = []
        owners = right.column("owner").combine_chunks().dictionary_encode()
        if left.num_rows and right.num_rows:
            (x, ids, groups), (y, _, photos), of = _columns(left), _columns(right), owners.indices.to_numpy()
            names, photos = np.unique(photos, return_inverse=True)
            order = np.lexsort((photos, of))
            y, photos, of = y[order], photos[order], of[order]
            starts = np.r_[0, np.flatnonzero(np.diff(photos) | np.diff(of)) + 1]
            sizes, part_photo, part_of = np.diff(np.r_[starts, len(of)]), names[photos[starts]], of[starts]
            first = np.r_[0, np.flatnonzero(np.diff(part_of)) + 1]
            for lo in range(0, len(x), step := max(16, min(BATCH, BATCH * BLOCK // len(y)))):
                told = scorer.part(x[lo : lo + step] @ y.T, starts)
                own = groups[lo : lo + step, None] == part_photo[None]
                told[own] = nothing
                told, size = merged.reduceat(told, first, axis=1), np.add.reduceat(np.where(own, 0, sizes[None]), first, axis=1)
                r, k = np.nonzero(size)
                out.append((ids[lo + r], groups[lo + r], part_of[first][k], told[r, k], size[r, k]))
        ids, own, code, told, sizes = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, object), np.zeros(0, int), np.zeros((0, scorer.width)), np.zeros(0, int))
        columns = [pa.array(ids, pa.int64()), pa.array(own, pa.string()), owners.dictionary.take(pa.array(code, pa.int32())).cast(owner_type), *(pa.array(told[:, k], pa.float64()) for k in range(scorer.width)), pa.array(sizes, pa.int64())]
        return pa.table(columns, names=["q", "photo", "owner", *numbers, "size"])

    kind = spots.schema["owner"].dataType.simpleString()
    told = q.groupBy("i", "j").cogroup(g.groupBy("i", "j")).applyInArrow(solve, f"q long, photo string, owner {kind}, {', '.join(f'{n} double' for n in numbers)}, size long")
    merge = {"max": F.max, "sum": F.sum}[scorer.merge]
    whole = told.groupBy("q", "photo", "owner").agg(*(merge(n).alias(n) for n in numbers), F.sum("size").alias("size"))
    pools = whole.groupBy("photo", "owner").agg(F.collect_list(F.array(*numbers)).alias("numbers"), F.max("size").alias("size"))  # the vectors of a photo

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.schema.get_field_index("numbers"))
                sizes = batch.column(batch.schema.get_field_index("size"))
                offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
                values = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, scorer.width)
                scores = scorer.pool(values, offsets, sizes.to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), sizes], ["photo", "owner", "score", "size"])

    return pools.mapInArrow(finish, f"photo string, owner {kind}, score double, size long")
