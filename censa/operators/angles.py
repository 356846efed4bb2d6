"""Pairs of vectors at or above a cosine, pruned by angles and complete.

The angle between vectors is a metric, so a pair at the cutoff lies within rho = acos(cutoff). Vectors are dealt to cells of
their nearest pivot, and those that are near none to a cell of the rest. A vector also visits another cell if the triangle
inequality leaves room for a partner there: its angle to that cell's pivot exceeds the angle to its own by at most 2 rho, and
lies within rho of the range of angles that the cell's own vectors have. A cell that is too large is split by pivots of its
own, in rounds, all cells at once. A cell that pivots do not part (its vectors are all alike, or all at right angles) is cut
by hash, and its chunks meet in pairs.

Within a task a product over the leading principal axes, with the norms of what is left, bounds the cosine from above; only
pairs whose bound reaches the cutoff are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources.sinks import discard, written

#: Rows of a cell or chunk, at most.
BLOCK = 4000
#: Cells that one is split into, at most: one for each pivot and the rest. Pivots are twice the square root of the rows.
WAYS = 2048
#: Rows that pivots are chosen from, for each pivot.
SAMPLE = 4
#: Rounds of splitting; cell numbers stay within a long.
ROUNDS = 4
#: Cells begin as this plus the number of components, so that no two levels of splitting share numbers.
ROOT = 1 << 15
#: Room for rounding, in radians and in cosine.
ROOM = 1e-6
#: A cell is split if at most this share of its pairs remains, as its sample says.
WORTH = 0.7


def unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def pivots_of(x: np.ndarray, most: int, least: float) -> np.ndarray:
    """Rows of x that lie far from each other: each next one is the farthest from those before, while that is above `least`."""
    chosen, near = [0], angles(x, x[:1])[:, 0]
    while len(chosen) < most and near.max() > least:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(x, x[chosen[-1:]])[:, 0])
    return np.array(chosen)


def own_cell(a: np.ndarray, reach: float) -> np.ndarray:
    """The cell of each row, from its angles to the pivots: that of the nearest one, or beyond `reach` that of the rest."""
    return np.where(a.min(1) <= reach, a.argmin(1), a.shape[1])


def visited(a: np.ndarray, reach: float, rho: float) -> np.ndarray:
    """[row, cell] which cells may hold partners within rho; the last one is that of the rest."""
    nearest = a.min(1)[:, None]
    near = (a <= nearest + 2 * rho + ROOM) & (a <= reach + rho + ROOM)
    # What is not within reach of any pivot is beyond it as seen from the row's nearest one, too.
    return np.concatenate([near, nearest > reach - rho - ROOM], 1)


def best_reach(a: np.ndarray, rho: float) -> tuple[float, float, float]:
    """(reach, share of pairs that remain, cells that a row is dealt to) of the best of several reaches, for rows with these angles."""
    found = []
    for reach in (*np.quantile(a.min(1), np.linspace(0.05, 1, 20)) + ROOM, math.pi):
        own = own_cell(a, reach)
        visits = visited(a, reach, rho) & (np.arange(a.shape[1] + 1) <= own[:, None])
        share = np.bincount(own, minlength=a.shape[1] + 1) / len(a)
        found.append((float((visits @ share).mean()), float(visits.sum(1).mean()), float(reach)))
    left, copies, reach = min(found)
    return reach, left, copies


def _judged(rho: float, block: int):
    """Of each cell, from its sample: its pivots and their reach, or none if splitting is not worth it."""

    def run(key, part):
        x, rows = unit(part.column("e")), part.column("rows")[0].as_py()
        chosen, reach = pivots_of(x, part.column("pivots")[0].as_py(), rho / 4), 0.0
        others = np.setdiff1d(np.arange(len(x)), chosen)
        worth = len(chosen) > 1 and len(others) > 0
        if worth:
            # A row meets each pair of its own cell twice, as either end.
            reach, left, copies = best_reach(angles(x[others], x[chosen]), rho)
            worth = left <= WORTH and copies <= max(4.0, rows / block)
        chosen = chosen if worth else chosen[:0]
        columns = [pa.array([v] * len(chosen), t) for v, t in ((key[0].as_py(), pa.int64()), (reach, pa.float64()))]
        return pa.table([*columns, part.column("e").combine_chunks().take(pa.array(chosen, pa.int64()))], names=["cell", "reach", "e"])

    return run


def _assigned(rho: float):
    """Rows come by cell and salt, pivots first; each row goes to its own cell and to those that it has to visit."""

    def dealt(part: pa.Table, cell: int, pivots: np.ndarray, reach: float) -> pa.RecordBatch:
        a = angles(unit(part.column("e")), pivots)
        own, visits, home = own_cell(a, reach), visited(a, reach, rho), _numbers(part.column("home"))
        # Two vectors of a cell that is split meet in the first of their cells; a visitor stays one.
        visits &= ~home[:, None] | (np.arange(len(pivots) + 1) < own[:, None])
        visits[home, own[home]] = True
        r, c = np.nonzero(visits)
        far = np.concatenate([a, np.zeros((len(a), 1))], 1)[r, c]
        some = part.take(pa.array(r))
        return pa.RecordBatch.from_arrays([pa.array(cell * WAYS + c), pa.array(home[r] & (c == own[r])), *(some.column(n).combine_chunks() for n in ("id", "grp", "e")), pa.array(far)], ["cell", "home", "id", "grp", "e", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, pivots, reach = None, [], None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            key = np.stack([_numbers(rows.column(n)).astype(np.int64) for n in ("cell", "salt", "kind")], 1)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                (*place, kind), part = key[i].tolist(), rows.slice(i, j - i)
                if place != at:
                    at, held, pivots = place, [], None
                if kind == 0:
                    held.append(unit(part.column("e")))
                    reach = part.column("reach")[0].as_py()
                    continue
                pivots = np.concatenate(held) if pivots is None else pivots
                for k in range(0, part.num_rows, 1024):
                    yield dealt(part.slice(k, 1024), place[0], pivots, reach)

    return run


def _by_cell(state: DataFrame) -> DataFrame:
    return state.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.count_if("home").alias("own"))


def _split(state: DataFrame, sizes: DataFrame, rho: float, block: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Of a state (cell, home, id, grp, e) the cells that stay, and those that came of splitting, with the angle to the pivot."""
    pivots = F.least(F.lit(WAYS - 1), F.ceil(2 * F.sqrt("rows"))).cast("int").alias("pivots")
    large = state.where("home").join(sizes.where(F.col("rows") > block).select("cell", "rows", pivots), "cell")
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cell", "id"), "id"))
    # At most SAMPLE * WAYS rows of a cell; the first bound is a constant, so that tasks drop rows before they are shuffled.
    sample = large.withColumn("_k", place).where(F.col("_k") <= SAMPLE * WAYS).where(F.col("_k") <= SAMPLE * F.col("pivots"))
    chosen = written(sample.select("cell", "rows", "pivots", "e").groupBy("cell").applyInArrow(_judged(rho, block), f"cell long, reach double, e {kind}"))
    salts = F.ceil(F.col("rows") / (16 * block)).cast("int").alias("salts")
    parted = sizes.join(chosen.select("cell").distinct(), "cell").select("cell", salts)
    stays = state.join(parted.select("cell"), "cell", "left_anti")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    first = chosen.join(parted, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), none("home", "boolean"), none("id", "bigint"), none("grp", "string"), "e", "reach")
    rows = state.join(parted, "cell").select("cell", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "home", "id", "grp", "e", none("reach", "double"))
    key = ("cell", "salt", "kind")
    # The order of pivots numbers the cells, so all salts of a cell must see them in the same one.
    dealt = first.unionByName(rows).repartition("cell", "salt").sortWithinPartitions(*key, F.when(F.col("kind") == 0, F.col("e")))
    return stays, written(dealt.mapInArrow(_assigned(rho), f"cell long, home boolean, id long, grp string, e {kind}, far double"))


def _in_reach(new: DataFrame, rho: float) -> DataFrame:
    """Without the visitors that lie beyond the range of a cell's own vectors; a cell without own vectors has no range."""
    ranges = new.where("home").groupBy("cell").agg(F.min("far").alias("_low"), F.max("far").alias("_high"))
    room = rho + ROOM
    inside = F.col("home") | ((F.col("far") >= F.col("_low") - room) & (F.col("far") <= F.col("_high") + room))
    return new.join(ranges, "cell").where(inside).select("cell", "home", "id", "grp", "e")


def cells(rows: DataFrame, cutoff: float, block: int = BLOCK) -> DataFrame:
    """(cell, home, id, grp, e): rows (id, grp, e) in cells; each pair at the cutoff is in one cell, one of the two being home.

    Every row is home in one cell and may visit others. Cells are split while they are above `block` and pivots part them.
    """
    element = rows.schema["e"].dataType
    kind = f"array<{'float' if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else 'double'}>"
    fine = rows.where("e IS NOT NULL AND id IS NOT NULL")
    state = fine.select((F.size("e") + F.lit(ROOT).cast("long")).alias("cell"), F.lit(True).alias("home"), "id", F.col("grp").cast("string").alias("grp"), F.col("e").cast(kind).alias("e"))
    if cutoff <= 0:
        return state
    rho, done = math.acos(min(cutoff, 1.0)), None
    for _ in range(ROUNDS):
        sizes = written(_by_cell(state))
        if sizes.where(F.col("rows") > block).isEmpty():
            break
        stays, new = _split(state, sizes, rho, block, kind)
        done = stays if done is None else done.unionByName(stays)
        state = written(_in_reach(new, rho))
        discard(new)
        if state.isEmpty():
            break
    return state if done is None else done.unionByName(state)


def parts(state: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds (i, j): the cells' rows in groups of about 2 * `block` at most, in which all pairs of a cell meet once.

    A cell of at most `block` rows is the group (0, 0). Of a larger one, chunks of own rows meet in pairs i <= j, and a chunk
    of own rows meets one of visitors in j < 0.
    """
    sizes = written(_by_cell(state))
    many = lambda c: F.ceil(F.col(c) / block).cast("int")
    small = F.col("rows") <= block
    sizes = sizes.select("cell", F.when(small, 1).otherwise(many("own")).alias("_own"), F.when(small, 0).otherwise(F.ceil((F.col("rows") - F.col("own")) / block).cast("int")).alias("_other"))
    chunk = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = chunk(F.col("_own"))
    with_own = F.transform(upto(F.col("_own")), lambda x: pair(F.least(own, x), F.greatest(own, x)))
    with_others = F.transform(upto(F.col("_other")), lambda x: pair(own, -1 - x))
    visitor = F.when(F.col("_other") == 0, F.array(pair(F.lit(0), F.lit(0)))).otherwise(F.transform(upto(F.col("_own")), lambda x: pair(x, -1 - chunk(F.greatest("_other", F.lit(1))))))
    met = F.when(F.col("home"), F.concat(with_own, with_others)).otherwise(visitor)
    rows = state.join(sizes, "cell").withColumn("chunk", F.when(F.col("home"), own).otherwise(-1))
    return rows.select("*", F.explode(met).alias("m")).select("cell", "m.i", "m.j", "home", "chunk", "id", "grp", "e")


class Bounded(NamedTuple):
    """Unit vectors on principal axes: the leading ones, and the norm of what is left."""

    whole: np.ndarray
    lead: np.ndarray
    rest: np.ndarray


def on_axes(*sides: np.ndarray, share: float = 0.25) -> list[Bounded]:
    """Both sides on the principal axes of all rows, in order of falling weight; the first quarter leads."""
    x = np.concatenate(sides)
    _, axes = np.linalg.eigh(x.T @ x)
    k = max(1, int(share * x.shape[1]))
    turned = [s @ axes[:, ::-1] for s in sides]
    return [Bounded(t, t[:, :k], np.linalg.norm(t[:, k:], axis=1)) for t in turned]


def reaching(x: Bounded, y: Bounded, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows of x, rows of y, cosines) at or above the cutoff, and how many pairs were compared in full."""
    may = x.lead @ y.lead.T + x.rest[:, None] * y.rest[None] >= cutoff - ROOM
    n = int(may.sum())
    if 4 * n > may.size:
        s = x.whole @ y.whole.T
        a, b = np.nonzero(s >= cutoff)
        return a, b, s[a, b], may.size
    a, b = np.nonzero(may)
    s = np.concatenate([np.einsum("ij,ij->i", x.whole[a[k : k + 65536]], y.whole[b[k : k + 65536]]) for k in range(0, n, 65536)] or [np.zeros(0)])
    keep = s >= cutoff
    return a[keep], b[keep], s[keep], n


def _compared(cutoff: float, distinct: bool, most: int | None, per_group: bool):
    """The pairs of a part, as `pairs_above` says."""

    def first(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if most is None or len(found["a"]) <= most:
            return found
        order = np.lexsort((found["b"], found["a"], -found["sim"]))
        if per_group:
            _, pair = np.unique(np.char.add(np.char.add(found["group_a"].astype(str), "\0"), found["group_b"].astype(str)), return_inverse=True)
            order = order[np.argsort(pair[order], kind="stable")]
            sorted_pair = pair[order]
            begins = np.r_[0, np.flatnonzero(np.diff(sorted_pair)) + 1]
            place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
            order = order[place < most]
        else:
            order = order[:most]
        return {n: v[order] for n, v in found.items()}

    def run(part):
        i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        home, chunk, ids, groups = (_numbers(part.column(n)) for n in ("home", "chunk", "id", "grp"))
        left = np.flatnonzero(home & (chunk == i))
        # In the part of a chunk with itself its rows meet each other and the visitors; elsewhere two chunks meet.
        right = np.arange(len(home)) if i == j else np.flatnonzero(home & (chunk == j) if j > 0 else ~home)
        names, types = ["a", "b", "sim", "group_a", "group_b"], [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.string()]
        names, found, full = names if per_group else names[:3], [], 0
        if len(left) and len(right):
            x = unit(part.column("e"))
            a_side, b_side = on_axes(x[left], x[right])
            for lo in range(0, len(left), 512):
                a, b, s, n = reaching(Bounded(*(v[lo : lo + 512] for v in a_side)), b_side, cutoff)
                full += n
                a, b = left[a + lo], right[b]
                keep = np.where(home[b] & (i == j), ids[a] < ids[b], ids[a] != ids[b])
                if distinct:
                    keep &= groups[a] != groups[b]
                a, b, s = a[keep], b[keep], s[keep]
                swap = groups[a] > groups[b] if per_group else ids[a] > ids[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                found.append(first({"a": ids[a], "b": ids[b], "sim": s} | ({"group_a": groups[a], "group_b": groups[b]} if per_group else {})))
        whole = first({n: np.concatenate([f[n] for f in found]) if found else np.zeros(0, object) for n in names})
        columns = [pa.concat_arrays([pa.array(whole[n], t), pa.nulls(1, t)]) for n, t in zip(names, types, strict=False)]
        told = [pa.array([None] * len(whole["a"]) + [int(v)], pa.int64()) for v in (len(left) * len(right), full)]
        return pa.table([*columns, *told], names=[*names, "met", "full"])

    return run


def compared(vectors: DataFrame, cutoff: float, id_: str, group: str | None = None, block: int = BLOCK, most: int | None = None, per_group: bool = False) -> DataFrame:
    """The pairs that `pairs_above` gives, and a row for each part: how many pairs met there, and how many were compared in full."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(group or id_).cast("string").alias("grp"), F.col("embedding").alias("e"))
    if per_group:
        rows = rows.where("grp IS NOT NULL")
    fields = f"a long, b long, sim double{', group_a string, group_b string' if per_group else ''}, met long, full long"
    dealt = parts(cells(rows, cutoff, block), block)
    return dealt.groupBy("cell", "i", "j").applyInArrow(_compared(cutoff, group is not None, most, per_group), fields)


def pairs_above(vectors: DataFrame, cutoff: float, id_: str = "spot_id", group: str | None = None, block: int = BLOCK, most: int | None = None, per_group: bool = False) -> DataFrame:
    """(a, b, sim): unordered pairs with a < b and cosine at least `cutoff`; with `group`, not of the same group.

    Ids are whole numbers that do not repeat. Rows without id or vector have no pairs, and vectors of different lengths (at
    most 32,767) are not compared. With `most`, a part emits its first `most` pairs only, by falling similarity and ids; with
    `per_group` as well the first of each pair of groups, a being of the smaller group, and (group_a, group_b) follow; rows
    without a group are left out then. The first of all parts are still to be chosen. Spark jobs run while the plan is made.
    """
    return compared(vectors, cutoff, id_, group, block, most, per_group).where("met IS NULL").drop("met", "full")


def work(vectors: DataFrame, cutoff: float, id_: str = "spot_id", group: str | None = None, block: int = BLOCK) -> dict[str, int]:
    """What a join costs: rows dealt to parts, pairs that met in a task, pairs compared in full."""
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.lit("").alias("grp"), F.col("embedding").alias("e"))
    told = compared(vectors, cutoff, id_, group, block).agg(F.sum("met").alias("met"), F.sum("full").alias("full")).first()
    return {"rows": parts(cells(rows, cutoff, block), block).count(), "met": told.met or 0, "full": told.full or 0}
