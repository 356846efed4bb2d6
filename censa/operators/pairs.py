"""Similarity of sets of vectors.

Where each vector meets each group, both sides are dealt by hash into blocks of a bounded number of rows, and each pair of
blocks is one task group that emits the best of a group, never the product. A group is held as balls: some of its vectors
with those around them. The similarity to the balls' middles bounds a group's best from below, the angle to a middle less
the radius of its ball bounds what the ball holds from above, and only balls that may hold the best are compared in full.
Where only vectors that are each other's best count, two groups meet whole in one task, in tiles, and links alone leave it.
Any other function of two sets (photos) runs on a group that holds both. Pairs above a cutoff are in `angles`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .angles import ROOM, pivots_of, unit

BLOCK = 4000
#: Larger tables have no more than this many blocks until a block is `WIDER` times as large, since each row is sent to every block of the other side.
BLOCKS = 8
WIDER = 8
#: Similarities this near to each other are equal; the smaller id counts.
SAME = 1e-12
BATCH = 512
#: Rows of a group that stand together where groups meet on lines, at most; a task holds about twice as many.
WHOLE = 65_536
#: Cells of a side for tables above a block, at least; groups that are dealt to cells one by one, besides those above a block.
SIDE = 5
PLACED = 1000
#: Rows and columns of a product; how far a product in single precision may be from the right one, for each number of a unit vector.
TILE = 512
NARROW = 2.0**-23


def _dealt(df: DataFrame, key: Column, own: str, other: str, mine: int, others: int) -> DataFrame:
    """Rows with their own block, repeated for each block of the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _blocks(n: int, block: int) -> int:
    """How many blocks a table has: of `block` rows each, then of up to `WIDER` times as many."""
    return max(1, min(-(-n // block), max(BLOCKS, -(-n // (block * WIDER)))))


def _batch(balls: Balls) -> int:
    """Queries whose similarities to all rows of a block are held at once."""
    return max(16, min(BATCH, BATCH * BLOCK // max(1, len(balls.x))))


def _large(sides: DataFrame, block: int) -> DataFrame:
    """The groups that are larger than a block."""
    return sides.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("grp")


class Balls:
    """Vectors of several groups in balls: rows by group and ball, and the middle and radius of each ball."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, groups: np.ndarray):
        self.names, of = np.unique(groups, return_inverse=True)
        order, ball, middles, radius = [], [], [], []
        for g in range(len(self.names)):
            rows = np.flatnonzero(of == g)
            own = x[rows]
            chosen = pivots_of(own, max(1, int(np.sqrt(len(rows)))), 0.0)
            a = np.arccos(np.clip(own @ own[chosen].T, -1, 1))
            # Of equal middles only one is nearest to any row.
            used, near = np.unique(a.argmin(1), return_inverse=True)
            by = np.argsort(near, kind="stable")
            order.append(rows[by]), ball.append(near[by] + len(middles))
            middles.extend(own[chosen[used]])
            radius.extend(np.maximum.reduceat(a.min(1)[by], np.searchsorted(near[by], np.arange(len(used)))))
        order, self.ball = np.concatenate(order), np.concatenate(ball)
        self.x, self.ids, self.group = x[order], ids[order], of[order]
        self.middles, self.radius = np.array(middles), np.array(radius)
        self.first = np.r_[0, np.flatnonzero(np.diff(self.ball)) + 1]
        self.end = np.r_[self.first[1:], len(order)]
        self.ball_group = self.group[self.first]
        self.group_first = np.r_[0, np.flatnonzero(np.diff(self.group)) + 1]
        self.group_ball = np.r_[0, np.flatnonzero(np.diff(self.ball_group)) + 1]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[self.by_id] = np.arange(len(order))

    def similarities(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([query, row] similarities, -2 where a row cannot be its group's best; [query, group] vectors compared)."""
        to = q @ self.middles.T
        best = np.maximum.reduceat(to, self.group_ball, axis=1)
        above = np.cos(np.maximum(np.arccos(np.clip(to, -1, 1)) - self.radius, 0)) + ROOM
        may = (above >= best[:, self.ball_group]) & (self.end - self.first > 1)
        size = self.end - self.first
        if (may @ size).sum() > len(q) * len(self.x) / 2:
            return q @ self.x.T, np.broadcast_to(np.diff(np.r_[self.group_first, len(self.x)]), (len(q), len(self.names)))
        s = np.full((len(q), len(self.x)), -2.0)
        for b in np.flatnonzero(may.any(0)):
            rows = np.flatnonzero(may[:, b])
            s[rows, self.first[b] : self.end[b]] = q[rows] @ self.x[self.first[b] : self.end[b]].T
        alone = np.flatnonzero(size == 1)
        s[:, self.first[alone]] = to[:, alone]
        return s, np.add.reduceat(may * size, self.group_ball, axis=1) + np.diff(np.r_[self.group_ball, len(size)])

    def best(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, group] greatest similarity, and the row that has it, of equals that of the least id."""
        top = np.maximum.reduceat(s, self.group_first, axis=1)
        at = np.where(s >= top[:, self.group] - SAME, self.place[None], len(self.ids))
        return top, self.by_id[np.minimum.reduceat(at, self.group_first, axis=1)]


def _columns(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors, ids, groups) of rows (id, grp, e)."""
    return unit(part.column("e")), part.column("id").to_numpy(), part.column("grp").to_numpy()


def _table(names: list[str], types: list[pa.DataType], parts: list[tuple]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [(np.zeros(0, object),)] * len(names)
    return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def best_in_groups(queries: DataFrame, gallery: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, q_group, g_group, sim, g, compared): for each query vector and each other group its most similar vector.

    Of equals the least id counts; `compared` is the number of the group's vectors that were looked at. Both sides hold
    (id, grp, e); rows without group or vector take no part. A group of the gallery stands in one block, so that nothing is
    merged afterwards; groups larger than a block are dealt by id, and the best of their parts is taken.
    """
    queries, gallery = (x.where("grp IS NOT NULL AND e IS NOT NULL") for x in (queries, gallery))
    large = _large(gallery, block)
    if large.isEmpty():
        return _best(queries, gallery, "grp", block)
    whole = _best(queries, gallery.join(large, "grp", "left_anti").select("id", "grp", "e"), "grp", block)
    parts = _best(queries, gallery.join(large, "grp", "left_semi").select("id", "grp", "e"), "id", block)
    # As in a block, similarities that are nearly equal are equal.
    top = parts.groupBy("q", "q_group", "g_group").agg(F.max("sim").alias("sim"), F.collect_list(F.struct("g", F.col("sim").alias("s"))).alias("tops"), F.sum("compared").alias("compared"))  # one entry for each block
    least = F.array_min(F.transform(F.filter("tops", lambda t: t["s"] >= F.col("sim") - SAME), lambda t: t["g"]))
    return whole.unionByName(top.select("q", "q_group", "g_group", "sim", least.alias("g"), "compared"))


_BEST = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]


def _best_of_blocks(left: pa.Table, right: pa.Table) -> pa.Table:
    """The best of each group of `right` for each vector of `left`."""
    # Batches become Arrow tables at once, so that a block's rows are held once, without objects.
    names = ["q", "q_group", "g_group", "sim", "g", "compared"]
    out = [_table(names, _BEST, [])]
    if left.num_rows and right.num_rows:
        x, ids, groups = _columns(left)
        balls = Balls(*_columns(right))
        for lo in range(0, len(x), step := _batch(balls)):
            s, compared = balls.similarities(x[lo : lo + step])
            top, row = balls.best(s)
            i, k = np.nonzero(groups[lo : lo + step, None] != balls.names[None])
            out.append(_table(names, _BEST, [(ids[lo + i], groups[lo + i], balls.names[k], top[i, k], balls.ids[row[i, k]], compared[i, k])]))
    return pa.concat_tables(out)


def _best(queries: DataFrame, gallery: DataFrame, key: str, block: int) -> DataFrame:
    """The best of each group, or of each part of it, with the gallery dealt into blocks by a column."""
    nq, ng = (_blocks(x.count(), block) for x in (queries, gallery))
    # Columns of their own, as both sides may come from one table.
    queries, gallery = (x.select(*(F.col(c).alias(c) for c in ("id", "grp", "e"))) for x in (queries, gallery))
    q = _dealt(queries, F.col("id"), "i", "j", nq, ng)
    g = _dealt(gallery, F.col(key), "j", "i", ng, nq)

    return q.groupBy("i", "j").cogroup(g.groupBy("i", "j")).applyInArrow(_best_of_blocks, "q long, q_group string, g_group string, sim double, g long, compared long")


def soft_chamfer(best: DataFrame, owner: DataFrame) -> DataFrame:
    """(q_group, owner, g_group, sim): mean of the best similarities for each photo, and each owner's best photo.

    `owner` maps (g_group, owner). Photos without vectors never appear; equal photos go to the smaller name.
    """
    means = best.groupBy("q_group", "g_group").agg(F.avg("sim").alias("sim")).join(owner, "g_group")
    order = Window.partitionBy("q_group", "owner").orderBy(F.col("sim").desc(), "g_group")
    return means.withColumn("k", F.row_number().over(order)).where("k = 1").select("q_group", "owner", "g_group", "sim")


def mutual_in_groups(sides: DataFrame, block: int = WHOLE) -> DataFrame:
    """(q_group, g_group, q, g, sim): vectors of two groups that are each other's best, the least id of equals; q_group < g_group.

    Groups stand in q x q cells of a square, q a prime, and each line of it is a task: any two cells are on one line, so every two
    groups meet once, a row is sent to q + 1 lines, and a task holds a q-th of the rows. q grows until that is twice `block`.
    Groups larger than a block are dealt to cells by id; of those the best of each part leaves the task, and the best of
    these is taken. Other groups leave the task as mutual links. Rows without group or vector take no part.
    """
    sides = sides.where("grp IS NOT NULL AND e IS NOT NULL").select("id", "grp", "e")
    sizes = sides.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    n = sizes.agg(F.sum("n")).first()[0] or 0
    q = _prime(max(-(-n // (2 * block)), SIDE if n > BLOCK else 1))
    placed, split = _cells(sizes, n, q, block)
    rows = sides.withColumns({"part": F.lit(0), "cell": F.pmod(F.xxhash64("grp"), F.lit(q * q)).cast("int"), "parts": F.lit(1)})
    if placed is not None:
        rows = sides.join(F.broadcast(placed), "grp", "left")  # `_cells` bounds it
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rows = rows.withColumn("cell", F.coalesce(F.try_element_at("cells", F.col("part") + 1), F.pmod(F.xxhash64("grp"), F.lit(q * q)).cast("int")))
    lines = F.explode(_lines(F.floor(F.col("cell") / q), F.col("cell") % q, q)) if q > 1 else F.lit(0)
    rows = rows.select(lines.alias("line"), "cell", "part", (F.col("parts") > 1).alias("split"), "id", "grp", "e")
    if q > 1:
        # Lines are few and long, so their number of tasks does not follow their bytes.
        rows = rows.repartition(max(int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * q * (q + 1)), "line")
    out = rows.groupBy("line").applyInArrow(lambda part: _met_in_groups(part, q, split), "q_group string, g_group string, q long, g long, sim double")
    if not split:
        return out
    top = out.groupBy("q_group", "g_group", "q").agg(F.max("sim").alias("sim"), F.collect_list(F.struct("g", F.col("sim").alias("s"))).alias("tops"))  # one entry for each part
    best = top.withColumn("g", F.array_min(F.transform(F.filter("tops", lambda t: t["s"] >= F.col("sim") - SAME), lambda t: t["g"])))
    turn = F.col("q_group") > F.col("g_group")
    ends = (F.least("q_group", "g_group").alias("q_group"), F.greatest("q_group", "g_group").alias("g_group"), F.when(turn, F.col("g")).otherwise(F.col("q")).alias("q"), F.when(turn, F.col("q")).otherwise(F.col("g")).alias("g"))
    links = best.select(*ends, turn.alias("turn"), "sim").groupBy("q_group", "g_group", "q", "g").agg(F.count_if("turn").alias("back"), F.count_if(~F.col("turn")).alias("forth"), F.max("sim").alias("sim"))
    return links.where("back > 0 AND forth > 0").select("q_group", "g_group", "q", "g", "sim")


def _prime(least: int) -> int:
    """The least prime from there on; 1 of 1."""
    while any(least % k == 0 for k in range(2, int(least**0.5) + 1)):
        least += 1
    return max(1, least)


def _lines(x: Column, y: Column, q: int) -> Column:
    """The lines through a cell: one of each slope, from 0, and the upright one."""
    return F.array(*(at.cast("int") for at in (*(m * q + F.pmod(y - m * x, F.lit(q)) for m in range(q)), q * q + x)))


def _cells(sizes: DataFrame, n: int, q: int, block: int) -> tuple[DataFrame | None, bool]:
    """((grp, parts, cells) of the groups that are too large to be dealt by hash, whether any has several parts).

    The largest come first, each to the cell whose lines hold least. They are all groups above a block, and up to `PLACED` others.
    """
    large = sizes.where(F.col("n") > min(block, n / (8 * q * q))).orderBy(F.desc("n"), "grp").limit(PLACED + n // block).collect() if q > 1 else []
    if not large:
        return None, False
    x, y = np.divmod(np.arange(q * q), q)
    through = np.stack([*(m * q + (y - m * x) % q for m in range(q)), q * q + x], 1)
    held, out = np.zeros(q * q + q), []
    for grp, size in large:
        parts = -(-size // block)
        cells = []
        for _ in range(parts):
            cells.append(int(held[through].sum(1).argmin()))
            held[through[cells[-1]]] += size / parts
        out.append((grp, parts, cells))
    return sizes.sparkSession.createDataFrame(out, "grp string, parts int, cells array<int>"), any(parts > 1 for _, parts, _ in out)


class _Slab(NamedTuple):
    """Rows lo to hi of a task, which are whole units (parts of groups) from number `unit` on, with the units' first rows; a large unit is alone."""

    lo: int
    hi: int
    unit: int
    first: np.ndarray


def _slabs(first: np.ndarray, end: int) -> list[_Slab]:
    """Slabs of units that begin at these rows: of at most `TILE` rows, or of one unit."""
    bounds, out, u = np.r_[first, end], [], 0
    while u < len(first):
        v = max(u + 1, int(np.searchsorted(bounds, bounds[u] + TILE, "right")) - 1)
        out.append(_Slab(int(bounds[u]), int(bounds[v]), u, first[u:v] - bounds[u]))
        u = v
    return out


def _tops(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[row, unit] the greatest of each unit's columns, and the first column that is as great."""
    if len(first) == 1:
        top = s.max(1, keepdims=True)
        return top, (s >= top - SAME).argmax(1)[:, None]
    top = np.maximum.reduceat(s, first, axis=1)
    near = s >= np.repeat(top, np.diff(np.r_[first, s.shape[1]]), axis=1) - SAME
    return top, np.minimum.reduceat(np.where(near, np.arange(s.shape[1]), s.shape[1] - 1), first, axis=1)


def _best_of_slabs(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, finite: bool) -> tuple[np.ndarray, np.ndarray]:
    """([row of x, unit of y] the row of y that is the unit's best, the same from y).

    Tiles of single precision tell which rows may find a better one in them, and only for those the tile is computed again. Rows of a
    unit are in the order of their ids, so of equals the first one has the least. Similarities that are no number come first.
    """
    best = [(np.full((len(a), len(of)), -np.inf), np.full((len(a), len(of)), -1)) for a, of in ((x, of_y), (y, of_x))]
    room = (x.shape[1] + 4) * NARROW
    tiles = lambda a, of: range(0, len(a), TILE if len(of) == 1 else max(1, len(a)))
    narrow = [a.astype(np.float32) for a in (x, y)] if finite and max(len(x), len(y)) > TILE else None
    for i in tiles(x, of_x):
        p = slice(i, i + tiles(x, of_x).step)
        for j in tiles(y, of_y):
            r = slice(j, j + tiles(y, of_y).step)
            s = narrow and narrow[0][p] @ narrow[1][r].T
            for k, (a, b, own, other, of) in enumerate(((x, y, p, r, of_y), (y, x, r, p, of_x))):
                top, at = (z[own] for z in best[k])
                may = np.arange(len(top)) if s is None or other.start == 0 else np.flatnonzero(s.max(1 - k) >= top[:, 0] - room)
                if len(may):
                    exact = a[own][may] @ b[other].T
                    if not finite:
                        exact[np.isnan(exact)] = np.inf
                    new, row = _tops(exact, of)
                    at[may] = np.where(top[may] >= new - SAME, at[may], row + other.start)
                    top[may] = np.maximum(top[may], new)
    return best[0][1], best[1][1]


def _met_in_groups(part: pa.Table, q: int, directed: bool) -> pa.Table:
    """The mutual links of the groups on a line, or with `directed` each from both sides, and the best of each part of a group."""
    names, types = ["q_group", "g_group", "q", "g", "sim"], [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    line = part.column("line")[0].as_py()
    part = part.drop_columns("line").sort_by([(c, "ascending") for c in ("cell", "grp", "part", "id")])
    code = part.column("grp").combine_chunks().dictionary_encode()
    grp, group_names = code.indices.to_numpy(), np.array(code.dictionary.to_pylist(), object)
    cell, piece, halved, ids = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "part", "split", "id"))
    x = unit(part.column("e"))
    first = np.flatnonzero(np.r_[True, (np.diff(grp) != 0) | (np.diff(cell) != 0) | (np.diff(piece) != 0)])
    grp, cell, halved = grp[first], cell[first], halved[first]  # of each unit
    slabs, finite, out = _slabs(first, len(x)), bool(np.isfinite(x).all()), []

    def add(r: np.ndarray, of_r: np.ndarray, g: np.ndarray, of_g: np.ndarray) -> None:
        a, b = group_names[grp[of_r]], group_names[grp[of_g]]
        sim = np.concatenate([np.zeros(0), *((x[r[k : k + BLOCK]] * x[g[k : k + BLOCK]]).sum(1) for k in range(0, len(r), BLOCK))])
        if directed:
            out.append(_table(names, types, [(a, b, ids[r], ids[g], sim)]))
        else:
            turn = a > b
            out.append(_table(names, types, [(np.where(turn, b, a), np.where(turn, a, b), np.where(turn, ids[g], ids[r]), np.where(turn, ids[r], ids[g]), sim)]))

    for i, a in enumerate(slabs):
        for j, b in enumerate(slabs[i:]):
            u, v = np.arange(a.unit, a.unit + len(a.first)), np.arange(b.unit, b.unit + len(b.first))
            # Cells meet themselves on the line of slope 0.
            meet = (grp[u][:, None] != grp[v]) & ((cell[u][:, None] != cell[v]) | (line < q)) & ((u[:, None] < v) | (j > 0))
            if not meet.any():
                continue
            forth, back = _best_of_slabs(x[a.lo : a.hi], x[b.lo : b.hi], a.first, b.first, finite)
            of_a, of_b = (np.searchsorted(s.first, np.arange(s.hi - s.lo), "right") - 1 for s in (a, b))
            part_of = halved[u][:, None] | halved[v]
            r, k = np.nonzero(meet[of_a] & ~part_of[of_a])
            g = forth[r, k]
            r, k, g = (z[back[g, of_a[r]] == r] for z in (r, k, g))
            add(r + a.lo, u[of_a[r]], g + b.lo, v[k])
            if directed:
                add(g + b.lo, v[k], r + a.lo, u[of_a[r]])
                r, k = np.nonzero(meet[of_a] & part_of[of_a])
                add(r + a.lo, u[of_a[r]], forth[r, k] + b.lo, v[k])
                g, k = np.nonzero(meet.T[of_b] & part_of.T[of_b])
                add(g + b.lo, v[of_b[g]], back[g, k] + a.lo, u[k])
    return pa.concat_tables([_table(names, types, []), *out])


def _set(part: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    """The columns of a set in the order of the first; vectors are rows of a table, unknown ones zero."""
    part, out = part.sort_by(names[0]), {}
    for n in names:
        column = part.column(n).combine_chunks()
        if pa.types.is_list(column.type):
            known = column.is_valid().to_numpy(zero_copy_only=False)
            some = column.drop_null()
            values = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1) if len(some) else np.zeros((0, 1))
            out[n] = np.zeros((len(column), values.shape[1]))
            out[n][known] = values
        else:
            out[n] = column.to_numpy(zero_copy_only=False)
    return out


def over_pairs(pairs: DataFrame, rows: DataFrame, key: str, kernel: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """A kernel over pairs (a, b) of sets, whose members are `rows`; it gets both sets as dicts of arrays, ordered by the first column
    besides the key, and returns a dict of numbers, or of arrays for several rows.

    This is the interface for scorers: any function of two sets can stand in. A pair is a group of its own, so that a task holds the
    members of two sets at a time, and of those only the columns given.
    """
    names = [c for c in rows.columns if c != key]
    side = lambda k, p: rows.withColumnRenamed(key, p).join(pairs.select("a", "b"), p).select("a", "b", F.lit(k).alias("_side"), *names)
    fields = [f.strip().split() for f in schema.split(",")]

    def run(part: pa.Table) -> pa.Table:
        of = part.column("_side").to_numpy()
        a, b = (part.column(p)[0].as_py() for p in "ab")
        x, y = (part.filter(pa.array(of == k)) for k in (0, 1))
        found = kernel(_set(x, names), _set(y, names)) if x.num_rows and y.num_rows else {n: [] for n, _ in fields[2:]}
        found = {n: np.atleast_1d(v) for n, v in found.items()}
        size = len(next(iter(found.values())))
        return pa.table({"a": pa.array([a] * size, pa.string()), "b": pa.array([b] * size, pa.string())} | {n: pa.array(found[n], _KINDS[kind]) for n, kind in fields[2:]})

    spark = rows.sparkSession
    # Pairs are few and long, so their number of tasks does not follow their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return side(0, "a").unionByName(side(1, "b")).repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, schema)


_KINDS = {"long": pa.int64(), "double": pa.float64()}


def mean_vectors(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, mean): the mean vector of each group, by position."""
    rows = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean"))
