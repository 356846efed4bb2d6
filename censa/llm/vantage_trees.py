"""Nearest neighbours by vantage-point trees, one for each shard.

A tree over a bounded sample deals all vectors to shards: each goes down by its distances to the vantage points, and a shard
keeps, for every vantage point above it, the range of its vectors' distances. A search first visits the query's own shard,
and then each shard that the triangle inequality does not rule out: the distance of query and vantage point lies outside
the shard's range by less than the distance of the query's k-th neighbour. Within a shard (or a chunk of one that is too
large) a tree of its own is searched in the same way, the nearer side first.

The inequality may be relaxed: with `factor` f a side is left out once f times its gap exceeds the k-th distance. Factor 1 is
exact; larger ones skip sides that are unlikely to hold neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import written

NEIGHBOURS, FACTOR = 10, 1.0
#: Vectors by which shards are formed, at most; all vectors are then dealt to them.
SAMPLE_ROWS = 16_384
#: Vectors of a shard, about, as long as the sample has 16 for each.
SHARD_ROWS = 2048
#: Components of a chunk: a shard with more is cut by hash, so that a task holds some 64 MB of vectors.
CHUNK_VALUES = 1 << 23
LEAF_ROWS = 64
#: Relative room for rounding when a side is ruled out.
ROOM = 1e-12


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of paired rows, squares added from the first component to the last."""
    return np.sqrt(np.add.accumulate((x - y) ** 2, axis=-1)[..., -1])


def to_point(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - p) ** 2).sum(-1))


class Tree:
    """A vantage-point tree in arrays: node k has a vantage point, and two sides with the range of their distances to it."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        self.points: list[np.ndarray] = []
        self.sides: list[tuple[int, int]] = []  # a node, or ~leaf
        self.cuts: list[float] = []
        self.ranges: list[tuple[float, float, float, float]] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(x, np.arange(len(x)), max(1, -(-len(x) // leaf_rows)))

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(rows) > 1:
            # The row farthest from the first: a vantage point at the edge sees the others at the most different distances.
            point = x[rows[to_point(x[rows], x[rows[0]]).argmax()]]
            d = to_point(x[rows], point)
            order = d.argsort(kind="stable")
            half = len(rows) * (leaves // 2) // leaves
            inner = d < d[order[half]]
            if not inner.any():
                inner = d <= d[order[half]]
            if not inner.all():
                k = len(self.points)
                self.points.append(point), self.cuts.append(float(d[~inner].min())), self.sides.append((0, 0))
                self.ranges.append((float(d[inner].min()), float(d[inner].max()), float(d[~inner].min()), float(d[~inner].max())))
                self.sides[k] = self._grow(x, rows[inner], leaves // 2), self._grow(x, rows[~inner], leaves - leaves // 2)
                return k
        self.leaves.append(rows)
        return ~(len(self.leaves) - 1)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf of each row, distances to all vantage points)."""
        if not self.points:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 0))
        d = np.stack([to_point(x, p) for p in self.points], 1)
        at = np.full(len(x), self.root)
        sides, cuts = np.array(self.sides), np.array(self.cuts)
        while (down := np.flatnonzero(at >= 0)).size:
            node = at[down]
            at[down] = sides[node, (d[down, node] >= cuts[node]).astype(int)]
        return ~at, d

    def paths(self) -> np.ndarray:
        """[leaf, node]: does the node lie above the leaf?"""
        above = np.zeros((len(self.leaves), len(self.points)), bool)

        def walk(at: int, path: list[int]) -> None:
            if at < 0:
                above[~at, path] = True
            else:
                for side in self.sides[at]:
                    walk(side, [*path, at])

        walk(self.root, [])
        return above


class Best:
    """The k nearest found so far of each query, ties to the smaller id; a null id counts as the largest."""

    def __init__(self, queries: np.ndarray, k: int, bound: np.ndarray):
        self.q, self.bound = queries, bound
        self.d, self.ids = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.has = np.zeros((len(queries), k), bool)
        self.compared = 0

    def limit(self, rows: np.ndarray) -> np.ndarray:
        """Nothing beyond this distance can matter to these queries."""
        return np.minimum(self.d[rows, -1], self.bound[rows])

    def offer(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        self.compared += len(rows) * len(x)
        q = self.q[rows]
        # A product first, with room for its rounding; the distances that count are computed from differences.
        size = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]
        about = size - 2 * (q @ x.T)
        r, c = np.nonzero(~(about > self.limit(rows)[:, None] ** 2 + ROOM * size))
        if not len(r):
            return
        d = distances(q[r], x[c])
        near = d <= self.limit(rows)[r]
        r, c, d = r[near], c[near], d[near]
        if not len(r):
            return
        own, at = np.unique(r, return_inverse=True)
        width = np.bincount(at)
        place = np.arange(len(r)) - np.repeat(np.cumsum(width) - width, width)  # r is ascending
        k, wide = self.d.shape[1], int(width.max())
        more = [np.full((len(own), wide), f) for f in (np.inf, np.iinfo(np.int64).max, False)]
        for m, v in zip(more, (d, ids[c], True), strict=True):
            m[at, place] = v
        rows = rows[own]
        d, i, has = (np.concatenate([a[rows], b], 1) for a, b in zip((self.d, self.ids, self.has), more, strict=True))
        order = np.lexsort((i, d, ~has))[:, :k]
        for mine, new in ((self.d, d), (self.ids, i), (self.has, has)):
            mine[rows] = np.take_along_axis(new, order, 1)


def search(tree: Tree, x: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
    """Offers each query what its relaxed triangle inequalities do not rule out, the nearer side first."""

    def visit(at: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if at < 0:
            leaf = tree.leaves[~at]
            best.offer(rows, x[leaf], ids[leaf])
            return
        d = to_point(best.q[rows], tree.points[at])
        best.compared += len(rows)
        lo0, hi0, lo1, hi1 = tree.ranges[at]
        gaps = tuple(np.maximum(lo - d, d - hi) - ROOM * (d + hi) for lo, hi in ((lo0, hi0), (lo1, hi1)))
        outer = gaps[1] < gaps[0]
        for turn in (False, True):
            for side in (0, 1):
                mine = (outer == bool(side)) != turn
                gap = gaps[side][mine]
                visit(tree.sides[at][side], rows[mine][~(factor * gap > best.limit(rows[mine]))])

    visit(tree.root, np.arange(len(best.q)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, dim, h1, h2, vector) of the vectors that take part; equal vectors have equal hashes."""
    kind = table.schema["embedding"].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return rows.select("vec_id", F.size("vector").alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vector")


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of vectors that stand in more than k rows only the k of the smallest ids: others are never among the k nearest."""
    crowds = written(rows.groupBy("h1", "h2").count().where(F.col("count") > k).select("h1", "h2"), "crowds")
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("vec_id").asc_nulls_last()))
    some = rows.join(crowds, ["h1", "h2"], "left_semi").withColumn("_k", place).where(F.col("_k") <= k).drop("_k")
    return rows.join(crowds, ["h1", "h2"], "left_anti").unionByName(some).select(*rows.columns)


def _sampled_trees(rows: DataFrame, sample_rows: int, shard_rows: int) -> dict[int, Tree]:
    """A tree for each length of vectors, over the sample of least hashes."""
    n = rows.count()
    sample = rows.select("dim", "h1", "h2", "vector").orderBy("h1", "h2").limit(sample_rows).toArrow()
    dims = np.asarray(sample.column("dim"))
    share = max(1, n) / max(1, len(dims))
    return {int(d): Tree(_matrix(sample.filter(pa.array(dims == d)).column("vector").combine_chunks()), max(16, int(shard_rows / share))) for d in np.unique(dims)}


def _route(trees: dict[int, Tree], above: dict[int, np.ndarray]):
    """Adds the shard, and the distances to the vantage points above it, from the root down, to rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                shard, path = np.zeros(part.num_rows, np.int32), [[]] * part.num_rows
                if int(d) in trees:
                    shard, far = trees[int(d)].route(_matrix(part.column(part.schema.get_field_index("vector"))))
                    path = [row[above[int(d)][s]] for row, s in zip(far, shard, strict=True)]
                cols = [*part.columns, pa.array(np.asarray(shard).astype(np.int32)), pa.array(path, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, [*part.schema.names, "shard", "path"])

    return run


def _open_shards(trees: dict[int, Tree], above: dict[int, np.ndarray], ranges: dict[tuple[int, int], np.ndarray], factor: float):
    """The shards other than its own that a query has to visit, given the distance `bound` of its k-th neighbour so far."""
    bounds = {}
    for d, tree in trees.items():
        low, high = np.full((len(tree.leaves), len(tree.points)), -np.inf), np.full((len(tree.leaves), len(tree.points)), np.inf)
        for s in range(len(tree.leaves)):
            if (d, s) in ranges:
                low[s, above[d][s]], high[s, above[d][s]] = ranges[d, s]
        bounds[d] = low, high, np.array([(d, s) in ranges for s in range(len(tree.leaves))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda n, b: b.column(b.schema.get_field_index(n))
            dims = np.asarray(get("dim", batch))
            for d in np.unique(dims):
                if int(d) not in trees or not trees[int(d)].points:
                    continue
                low, high, there = bounds[int(d)]
                part = batch.filter(pa.array(dims == d))
                _, far = trees[int(d)].route(_matrix(get("vector", part)))
                bound, own = get("bound", part).to_numpy(zero_copy_only=False), np.asarray(get("shard", part))
                visits = []
                for lo in range(0, len(far), 256):
                    f, b = far[lo : lo + 256, None], bound[lo : lo + 256, None]
                    gap = (np.maximum(low - f, f - high) - ROOM * (f + np.abs(high))).max(2)
                    go = ~(factor * gap > b) & there
                    go[np.arange(len(go)), own[lo : lo + 256]] = False
                    visits += [np.flatnonzero(g).astype(np.int32) for g in go]
                yield pa.RecordBatch.from_arrays([get("h1", part), get("h2", part), get("dim", part), get("vector", part), get("bound", part), pa.array(visits, pa.list_(pa.int32()))], ["h1", "h2", "dim", "vector", "bound", "visits"])

    return run


FOUND = "h1 long, h2 long, vec_id long, score double, compared long"


def _searched(k: int, factor: float, leaf_rows: int):
    """Rows come by shard and chunk, indexed vectors before queries; a tree is built for each chunk that has queries."""

    def answered(query: pa.Table, tree: Tree, x: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, query.num_rows, 1024):
            part = query.slice(lo, 1024)
            best = Best(_matrix(part.column("vector").combine_chunks()), k, part.column("bound").to_numpy())
            search(tree, x, ids, best, factor)
            row, col = np.nonzero(best.has)
            h1, h2 = (np.asarray(part.column(n)) for n in ("h1", "h2"))
            found = best.ids[row, col]
            each = np.zeros(len(row), np.int64)
            if len(each):
                each[0] = best.compared
            yield pa.RecordBatch.from_arrays([pa.array(h1[row]), pa.array(h2[row]), pa.array(found, mask=found == np.iinfo(np.int64).max), pa.array(best.d[row, col]), pa.array(each)], ["h1", "h2", "vec_id", "score", "compared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            key = np.stack([np.asarray(rows.column(n)).astype(np.int64) for n in ("dim", "shard", "chunk", "asks")], 1)
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part, (*place, asks) = rows.slice(i, j - i), key[i].tolist()
                if place != at:
                    at, held, tree = place, [], None
                if not asks:
                    held.append(part.select(["vec_id", "vector"]))
                elif held or tree:
                    if tree is None:
                        whole = pa.concat_tables(held).combine_chunks()
                        x = _matrix(whole.column("vector").combine_chunks())
                        ids = whole.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
                        tree, held = Tree(x, leaf_rows), []
                    yield from answered(part, tree, x, ids)

    return run


def _visit(index: DataFrame, asks: DataFrame, k: int, factor: float, leaf_rows: int) -> DataFrame:
    """What queries (h1, h2, dim, vector, bound, shard, chunk) find in the chunks that they visit, the k best of each."""
    none = F.lit(None).cast("double").alias("bound")
    names = ("dim", "shard", "chunk", "asks", "vec_id", "h1", "h2", "vector", "bound")
    rows = index.select("*", F.lit(0).alias("asks"), none).select(*names).unionByName(asks.select("*", F.lit(1).alias("asks"), F.lit(None).cast("long").alias("vec_id")).select(*names))
    key = ("dim", "shard", "chunk")
    found = rows.repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(_searched(k, factor, leaf_rows), FOUND)
    return written(found, "found")


def _first_k(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _looked_up(table: DataFrame, asked, k: int, factor: float, sample_rows: int, shard_rows: int, chunk_values: int, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows that ask, and what the chunks that their vectors visited gave: the `k` best of each visit."""
    rows = usable(table)
    kept = _first_copies(rows, k)
    trees = _sampled_trees(kept, sample_rows, shard_rows)
    above = {d: t.paths() for d, t in trees.items()}
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    routed = written(kept.mapInArrow(_route(trees, above), f"{fields}, shard int, path array<double>"), "index")
    depth = max([int(a.sum(1).max()) for a in above.values() if a.size], default=0)
    ends = [f(F.get("path", F.lit(i))).alias(f"{n}{i}") for i in range(depth) for n, f in (("lo", F.min), ("hi", F.max))]
    shards = written(routed.groupBy("dim", "shard").agg(F.count(F.lit(1)).alias("rows"), *ends), "shards")
    ranges = {}
    for r in shards.where(F.col("dim").isin(list(trees))).collect():  # a row for each leaf of the sampled trees
        n = int(above[r.dim][r.shard].sum())
        ranges[r.dim, r.shard] = np.array([[r[f"{e}{i}"] for i in range(n)] for e in ("lo", "hi")])
    chunks = shards.select("dim", "shard", F.ceil(F.col("rows") * F.col("dim") / chunk_values).cast("int").alias("chunks"))
    index = routed.join(chunks, ["dim", "shard"]).withColumn("chunk", F.pmod("h2", "chunks").cast("int"))
    own = rows.where(asked)
    kind = rows.schema["vector"].dataType.simpleString()
    queries = own.groupBy("h1", "h2", "dim").agg(F.first("vector").alias("vector"))
    queries = written(queries.mapInArrow(_route(trees, above), f"h1 long, h2 long, dim int, vector {kind}, shard int, path array<double>").drop("path"), "queries")
    in_chunks = lambda asks: asks.join(chunks, ["dim", "shard"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    near = _visit(index, in_chunks(queries.withColumn("bound", F.lit(float("inf")))), k, factor, leaf_rows)
    if not any(t.points for t in trees.values()):
        return own, near
    far = _first_k(near, k).groupBy("h1", "h2").agg(F.max("score").alias("_far"), F.count(F.lit(1)).alias("_n"))
    bound = F.when(F.col("_n") == k, F.col("_far")).otherwise(float("inf"))
    asks = queries.join(far, ["h1", "h2"], "left").select("h1", "h2", "dim", "vector", "shard", bound.alias("bound"))
    asks = asks.mapInArrow(_open_shards(trees, above, ranges, factor), f"h1 long, h2 long, dim int, vector {kind}, bound double, visits array<int>")
    asks = asks.withColumn("shard", F.explode("visits")).drop("visits")
    return own, near.unionByName(_visit(index, in_chunks(asks), k, factor, leaf_rows))


def nearest(table: DataFrame, asked, k: int = NEIGHBOURS, factor: float = FACTOR, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, chunk_values: int = CHUNK_VALUES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows to each row for which the column `asked` holds, but for itself.

    The distance is Euclidean, in double precision, squares added from the first component to the last; ties go to the
    smaller vec_id. Null, empty and zero vectors and those with null or non-finite components take no part, and vectors of
    different lengths are not compared. Rows that repeat a vec_id are rows of their own, each a query where `asked` holds
    (their answers then share query_id); rows without vec_id are found, after others at the same distance. Fewer than k
    candidates give fewer rows, an empty table an empty result; further columns are ignored; long texts do not occur here.
    The index and what was found stay as tables in the shared folder. Spark jobs run while the plan is made.
    """
    own, found = _looked_up(table, asked, k + 1, factor, sample_rows, shard_rows, chunk_values, leaf_rows)
    lists = _first_k(found, k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))  # k + 1 entries at most
    # A row is not its own neighbour: of the entries with its id and no distance, which are alike, the first goes.
    itself = F.expr("coalesce(get(filter(near, x -> x.score = 0 AND x.vec_id <=> query_id), 0).place, 0)")
    answers = own.select("h1", "h2", F.col("vec_id").alias("query_id")).join(lists, ["h1", "h2"]).withColumn("_self", itself)
    others = F.slice(F.filter("near", lambda x: x["place"] != F.col("_self")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.rid <> v.rid AND len(q.e) = len(v.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 10
"""
