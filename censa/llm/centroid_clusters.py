"""Centroid clustering by delta Lloyd, in whole numbers.

Assignments (with the distance to the owner) and the sums of all clusters are tables that are carried from round to round. A
round looks only at what changed: a vector whose owner stands still is compared with the centroids that moved; one whose
owner moved nearer, too; one whose owner moved away, with all. Vectors that change hands give signed transfers, +x to the new
owner and -x from the old one, which are added up by task and then by cluster and position. Nothing but the centroids (their
number times their length) reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

DIM, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Whole numbers beyond this count as this, so that squared distances of a few hundred components fit a long.
REACH = 1 << 27
#: Up to this size, products and sums of 64 components are exact in doubles.
EXACT = 1 << 22

STATE = "vec_id long, x array<int>, cluster int, before int, distance long"


def points(table: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of exactly `dim` finite components as whole numbers floor(scale * component)."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & fine)
    whole = F.transform(e, lambda v: F.floor(F.least(F.greatest(v * F.lit(float(scale)), F.lit(-float(REACH))), F.lit(float(REACH)))).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c; both int64."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if x.shape[1] <= 64 and max(np.abs(x).max(), np.abs(c).max()) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after some centroids moved. `owner` and `distance` hold for the centroids before; `changed` is ascending.

    Of the centroids that stand still none can have become the nearest, unless the owner moved away.
    """
    moved = np.isin(owner, changed)
    owner, now = owner.copy(), distance.copy()
    now[moved] = ((x[moved] - centroids[owner[moved]]) ** 2).sum(1)
    away = now > distance
    for rows, ids in ((np.flatnonzero(~away), changed), (np.flatnonzero(away), np.arange(len(centroids)))):
        d = squared(x[rows], centroids[ids])
        if d.size:
            k = d.argmin(1)
            least, at = d[np.arange(len(rows)), k], ids[k]
            better = (least < now[rows]) | ((least == now[rows]) & (at < owner[rows]))
            owner[rows[better]], now[rows[better]] = at[better], least[better]
    return owner, now


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assign(centroids: np.ndarray, changed: np.ndarray | None):
    """A round over rows of the state; without `changed` the first one, in which all is compared with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, column = (batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "x"))
            x = _matrix(column)
            if changed is None:
                d = squared(x, centroids)
                owner = d.argmin(1)
                distance, before = d[np.arange(len(x)), owner], pa.nulls(len(x), pa.int32())
            else:
                old, far = (np.asarray(batch.column(batch.schema.get_field_index(n))).astype(np.int64) for n in ("cluster", "distance"))
                owner, distance = reassigned(x, old, far, centroids, changed)
                before = pa.array(old.astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, column, pa.array(owner.astype(np.int32)), before, pa.array(distance)], ["vec_id", "x", "cluster", "before", "distance"])

    return run


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task what every cluster gains and loses: (cluster, n, sums), signed."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(batch.schema.get_field_index("x")))
        for name, sign in (("cluster", 1), ("before", -1)):
            side = batch.column(batch.schema.get_field_index(name)).fill_null(-1).to_numpy()
            for c in np.unique(side[side >= 0]).tolist():
                own = side == c
                n, s = total.get(c, (0, 0))
                total[c] = n + sign * int(own.sum()), s + sign * x[own].sum(0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tolist() for _, s in total.values()], pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _added(state: DataFrame, totals: DataFrame | None) -> DataFrame:
    """(cluster, pos, n, s): the members of each cluster and their sum at each position, from those before and the transfers."""
    gone = state.where(~F.col("cluster").eqNullSafe(F.col("before"))).mapInArrow(_transfers, "cluster int, n long, sums array<long>")
    rows = gone.select("cluster", "n", F.posexplode("sums").alias("pos", "s"))
    rows = rows.select("cluster", "pos", "n", "s")
    rows = rows if totals is None else rows.unionByName(totals)
    return written(rows.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "totals")


def centroid_clusters(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of exactly `dim` finite components.

    Components count as floor(scale * x). The first centroids are the vectors of the least sha256 of `salt:vec_id`; of equal
    hashes (repeated ids) the least components come first, and rows without id are no first centroids. Fewer vectors than
    `clusters` give fewer centroids; empty clusters keep theirs. Repeated rows are vectors of their own, null, short and
    non-finite vectors are left out. Whole numbers beyond +-REACH count as that bound; inertias that do not fit a long are null.
    Without any first centroid cluster and what follows from it are null; an empty table gives an empty result; further
    columns are ignored. Long texts do not occur here. The last state and sums stay in the shared folder.
    """
    spark = table.sparkSession
    vectors = points(table, dim, scale)
    first = vectors.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256), "x").limit(clusters)
    centroids = np.array([r.x for r in first.select("x").collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(None).cast("int").alias("cluster"), *(F.lit(None).cast("long").alias(n) for n in ("distance", "cluster_inertia", "inertia")), F.lit(None).cast("string").alias("centroid_sha256"))
    state = written(vectors.mapInArrow(_assign(centroids, None), STATE), "clusters")
    totals = None
    for _ in range(rounds):
        sums = _added(state, totals)
        if totals is not None:
            discard(totals)
        totals, after = sums, centroids.copy()
        for r in totals.where("n > 0").collect():  # clusters times dim numbers
            after[r.cluster, r.pos] = r.s // r.n
        changed = np.flatnonzero((after != centroids).any(1))
        if not len(changed):
            break
        centroids, new = after, written(state.mapInArrow(_assign(after, changed), STATE), "clusters")
        discard(state)
        state = new
    digests = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    own = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    fits = lambda c: F.expr(f"try_cast({c} AS bigint)")
    own = own.join(F.broadcast(own.agg(F.sum("own").alias("every"))))  # one row
    facts = own.join(digests, "cluster").select("cluster", fits("own").alias("cluster_inertia"), fits("every").alias("inertia"), "centroid_sha256")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each cluster


def _round(k: int) -> str:
    """Assignment to the centroids c<k>, and the centroids c<k+1> that follow."""
    return f"""
d{k} AS MATERIALIZED (SELECT v.rid, v.vec_id, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS m FROM v, c{k} c GROUP BY 1, 2),
s{k} AS (SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM v JOIN d{k} USING (rid), range(1, {DIM + 1}) r(i) GROUP BY 1, 2),
m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{k} GROUP BY 1),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{k} o LEFT JOIN m{k} m USING (c)),"""


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(least(greatest(CAST(e AS DOUBLE) * {SCALE}, -{REACH}), {REACH})) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS INT) AS c, x FROM v WHERE vec_id IS NOT NULL QUALIFY c < {CLUSTERS}),{"".join(_round(k) for k in range(ROUNDS))}
d AS (SELECT v.vec_id, v.rid, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS m FROM v, c{ROUNDS} c GROUP BY 1, 2)
SELECT vec_id, m.c AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM d JOIN c{ROUNDS} c ON c.c = m.c
"""
