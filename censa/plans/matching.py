"""Queries that compare sets of vectors and points: similarity joins, set matching, quality and distinctiveness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import angles as A
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import matching as K
from ..operators import pairs as P
from ..operators import ranking as R
from ..operators import sampling as N
from ..operators import sets as T
from .roles import Catalogue

catalogue = Catalogue()
add = catalogue.add

_V = "v AS (SELECT spot_id, individual_id, photo_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors)"
_BEST = "best AS (SELECT a.spot_id AS q, a.photo_id AS q_group, b.photo_id AS g_group, max(list_cosine_similarity(a.e, b.e)) AS sim, arg_max(b.spot_id, list_cosine_similarity(a.e, b.e)) AS g FROM v a JOIN v b ON a.photo_id <> b.photo_id {where} GROUP BY 1, 2, 3)"


_PLACES = ", ".join(f"CAST({p}.spot_id * 37 % 101 AS DOUBLE) AS {n}x, CAST({p}.spot_id * 53 % 103 AS DOUBLE) AS {n}y, {p}.spot_id * 29 % 97 / 97.0::DOUBLE AS {n}t, {p}.spot_id * 11 % 10 / 10.0::DOUBLE AS {n}w" for p, n in (("a", "q"), ("b", "g")))
#: Spots of two photos of an individual, ranked from both sides, and the mutual links.
_SETS = f"""p AS (SELECT a.photo_id AS a, b.photo_id AS b, a.spot_id AS q, b.spot_id AS g, list_cosine_similarity(a.e, b.e) AS s, {_PLACES} FROM v a JOIN v b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b, q ORDER BY s DESC, g) AS k, row_number() OVER (PARTITION BY a, b, g ORDER BY s DESC, q) AS back FROM p), l AS (SELECT * FROM r WHERE k = 1 AND back = 1)"""
_FAR = ", ".join(f"round(sqrt(pow(i.{n}x - j.{n}x, 2) + pow(i.{n}y - j.{n}y, 2)), 9) AS {d}" for n, d in (("q", "d"), ("g", "e")))
_NEAR = "count(*) FILTER (WHERE m <= 3 AND n <= 3) / (count(*) FILTER (WHERE m <= 3))::DOUBLE"
_MN = "row_number() OVER (PARTITION BY {own}a, b, iq ORDER BY d, jq) AS m, row_number() OVER (PARTITION BY {own}a, b, iq ORDER BY e, jq) AS n"
_TIES = "rank() OVER (PARTITION BY a, b ORDER BY {x}) + (count(*) OVER (PARTITION BY a, b, {x}) - 1) / 2.0::DOUBLE"
#: The geometry of the links of each pair of photos.
_GEO = f"""two AS (SELECT i.a, i.b, i.q AS iq, j.q AS jq, {_FAR}, sign(i.qt - j.qt) * sign(i.gt - j.gt) AS tau FROM l i JOIN l j ON i.a = j.a AND i.b = j.b AND i.q <> j.q),
    dist AS (SELECT a, b, CASE WHEN count(*) >= 2 AND stddev_pop(d) > 0 AND stddev_pop(e) > 0 THEN corr(d, e) ELSE 0 END AS o FROM (SELECT a, b, {_TIES.format(x="d")} AS d, {_TIES.format(x="e")} AS e FROM two WHERE iq < jq) GROUP BY 1, 2),
    nb AS (SELECT a, b, {_NEAR} AS nb FROM (SELECT a, b, {_MN.format(own="")} FROM two) GROUP BY 1, 2), kt AS (SELECT a, b, avg(tau) AS kendall FROM two WHERE iq < jq GROUP BY 1, 2),
    dealt AS (SELECT l.*, turn, row_number() OVER (PARTITION BY turn, a, b ORDER BY q) AS i, row_number() OVER (PARTITION BY turn, a, b ORDER BY md5('turn:' || turn || ':' || q), q) AS j FROM l, range(4) t(turn)),
    anew AS (SELECT x.turn, x.a, x.b, x.q, x.qx, x.qy, y.gx, y.gy FROM dealt x JOIN dealt y ON x.turn = y.turn AND x.a = y.a AND x.b = y.b AND x.i = y.j),
    chance AS (SELECT a, b, avg(nb) AS chance FROM (SELECT turn, a, b, {_NEAR} AS nb FROM (SELECT turn, a, b, {_MN.format(own="turn, ")} FROM (SELECT i.turn, i.a, i.b, i.q AS iq, j.q AS jq, {_FAR} FROM anew i JOIN anew j ON i.turn = j.turn AND i.a = j.a AND i.b = j.b AND i.q <> j.q)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    shift AS (SELECT a, b, count(*) AS links, avg((abs(gt - qt - m) <= 0.05 + 1e-9)::INT) AS one, avg(((qt > 0.5) = (gt > 0.5))::INT) AS sides FROM (SELECT *, median(gt - qt) OVER (PARTITION BY a, b) AS m FROM l) GROUP BY 1, 2),
    geometry AS (SELECT a, b, links, round(CASE WHEN links >= 3 THEN coalesce(o, 0) ELSE 0 END, 6) + 0 AS "order", round(CASE WHEN links >= 3 THEN nb ELSE 0 END, 6) AS neighbours, round(CASE WHEN links >= 3 THEN nb - chance ELSE 0 END, 6) + 0 AS gain,
      round(CASE WHEN links >= 3 THEN one ELSE 0 END, 6) AS one_shift, round(coalesce(kendall, 0), 6) + 0 AS kendall, round(sides, 6) AS sides FROM shift LEFT JOIN dist USING (a, b) LEFT JOIN nb USING (a, b) LEFT JOIN chance USING (a, b) LEFT JOIN kt USING (a, b))"""


def _spots(vectors: DataFrame) -> DataFrame:
    """Spots with a place for each: x and y from the id, the axis from the id as well."""
    i = F.col("spot_id")
    return vectors.select(F.col("individual_id").alias("owner"), F.col("photo_id").alias("photo"), i.alias("id"), F.col("embedding").alias("e"), (i * 37 % 101).cast("double").alias("x"), (i * 53 % 103).cast("double").alias("y"), (i * 29 % 97 / 97.0).alias("t"), (i * 11 % 10 / 10.0).alias("w"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sides(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("spot_id").alias("id"), F.col("photo_id").alias("grp"), F.col("embedding").alias("e"))


@add("vectors", sql=f"WITH {_V} SELECT a.spot_id AS a, b.spot_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.spot_id < b.spot_id AND a.photo_id <> b.photo_id WHERE list_cosine_similarity(a.e, b.e) >= 0.35")
def join_all_pairs_threshold(vectors: DataFrame) -> DataFrame:
    """All pairs of spots of different photos at or above a cosine, by blocks."""
    return A.pairs_above(vectors, 0.35, group="photo_id").select("a", "b", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V} SELECT a.spot_id AS a, b.spot_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.photo_id = '0_0' AND b.photo_id = '0_1'")
def join_pairs_two_sets(vectors: DataFrame) -> DataFrame:
    """The cosine matrix of two photos."""
    two = _spots(vectors.where(F.col("photo_id").isin("0_0", "0_1")))
    return T.met(two, columns=(), bare=True).select(F.col("q").alias("a"), F.col("g").alias("b"), F.round("s", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V} SELECT a, b, sim FROM (SELECT a.spot_id AS a, b.spot_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim, row_number() OVER (PARTITION BY a.photo_id, b.photo_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, a.spot_id, b.spot_id) AS k FROM v a JOIN v b ON a.photo_id < b.photo_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3) WHERE k <= 2")
def topk_per_pair(vectors: DataFrame) -> DataFrame:
    """The two best links of each pair of photos, among those above a cutoff."""
    found = A.pairs_above(vectors, 0.3, group="photo_id", most=2, per_group=True)
    return R.first_per(found, ["group_a", "group_b"], F.col("sim").desc(), "a", "b", n=2).select("a", "b", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V} SELECT a.spot_id AS a, b.spot_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.spot_id < b.spot_id AND a.individual_id <> b.individual_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3 ORDER BY list_cosine_similarity(a.e, b.e) DESC, 1, 2 LIMIT 30")
def topk_global_pairs(vectors: DataFrame) -> DataFrame:
    """The most similar pairs across individuals."""
    return A.pairs_above(vectors, 0.3, group="individual_id", most=30).orderBy(F.col("sim").desc(), "a", "b").limit(30).select("a", "b", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V}, {_BEST.format(where='')}, m AS (SELECT q_group, g_group, avg(sim) AS sim FROM best GROUP BY 1, 2), o AS (SELECT m.*, split_part(g_group, '_', 1) AS owner FROM m) SELECT q_group, owner, g_group, round(sim, 6) AS sim FROM o QUALIFY row_number() OVER (PARTITION BY q_group, owner ORDER BY sim DESC, g_group) = 1")
def match_soft_chamfer(vectors: DataFrame) -> DataFrame:
    """Best photo of each individual for each query photo, by the mean of best similarities."""
    best = P.best_in_groups(_sides(vectors), _sides(vectors))
    owner = vectors.select(F.col("photo_id").alias("g_group"), F.split_part("photo_id", F.lit("_"), F.lit(1)).alias("owner")).distinct()
    return P.soft_chamfer(best, owner).select("q_group", "owner", "g_group", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V}, {_BEST.format(where='')} SELECT q, g_group, g, round(sim, 6) AS sim FROM best")
def match_best(vectors: DataFrame) -> DataFrame:
    """Each query spot's best spot in every other photo."""
    return P.best_in_groups(_sides(vectors), _sides(vectors)).select("q", "g_group", "g", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V}, {_BEST.format(where='')} SELECT a.q_group, a.g_group, a.q, a.g, round(a.sim, 6) AS sim FROM best a JOIN best b ON a.q_group = b.g_group AND a.g_group = b.q_group AND a.q = b.g AND a.g = b.q WHERE a.q_group < a.g_group")
def match_mutual_nn(vectors: DataFrame) -> DataFrame:
    """Spots of two photos that pick each other, over all pairs of photos."""
    return P.mutual_in_groups(_sides(vectors)).select("q_group", "g_group", "q", "g", F.round("sim", 6).alias("sim"))


@add("vectors", sql=f"WITH {_V}, {_BEST.format(where='AND a.individual_id = b.individual_id')} SELECT q AS spot_id, q_group AS photo_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM best b WHERE b.q = best.g AND b.g = best.q)) AS survived, count(*) AS siblings, round(max(sim), 6) AS best_sim FROM best GROUP BY 1, 2")
def spot_survival(vectors: DataFrame) -> DataFrame:
    """To how many photos of its own individual each spot survives as a mutual link."""
    return T.survival(T.matched(_spots(vectors))).withColumn("best_sim", F.round("best_sim", 6))


@add("vectors", sql=f"""
    WITH {_V}, p AS (SELECT a.spot_id AS q, a.photo_id AS a, b.photo_id AS b, b.spot_id AS g, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY q, b ORDER BY s DESC, g) AS k, row_number() OVER (PARTITION BY a, g ORDER BY s DESC, q) AS back FROM p)
    SELECT a, b, round(avg(s) FILTER (WHERE k = 1), 6) AS softchamfer, round(max(s), 6) AS max_sim, round(stddev_pop(s) FILTER (WHERE k = 1), 6) AS qmax_std, count(*) FILTER (WHERE k = 1 AND s >= 0.3) AS links,
      round(count(*) FILTER (WHERE k = 1 AND back = 1) / count(DISTINCT q)::DOUBLE, 6) AS mutual_frac, round(least(count(DISTINCT q), count(DISTINCT g)) / greatest(count(DISTINCT q), count(DISTINCT g))::DOUBLE, 6) AS spot_ratio FROM r GROUP BY 1, 2""")
def pair_consistency(vectors: DataFrame) -> DataFrame:
    """How well the photos of an individual agree: similarities, mutual links and numbers of spots; `match_ransac` adds the geometry."""
    out = T.consistency(T.matched(_spots(vectors)), 0.3)
    return out.select("a", "b", *(F.round(c, 6).alias(c) for c in ("softchamfer", "max_sim", "qmax_std", "mutual_frac", "spot_ratio")), "links")


def _photo_pairs(vectors: DataFrame) -> DataFrame:
    photos = vectors.select("individual_id", "photo_id").distinct()
    return J.pairs_within(photos, "individual_id", "photo_id").select(F.col("a.photo_id").alias("a"), F.col("b.photo_id").alias("b"))


def _xy(side: dict) -> np.ndarray:
    return np.stack([side["x"], side["y"]], 1)


def _over(vectors, kernel, columns: str, fields: str) -> DataFrame:
    """A kernel over the photos of an individual, with those columns of `_spots` that it reads."""
    return P.over_pairs(_photo_pairs(vectors), _spots(vectors).select("photo", "id", *columns), "photo", kernel, f"a string, b string, {fields}")


@add("vectors")
def match_hungarian(vectors: DataFrame) -> DataFrame:
    """One-to-one links of the greatest total similarity between the photos of an individual."""

    def kernel(x, y):
        s = K.similarity(x["e"], y["e"])
        found = K.assignment(s)
        return {"q": x["id"][found[:, 0]], "g": y["id"][found[:, 1]], "sim": K.values_at(s, found)}

    return _over(vectors, kernel, "e", "q long, g long, sim double")


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, {_GEO}, c AS (SELECT a, b, count(*) AS ng FROM r WHERE back = 1 GROUP BY 1, 2),
    f AS (SELECT a, b, round(sum(s), 6) AS total, round(avg(s), 6) AS mean, round(max(s), 6) AS best, round(list_avg(list_sort(list(s), 'DESC')[1:3]), 6) AS best3, round(stddev_pop(s), 6) AS spread, count(*) FILTER (WHERE back = 1) AS mutual,
      round(avg((s >= 0.4)::INT), 6) AS over_1, round(avg((s >= 0.3)::INT), 6) AS over_2, round(avg((s >= 0.2)::INT), 6) AS over_3, round(avg((s >= 0.1)::INT), 6) AS over_4, count(*) FILTER (WHERE s >= 0.3) AS n_over_1, count(*) FILTER (WHERE s >= 0.2) AS n_over_2,
      count(*) AS nq FROM r WHERE k = 1 GROUP BY 1, 2)
    SELECT f.* EXCLUDE (nq), round(ln(1 + nq), 6) AS log_query, round(ln(1 + ng), 6) AS log_candidate, round(mutual / nq::DOUBLE, 6) AS mutual_share, g.* EXCLUDE (a, b, links, kendall, sides) FROM f JOIN c USING (a, b) JOIN geometry g USING (a, b)""")
def match_features(vectors: DataFrame) -> DataFrame:
    """Twenty features of each pair of photos; the two of a fitted transform are those of `match_ransac`."""
    return _rounded(T.features(T.matched(_spots(vectors)), (0.4, 0.3, 0.2, 0.1), (0.3, 0.2)))


@add("vectors", sql=f"WITH {_V}, p AS (SELECT a.spot_id AS q, a.photo_id AS a, b.photo_id AS b, list_cosine_similarity(a.e, b.e) AS s, b.spot_id AS g FROM v a JOIN v b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id), r AS (SELECT *, row_number() OVER (PARTITION BY q, b ORDER BY s DESC, g) AS k, row_number() OVER (PARTITION BY a, g ORDER BY s DESC, q) AS back, count(*) OVER (PARTITION BY q, b) AS nc FROM p) SELECT a, b, q, round(max(CASE WHEN k = 1 THEN s END), 6) AS sim1, round(coalesce(max(CASE WHEN k = 2 THEN s END), 0), 6) AS sim2, round(max(CASE WHEN k = 1 AND back = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS mutual, round(ln(1 + max(nc)), 6) AS log_nc FROM r GROUP BY 1, 2, 3")
def match_records(vectors: DataFrame) -> DataFrame:
    """A record for each query spot of a pair of photos."""
    return T.records(T.matched(_spots(vectors))).select("a", "b", "q", *(F.round(c, 6).alias(c) for c in ("sim1", "sim2", "mutual", "log_nc")))


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, rec AS (SELECT a, b, q, max(qt) AS t, max(CASE WHEN k = 1 THEN s END) AS sim1, coalesce(max(CASE WHEN k = 2 THEN s END), 0) AS sim2, coalesce(max(CASE WHEN k = 3 THEN s END), 0) AS sim3, max((k = 1 AND back = 1)::INT)::DOUBLE AS mutual, ln(1 + count(*)) AS log_nc FROM r GROUP BY 1, 2, 3),
    e AS (SELECT a, b, CAST(least(floor(t * 16), 15) AS INT) AS band, {', '.join(f"round({f}({x}), 6) AS {n}_{c}" for c, x in (("sim1", "sim1"), ("sim2", "sim2"), ("sim3", "sim3"), ("gap", "sim1 - sim2"), ("mutual", "mutual"), ("log_nc", "log_nc")) for n, f in (("mean", "avg"), ("max", "max")))}, count(*) AS n FROM rec GROUP BY 1, 2, 3)
    SELECT e.* EXCLUDE (n), round(n / max(n) OVER (PARTITION BY a, b)::DOUBLE, 6) AS share FROM e""")
def match_axial_bands(vectors: DataFrame) -> DataFrame:
    """Records gathered in 16 bands along the axis; bands without spots have no row."""
    return _rounded(T.bands(T.records(T.matched(_spots(vectors)))))


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, z AS (SELECT a, b, qw, gw, back = 1 AND s >= 0.2 AS held, greatest(s, 0) * exp(-(pow(qt - gt, 2) + pow(qw - gw, 2)) / 0.5) AS quality FROM r WHERE k = 1),
    wg AS (SELECT a, b, sum(gw) AS wg FROM r WHERE back = 1 GROUP BY 1, 2),
    n AS (SELECT a, b, least(1.0::DOUBLE, coalesce(sum(quality * (qw + gw)) FILTER (WHERE held), 0) / (sum(qw) + max(wg) + 1e-9)) AS coverage, count(*) FILTER (WHERE held) AS n_matched, count(*) FILTER (WHERE held AND quality >= 0.1) AS n_good FROM z JOIN wg USING (a, b) GROUP BY 1, 2)
    SELECT a, b, round(coverage * (1 - exp(-n_good / 2.5::DOUBLE)), 6) AS score, round(coverage, 6) AS coverage, round(1 - exp(-n_good / 2.5::DOUBLE), 6) AS support, n_matched, n_good FROM n""")
def match_strict_pair(vectors: DataFrame) -> DataFrame:
    """Coverage times support, with a position gate."""
    return _rounded(T.strict(T.matched(_spots(vectors)), least=0.2, good=0.1))


@add("vectors")
def match_residual(vectors: DataFrame) -> DataFrame:
    """Explained, contradicted and unobserved mass under a one-to-one assignment of spots at near places."""

    def kernel(x, y):
        at = lambda z: np.stack([z["t"], z["y"] / 1000], 1)
        return K.residual(K.similarity(x["e"], y["e"]), x["w"], y["w"], at(x), at(y), least=0.2)

    return _over(vectors, kernel, "eytw", "explained double, contradicted double, unobserved double, worst double, n_good long, score double")


@add("vectors")
def match_ransac(vectors: DataFrame) -> DataFrame:
    """Share of mutual links that one similarity transform explains, and by how much it exceeds that of permuted links."""
    share = lambda q, c: K.ransac_share(q, c)[0]

    def kernel(x, y):
        pairs = K.mutual_links(K.similarity(x["e"], y["e"]))
        a, b = _xy(x)[pairs[:, 0]], _xy(y)[pairs[:, 1]]
        return {"links": len(pairs), "share": share(a, b), "excess": K.excess(share, a, b, 4) if len(pairs) >= 3 else 0.0, "neighbours": K.neighbour_agreement(a, b)}

    return _over(vectors, kernel, "exy", "links long, share double, excess double, neighbours double")


@add("vectors")
def match_constellation(vectors: DataFrame) -> DataFrame:
    """Points alone: neighbour-distance descriptors and the best transform of two links."""
    return _over(vectors, lambda x, y: {"score": K.constellation(_xy(x), _xy(y))}, "xy", "score double")


@add("vectors", sql=f"WITH {_V}, {_SETS}, {_GEO} SELECT * FROM geometry")
def geom_consistency(vectors: DataFrame) -> DataFrame:
    """Geometry of mutual links: distance rank correlation, neighbours and their excess over permuted links, one shift, order and sides along the axis."""
    return _rounded(T.geometry(T.links(T.matched(_spots(vectors)))))


@add("vectors")
def mine_correspondences(vectors: DataFrame) -> DataFrame:
    """Mutual links above a cosine that fit the geometry, counted at several cutoffs."""

    def kernel(x, y):
        s = K.similarity(x["e"], y["e"])
        found = K.correspondences(s, _xy(x), _xy(y))
        return {"q": x["id"][found[:, 0]], "g": y["id"][found[:, 1]], "sim": K.values_at(s, found)}

    found = _over(vectors, kernel, "exy", "q long, g long, sim double")
    from ..operators.metrics import at_thresholds

    return at_thresholds(found, [0.4, 0.5, 0.6, 0.7, 0.8], "sim", ("links", F.lit(True)))


@add("vectors", sql=f"""
    WITH {_V}, m AS (SELECT photo_id, individual_id, i, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY 1, 2, 3), p AS (SELECT photo_id, individual_id, list(x ORDER BY i) AS e FROM m GROUP BY 1, 2),
    s AS (SELECT a.photo_id AS a, b.photo_id AS b, a.individual_id = b.individual_id AS same, list_cosine_similarity(a.e, b.e) AS sim FROM p a JOIN p b ON a.photo_id < b.photo_id),
    r AS (SELECT round(sim, 9) AS sim, row_number() OVER (ORDER BY round(sim, 9)) - 1 AS k, count(*) OVER () AS n FROM s WHERE same), bar AS (SELECT min(sim) AS bar FROM r WHERE k = floor(0.9 * (n - 1)))
    SELECT a, b, round(sim, 6) AS sim, coalesce(round(sim, 9) >= bar, FALSE) AS flagged FROM s, bar WHERE NOT same AND sim >= 0.25 ORDER BY s.sim DESC, a, b LIMIT 25""")
def dup_scan(vectors: DataFrame) -> DataFrame:
    """Photos of different individuals whose mean vectors are most alike, flagged if more than 90 % of genuine repeats are."""
    means = P.mean_vectors(vectors, "photo_id").withColumn("id", F.xxhash64("photo_id")).withColumn("owner", S.code("photo_id"))
    found = A.pairs_above(means.select(F.col("id").alias("spot_id"), F.col("mean").alias("embedding"), "owner"), 0.25, group="owner", most=25)
    name = lambda c: means.select(F.col("id").alias(c), F.col("photo_id").alias(f"p_{c}"))
    rows = found.join(name("a"), "a").join(name("b"), "b").select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b"), "sim")
    pairs = J.pairs_within(means.select("owner", "photo_id", "mean"), "owner", "photo_id")
    bar = R.value_at(pairs.select(F.round(S.cosine("a.mean", "b.mean"), 9).alias("r")), "r", 0.9, "bar")
    top = rows.orderBy(F.col("sim").desc(), "a", "b").limit(25).join(F.broadcast(bar))  # one row
    return top.select("a", "b", F.round("sim", 6).alias("sim"), F.coalesce(F.round("sim", 9) >= F.col("bar"), F.lit(False)).alias("flagged"))


@add("vectors", sql="SELECT a.photo_id AS query, b.photo_id AS photo FROM (SELECT DISTINCT photo_id, individual_id FROM vectors) a JOIN (SELECT DISTINCT photo_id, individual_id FROM vectors) b ON a.photo_id <> b.photo_id AND a.individual_id = b.individual_id")
def join_photo_pairs(vectors: DataFrame) -> DataFrame:
    """A query photo with the other photos of its candidate."""
    photos = vectors.select("photo_id", "individual_id").distinct()
    other = photos.withColumnRenamed("photo_id", "photo")
    return photos.join(other, "individual_id").where("photo_id <> photo").select(F.col("photo_id").alias("query"), "photo")


_U13 = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


#: Of the candidates of other labels, in the order of their hash, those that follow a query's own hash.
_TURN = "(j - CAST(floor(" + _U13.format("'draw:' || query") + " * m) AS BIGINT) + m) % m"


@add("images", sql=f"""
    WITH c AS (SELECT image_id AS candidate, individual_id AS candidate_label, {_U13.format("'neg:' || image_id")} AS u FROM images WHERE status = 'confirmed'),
    q AS (SELECT image_id AS query, individual_id AS label FROM images WHERE status = 'flagged_uncertain'),
    x AS (SELECT query, candidate, row_number() OVER (PARTITION BY query ORDER BY u, candidate) - 1 AS j, count(*) OVER (PARTITION BY query) AS m FROM q JOIN c ON label <> candidate_label)
    SELECT query, candidate FROM x WHERE {_TURN} < 3""")
def join_null_pairs(images: DataFrame) -> DataFrame:
    """Three photos of other individuals for each query: the null of a comparison."""
    q = images.where("status = 'flagged_uncertain'").select(F.col("image_id").alias("query"), F.col("individual_id").alias("label"))
    c = images.where("status = 'confirmed'").select(F.col("image_id").alias("candidate"), F.col("individual_id").alias("candidate_label"))
    return N.negatives(q, c, 3)


@add("images", sql="SELECT a.image_id AS query, b.image_id AS candidate, coalesce(least(a.blur, b.blur), 1.0::DOUBLE) AS quality FROM images a JOIN images b ON a.individual_id = b.individual_id AND a.image_id < b.image_id WHERE a.status = 'confirmed' AND b.status = 'confirmed'")
def pair_quality(images: DataFrame) -> DataFrame:
    """The lower quality of a pair, 1 if neither is known."""
    pairs = J.pairs_within(images.where("status = 'confirmed'").select("individual_id", "image_id", "blur"), "individual_id", "image_id")
    return pairs.select(F.col("a.image_id").alias("query"), F.col("b.image_id").alias("candidate"), F.coalesce(F.least("a.blur", "b.blur"), F.lit(1.0)).alias("quality"))


_PLACE = "(rank() OVER (ORDER BY {x}) - 1 + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / greatest(count(*) OVER () - 1, 1)"
# Weights of the query; rarity has no column here and counts as a constant.
_WEIGHTS = {"size": 1.0, "elongation": 0.5, "noncircularity": 0.75, "irregularity": 0.25, "rarity": 0.25, "isolation": 1.25}


@add("spots", sql=f"""
    WITH o AS (SELECT image_id, spot_id, area AS a, area * (0.5 + axis_t / 2) AS b, part % 11 / 10.0::DOUBLE AS k, axis_t AS t, least(greatest(axis_offset / 0.02, -3), 3)::DOUBLE AS u, sqrt(4 * area / pi()) / (50 + image_id % 40) AS size FROM spots),
    d AS (SELECT x.image_id, x.spot_id, sqrt(pow(x.t - y.t, 2) + pow(x.u - y.u, 2)) AS d FROM o x JOIN o y ON x.image_id = y.image_id AND x.spot_id <> y.spot_id),
    n AS (SELECT image_id, spot_id, avg(d) AS isolation FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY image_id, spot_id ORDER BY d) <= 3) GROUP BY 1, 2),
    f AS (SELECT o.image_id, o.spot_id, round(size, 9) AS size, round(sqrt(greatest(0.8 * a * a, b * b * (0.8 + 0.16 * k * k)) / least(0.8 * a * a, b * b * (0.8 + 0.16 * k * k))) - 1, 6) AS elongation,
      round(greatest(pow(2 * sqrt(a * a + b * b * (1 - k) * (1 - k)) + 4 * b + 2 * a, 2) / (4 * pi() * a * b * (3 + k)) - 1, 0), 6) AS noncircularity, round((1 - k) / 4, 6) AS irregularity, round(coalesce(isolation, 1), 6) AS isolation FROM o LEFT JOIN n USING (image_id, spot_id))
    SELECT image_id, spot_id, round(({' + '.join(f"{w} * {_PLACE.format(x=n)}" for n, w in _WEIGHTS.items() if n != 'rarity')} + 0.125) / 4, 6) AS distinctiveness FROM f""")
def distinctiveness(spots: DataFrame) -> DataFrame:
    """Weighted mean of a spot's places among all spots, by size, shape and isolation."""
    from ..operators.quality import distinctiveness as weigh
    from ..operators.quality import isolation
    from ..sources.sinks import written

    a, b, k = F.col("area"), F.col("area") * (0.5 + F.col("axis_t") / 2), F.col("part") % 11 / 10.0
    corner = lambda x, y: F.array(x, y)
    outline = F.array(corner(-a, -b), corner(F.lit(0.0), -b * k), corner(a, -b), corner(a, b), corner(-a, b))
    size = F.sqrt(4 * a / F.pi()) / (50 + F.col("image_id") % 40)
    alone = isolation(spots.withColumn("u", F.col("axis_offset") / 0.02), "image_id", "spot_id", "axis_t", "u", keep=("area", "axis_t", "part"))
    rows = G.shapes(alone.select("image_id", "spot_id", F.round(size, 9).alias("size"), "isolation", outline.alias("outline")), "outline")
    names = ("elongation", "noncircularity", "irregularity", "isolation")
    rows = rows.select("image_id", "spot_id", "size", *(F.round(n, 6).alias(n) for n in names))
    # The factors are read several times.
    return weigh(written(rows), "image_id", "spot_id", {n: n for n in ("size", *names)}, _WEIGHTS).select("image_id", "spot_id", F.round("distinctiveness", 6).alias("distinctiveness"))


@add("models", sql="SELECT greatest(median(blur), 1e-6) AS blur_median, greatest(max(CASE WHEN k = 1 + CAST(floor(0.9 * (n - 1)) AS BIGINT) THEN bal_acc END), 0.02) AS scale FROM (SELECT blur, bal_acc, row_number() OVER (ORDER BY bal_acc) AS k, count(*) OVER () AS n FROM models)")
def quality_calibrate(models: DataFrame) -> DataFrame:
    """Scales learned from the data: the median of a sharpness, the 90th percentile of a defect."""
    from ..operators.quality import calibrate

    return calibrate(models, "blur", {"scale": ("bal_acc", 0.02)})


@add("images", sql="""
    WITH q AS (SELECT image_id, round(least(greatest(blur / 2, 0), 1), 6) AS blur_quality, round(least(greatest(1 - 0.5 * outside, 0), 1) * CASE WHEN n_spots < 3 THEN 0.3 ELSE 1 END, 6) AS spot_quality,
      round(least(greatest(0.35 * CASE WHEN judged_ok THEN 1.0 WHEN judged_ok IS NULL THEN 0.5 ELSE 0.4 END + 0.65 * q_overall, 0), 1), 6) AS body_quality FROM images WHERE blur IS NOT NULL AND outside IS NOT NULL AND q_overall IS NOT NULL)
    SELECT *, round(pow(greatest(blur_quality, 0.0001) * greatest(spot_quality, 0.0001) * greatest(body_quality, 0.0001), 1 / 3.0::DOUBLE), 6) AS overall FROM q""")
def quality_composites(images: DataFrame) -> DataFrame:
    """Named scores and their geometric mean; an unjudged axis counts half."""
    from ..operators.quality import clip01, geometric_mean, judged

    rows = images.where("blur IS NOT NULL AND outside IS NOT NULL AND q_overall IS NOT NULL")
    rows = rows.select("image_id", F.round(clip01(F.col("blur") / 2), 6).alias("blur_quality"), F.round(clip01(1 - 0.5 * F.col("outside")) * F.when(F.col("n_spots") < 3, 0.3).otherwise(1.0), 6).alias("spot_quality"), F.round(clip01(0.35 * judged("judged_ok") + 0.65 * F.col("q_overall")), 6).alias("body_quality"))
    return rows.withColumn("overall", F.round(geometric_mean("blur_quality", "spot_quality", "body_quality"), 6))


_AVG_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


@add("spots", sql=f"""
    WITH n AS (SELECT image_id, count(*) AS n_spots, max(part) % 5000 AS sibling, max(part) % 97 / 97.0::DOUBLE AS solidity FROM spots GROUP BY 1),
    r AS (SELECT *, {_AVG_RANK.format(x='n_spots')} AS p, {_AVG_RANK.format(x='solidity')} AS s, median(n_spots) OVER (PARTITION BY sibling) AS mid FROM n)
    SELECT image_id, round(p + 1 - s, 6) AS suspicion, round(n_spots / greatest(mid, 1), 6) AS ratio FROM r""")
def multi_animal_scan(spots: DataFrame) -> DataFrame:
    """Photos that look like several animals: many spots in an outline far from convex, and more spots than their siblings."""
    n = spots.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_spots"), (F.max("part") % 5000).alias("sibling"), (F.max("part") % 97 / 97.0).alias("solidity"))
    rows = R.percent_of_all(R.percent_of_all(n, "n_spots", "p"), "solidity", "s")
    mid = n.groupBy("sibling").agg(F.percentile("n_spots", F.lit(0.5)).alias("mid"))
    return rows.join(mid, "sibling").select("image_id", F.round(F.col("p") + 1 - F.col("s"), 6).alias("suspicion"), F.round(F.col("n_spots") / F.greatest("mid", F.lit(1.0)), 6).alias("ratio"))


@add("spots", sql="SELECT image_id, spot_id, CASE WHEN axis_offset > 0 THEN 'left' WHEN axis_offset < 0 THEN 'right' ELSE 'overlap' END AS side, CASE WHEN axis_offset > 0 THEN 2 * CAST(least(floor(axis_t * 4), 3) AS INT) + 1 WHEN axis_offset < 0 THEN 2 * CAST(least(floor(axis_t * 4), 3) AS INT) + 2 END AS bin FROM spots")
def fn_bin_of(spots: DataFrame) -> DataFrame:
    """The box of each spot from its place along and aside of the axis."""
    side = F.when(F.col("axis_offset") > 0, "left").when(F.col("axis_offset") < 0, "right").otherwise("overlap")
    return spots.select("image_id", "spot_id", side.alias("side"), S.bin_of("axis_t", side).alias("bin"))


@add("spots")
def geom_bin_spots(spots: DataFrame) -> DataFrame:
    """Places and boxes of spots with outlines along a bent line."""
    rows = spots.select("image_id", "spot_id", (F.col("axis_t") * 100).alias("x"), (F.col("axis_offset") * 500).alias("y"), F.when(F.col("area") > 25, F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ((-3, -3), (3, -3), (3, 3), (-3, 3))))).alias("outline"))
    lines = rows.select("image_id").distinct().withColumn("midline", F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (50.0, 5.0), (100.0, 0.0)))))
    return G.bin_spots(rows, lines, "image_id").drop("outline")


@add("spots")
def fn_shape_desc(spots: DataFrame) -> DataFrame:
    """Elongation, noncircularity and irregularity of outlines made from a spot's numbers."""
    a, b = F.col("area"), F.col("area") * (0.5 + F.col("axis_t") / 2)
    corner = lambda x, y: F.array(x, y)
    outline = F.array(corner(-a, -b), corner(F.lit(0.0), -b / 2), corner(a, -b), corner(a, b), corner(-a, b))
    return G.shapes(spots.select("image_id", "spot_id", outline.alias("outline")), "outline").drop("outline")
