"""Further queries: lookups and reports, text and array functions, gates, features, fitted scorers and generated data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import texts as X
from ..operators import embedding as E
from ..operators import geometry as G
from ..operators import joins as J
from ..operators import matching as K
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import pairs as P
from ..operators import pools as PO
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import sampling as N
from ..operators import sets as T
from ..operators import workflow as W
from ..sources.sinks import scratch_folder, written
from ..sources.store import Put, Store
from .matching import _GEO, _SETS, _TURN, _U13, _over, _rounded, _sides, _spots, _xy
from .roles import Catalogue

catalogue = Catalogue()
add = catalogue.add
_V = "v AS (SELECT spot_id, individual_id, photo_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors)"
_U = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT) / 268435456.0::DOUBLE"

# Joins


@add("images", sql=f"""
    WITH pool AS (SELECT image_id, individual_id, status FROM images WHERE status IN ('flagged_uncertain', 'confirmed') AND NOT is_synthetic),
    l AS (SELECT individual_id AS candidate, count(*) AS n, {_U13.format("'neg:' || individual_id")} AS u FROM pool GROUP BY 1),
    q AS (SELECT image_id AS query, individual_id AS label, n - 1 AS photos FROM pool JOIN l ON candidate = individual_id WHERE status = 'flagged_uncertain' AND n > 1),
    x AS (SELECT query, candidate, n, row_number() OVER (PARTITION BY query ORDER BY u, candidate) - 1 AS j, count(*) OVER (PARTITION BY query) AS m FROM q JOIN l ON label <> candidate)
    SELECT query, label AS candidate, TRUE AS same, photos FROM q UNION ALL SELECT query, candidate, FALSE, n FROM x WHERE {_TURN} < 4""")
def join_cand_pairs(images: DataFrame) -> DataFrame:
    """Query photos with their own individual, if it has another photo, and four other individuals; confirmed photos distract."""
    pool = images.where("status IN ('flagged_uncertain', 'confirmed') AND NOT is_synthetic").select(F.col("image_id").alias("image"), F.col("individual_id").alias("label"), "status")
    queries = pool.where("status = 'flagged_uncertain'").select(F.col("image").alias("query"), "label")
    return N.candidate_pairs(queries, pool.select("image", "label"), 4)


@add("images", "individuals", sql="SELECT i.image_id AS query, g.individual_id AS candidate, i.individual_id = g.individual_id AS same FROM images i JOIN individuals d ON d.individual_id = i.individual_id JOIN individuals g ON g.site_id = d.site_id WHERE i.status = 'flagged_uncertain' AND EXISTS (SELECT 1 FROM images x WHERE x.individual_id = g.individual_id AND x.image_id <> i.image_id AND x.status = 'confirmed')")
def join_openset_pairs(images: DataFrame, individuals: DataFrame) -> DataFrame:
    """Queries against the gallery individuals of their site; candidates without another photo are skipped."""
    q = images.where("status = 'flagged_uncertain' AND image_id IS NOT NULL").select(F.col("image_id").alias("query"), "individual_id").join(individuals.select("individual_id", "site_id"), "individual_id")
    photos = images.where("status = 'confirmed' AND image_id IS NOT NULL").groupBy(F.col("individual_id").alias("candidate")).agg(F.min("image_id").alias("one"), F.max("image_id").alias("other"))
    g = individuals.select(F.col("individual_id").alias("candidate"), "site_id").join(photos, "candidate").select("candidate", "site_id", F.when(F.col("one") == F.col("other"), F.col("one")).alias("only"))
    pairs = J.product_in_blocks(q, g, "site_id", "query", "candidate", unless="only")
    return pairs.select("query", "candidate", (F.col("individual_id") == F.col("candidate")).alias("same"))


@add("verdicts", "vectors", sql=f"WITH {_V} SELECT edge_id, a.e IS NOT NULL AND b.e IS NOT NULL AS resolved, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM verdicts LEFT JOIN v a ON a.spot_id = edge_id LEFT JOIN v b ON b.spot_id = edge_id + 1")
def join_verdict_features(verdicts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Judged edges with the cosine of their ends; an edge with a missing end stays, unresolved."""
    side = lambda n, shift: vectors.select((F.col("spot_id") - shift).alias("edge_id"), F.col("embedding").alias(n))
    rows = J.left_all(verdicts.select("edge_id"), (side("a", 0), "edge_id"), (side("b", 1), "edge_id"))
    return rows.select("edge_id", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("resolved"), F.round(S.cosine("a", "b"), 6).alias("cosine"))


_CLICK = "(image_id * 7 + click_id * 31) % 100 / 100.0::DOUBLE AS x, ((image_id * 13 + click_id * 17) % 13 - 6) / 100.0::DOUBLE AS y"


@add("images", "spots", sql=f"""
    WITH c AS (SELECT image_id, click_id, {_CLICK} FROM images, (SELECT unnest([0, 1, 2]) AS click_id)),
    d AS (SELECT c.image_id, click_id, spot_id, round(pow(x - axis_t, 2) + pow(y - axis_offset, 2), 9) AS d FROM c LEFT JOIN spots s ON s.image_id = c.image_id AND round(pow(x - axis_t, 2) + pow(y - axis_offset, 2), 9) <= 0.0009)
    SELECT image_id, click_id, arg_min(spot_id, (d, spot_id)) AS spot_id, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY 1, 2""")
def join_nearest_point(images: DataFrame, spots: DataFrame) -> DataFrame:
    """The spot nearest to each of three clicks on every image, within a radius; null if there is none."""
    clicks = images.select("image_id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("click_id")).selectExpr("image_id", "click_id", *(c.replace("::DOUBLE", "D").replace("100.0D", "100D") for c in _CLICK.split(", ")))
    points = spots.select("image_id", "spot_id", F.col("axis_t").alias("x"), F.col("axis_offset").alias("y"))
    return J.nearest_point(clicks, points, "image_id", "click_id", "spot_id", 0.03).withColumn("distance", F.round("distance", 6))


@add("vectors", sql=f"WITH {_V}, p AS (SELECT a.spot_id AS q, b.spot_id AS g, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.photo_id = '1_0' AND b.photo_id = '1_1') SELECT q AS id, arg_max(g, s) AS best, 'row' AS side FROM p GROUP BY 1 UNION ALL SELECT g, arg_max(q, s), 'column' FROM p GROUP BY 1")
def rank_argmax_rowcol(vectors: DataFrame) -> DataFrame:
    """The best partner of each row and of each column of a similarity matrix."""
    a, b = (_sides(vectors.where(F.col("photo_id") == p)) for p in ("1_0", "1_1"))
    one = lambda x, y, side: P.best_in_groups(x, y).select(F.col("q").alias("id"), F.col("g").alias("best"), F.lit(side).alias("side"))
    return one(a, b, "row").unionByName(one(b, a, "column"))


@add("vectors", sql=f"WITH {_V}, p AS (SELECT a.spot_id AS q, b.photo_id AS photo, b.spot_id AS g, row_number() OVER (PARTITION BY a.spot_id, b.photo_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.spot_id) AS place FROM v a JOIN v b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id) SELECT q, g, place FROM p WHERE g = q + 1 OR g = q + 5")
def rank_partner(vectors: DataFrame) -> DataFrame:
    """Where a spot's true partner stands among the spots of the other photo."""
    partners = vectors.select(F.col("spot_id").alias("q"), F.explode(F.array(F.col("spot_id") + 1, F.col("spot_id") + 5)).alias("g"))
    return T.places(_spots(vectors), partners)


# Functions


@add("verdicts", sql="WITH s AS (SELECT method, count(*) FILTER (WHERE accepted) AS k, count(*) AS n, count(*) FILTER (WHERE novel) AS m FROM verdicts GROUP BY 1) SELECT method, round(CASE WHEN 0.25 * k / n + m / n::DOUBLE > 0 THEN 1.25 * (k / n::DOUBLE) * (m / n::DOUBLE) / (0.25 * k / n + m / n::DOUBLE) ELSE 0 END, 6) AS f, round(greatest((k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 / (1 + 3.8416 / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4 * n * n)), 0), 6) AS lo FROM s")
def fn_fbeta_wilson(verdicts: DataFrame) -> DataFrame:
    """F0.5 of two rates and a Wilson bound."""
    s = verdicts.groupBy("method").agg(F.count_if("accepted").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if("novel").alias("m"))
    return s.select("method", F.round(S.fbeta(F.col("k") / F.col("n"), F.col("m") / F.col("n")), 6).alias("f"), F.round(S.wilson("k", "n")[0], 6).alias("lo"))


@add("images", sql="SELECT image_id, round(2 * 6371000 * asin(sqrt(pow(sin(radians((image_id % 90 - 32) / 2.0::DOUBLE)), 2) + cos(radians(32)) * cos(radians(image_id % 90)) * pow(sin(radians((image_id % 180 - 35) / 2.0::DOUBLE)), 2))), 2) AS metres FROM images")
def fn_haversine(images: DataFrame) -> DataFrame:
    return images.select("image_id", F.round(S.haversine(F.lit(32.0), F.lit(35.0), (F.col("image_id") % 90).cast("double"), (F.col("image_id") % 180).cast("double")), 2).alias("metres"))


@add("spots", sql="SELECT image_id, spot_id, round(sin(pi() * axis_t), 6) AS s0, round(cos(pi() * 2 * axis_t), 6) AS c1 FROM spots")
def fn_sinusoidal(spots: DataFrame) -> DataFrame:
    w = S.sinusoidal("axis_t", 2)
    return spots.select("image_id", "spot_id", F.round(w[0], 6).alias("s0"), F.round(w[3], 6).alias("c1"))


@add("vectors", sql="""
    WITH b AS (SELECT spot_id, CAST(embedding[1:6] AS DOUBLE[]) AS e FROM vectors),
    s AS (SELECT *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + 1) * sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + 1) AS size FROM b)
    SELECT spot_id, round(e[1] * e[4] / size, 6) AS first, round(e[3] / size, 6) AS edge, round(1 / size, 6) AS last, 16::BIGINT AS n FROM s""")
def fn_tensor_combine(vectors: DataFrame) -> DataFrame:
    """The outer product of two blocks, each with a one appended and then of unit length."""
    t = S.outer(F.slice("embedding", 1, 3), F.slice("embedding", 4, 3))
    return vectors.select("spot_id", F.round(t[0], 6).alias("first"), F.round(t[11], 6).alias("edge"), F.round(t[15], 6).alias("last"), F.size(t).cast("bigint").alias("n"))


@add("images", sql="""
    WITH r AS (SELECT individual_id, image_id, row_number() OVER (PARTITION BY individual_id ORDER BY image_id) - 1 AS k, count(*) OVER (PARTITION BY individual_id) AS n FROM images)
    SELECT individual_id, n, string_agg(CAST(image_id AS VARCHAR), ' ' ORDER BY k) AS points FROM r
    WHERE n <= 5 OR k = n - 1 OR (k % CAST(ceil(n / 5.0) AS BIGINT) = 0 AND k < 4 * CAST(ceil(n / 5.0) AS BIGINT)) GROUP BY 1, 2""")
def fn_decimate(images: DataFrame) -> DataFrame:
    """Long arrays thinned to at most five points, the last kept."""
    rows = images.groupBy("individual_id").agg(F.sort_array(F.collect_list("image_id")).alias("p"))
    return rows.select("individual_id", F.size("p").cast("bigint").alias("n"), F.array_join(S.decimate("p", 5), " ").alias("points"))


@add("spots", sql="SELECT image_id, array_to_string(list(CAST(CAST(round(axis_t * 100) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(area) AS BIGINT) AS VARCHAR) ORDER BY spot_id), ' ') AS points FROM spots GROUP BY 1")
def fn_zip_xy(spots: DataFrame) -> DataFrame:
    """Two arrays as points."""
    rows = spots.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("spot_id", F.round(F.col("axis_t") * 100).cast("bigint").alias("x"), F.round("area").cast("bigint").alias("y")))).alias("s"))
    zipped = F.zip_with(F.col("s.x"), F.col("s.y"), lambda x, y: F.concat_ws(":", x.cast("string"), y.cast("string")))
    return rows.select("image_id", F.concat_ws(" ", zipped).alias("points"))


@add("individuals", sql="SELECT individual_id, regexp_extract(display_id, '[0-9]+') AS digits, CAST(regexp_extract(display_id, '[0-9]+') AS BIGINT) AS number, 'Customer' AS stem FROM individuals")
def fn_natural_key(individuals: DataFrame) -> DataFrame:
    """Names cleaned of format characters and taken apart into stem and number."""
    odd = F.concat(F.lit("‏"), "display_id", F.lit("​"))
    clean = X.strip_format(odd)
    return individuals.select("individual_id", X.first_digits(clean).alias("digits"), X.first_digits(clean).cast("bigint").alias("number"), F.split_part(clean, F.lit("#"), F.lit(1)).alias("stem"))


@add("images", sql="SELECT image_id, CAST(image_id % 30 AS INT) AS year, 'B' AS series, CAST(image_id AS BIGINT) AS number FROM images WHERE image_id % 2 = 0")
def fn_parse_kf(images: DataFrame) -> DataFrame:
    """Year, series and number from file names like KF-<year>-<series>-<number>.jpg; others are left out."""
    name = F.when(F.col("image_id") % 2 == 0, F.format_string("KF-%02d-b-%04d.jpg", (F.col("image_id") % 30).cast("int"), F.col("image_id"))).otherwise("other.jpg")
    return X.parse_catalogue(images.select("image_id", name.alias("name")), "name").where("year IS NOT NULL").select("image_id", "year", "series", "number")


@add("individuals", sql="SELECT individual_id, CASE individual_id % 3 WHEN 0 THEN 'ab' WHEN 1 THEN 'gd' ELSE '' END AS code FROM individuals")
def fn_translit(individuals: DataFrame) -> DataFrame:
    """Codes from Hebrew names by the place of letters in the alphabet."""
    k = F.col("individual_id") % 3
    name = F.when(k == 0, "אבג").when(k == 1, "גא דב").otherwise("latin")
    return individuals.select("individual_id", X.name_code(name).alias("code"))


@add("verdicts", sql="SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN accepted THEN ['fine', label] ELSE ['poor'] END) AS reason FROM verdicts) GROUP BY 1")
def fn_reasons_explode(verdicts: DataFrame) -> DataFrame:
    reasons = F.when(F.col("accepted"), F.array(F.lit("fine"), "label")).otherwise(F.array(F.lit("poor")))
    return verdicts.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@add("spots")
def fn_polyline(spots: DataFrame) -> DataFrame:
    """Length, turning and Fourier shape of the line through an image's spots."""
    rows = spots.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("axis_t", "area", "spot_id"))).alias("s"))
    rows = rows.select("image_id", F.transform("s", lambda x: F.array(x["axis_t"] * 100, x["area"])).alias("line"))

    def measure(parts):
        import pyarrow as pa

        for part in parts:
            line, length, curl = part.column("line"), np.zeros(part.num_rows), np.zeros(part.num_rows)
            for at, z in G.polylines(line):
                length[at], curl[at] = np.abs(np.diff(z, axis=1)).sum(1), G.curls(z)
            yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array(length), pa.array(curl), G.lists(G.described(line))], names=["image_id", "length", "curl", "shape"])

    return rows.mapInArrow(measure, "image_id long, length double, curl double, shape array<double>")


@add("images")
def fn_clip_polygon(images: DataFrame) -> DataFrame:
    """The eight boxes of bodies of several lengths, cut to the image."""
    rows = images.select("image_id", (20 + F.col("image_id") % 60).cast("double").alias("long"))

    def run(parts):
        import pandas as pd

        sides, bins = np.array([side for _, side in G.BOX], object), np.array(list(G.BOX.values()))
        for part in parts:
            area = G.box_areas(np.stack([np.full(len(part), 10 + 50j), 10 + part.long.to_numpy() + 55j], 1), 100, 100)
            row, box = np.nonzero(~np.isnan(area))
            yield pd.DataFrame({"image_id": part.image_id.to_numpy()[row], "bin": bins[box], "side": sides[box], "area": area[row, box]})

    return rows.mapInPandas(run, "image_id long, bin int, side string, area double")


@add("spots")
def rebin_axis(spots: DataFrame) -> DataFrame:
    """Spots placed anew after the line of their image was corrected."""
    rows = spots.select("image_id", "spot_id", (F.col("axis_t") * 100).alias("x"), (F.col("axis_offset") * 500).alias("y"), F.lit(None).cast("array<array<double>>").alias("outline"))
    line = lambda y: F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (50.0, y), (100.0, 0.0))))
    old = rows.select("image_id").distinct().withColumn("midline", line(0.0))
    new = old.where("image_id % 80 = 0").withColumn("midline", line(20.0))
    from ..sources.sinks import upsert

    return G.bin_spots(rows, upsert(old, new, ["image_id"]), "image_id").drop("outline")


# Matching


@add("vectors", sql=f"WITH {_V}, p AS (SELECT a.spot_id AS q, b.individual_id AS candidate, max(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.photo_id <> b.photo_id GROUP BY 1, 2) SELECT photo_id, candidate, round(avg(s), 6) AS score FROM p JOIN v ON spot_id = q GROUP BY 1, 2")
def match_pooled(vectors: DataFrame) -> DataFrame:
    """Each photo against the pooled other photos of each individual, by the mean of best similarities."""
    return _pooled(vectors, PO.SoftChamfer())


def _pooled(vectors: DataFrame, scorer: PO.Scorer) -> DataFrame:
    spots = vectors.select(F.col("spot_id").alias("id"), F.col("photo_id").alias("grp"), F.col("individual_id").alias("owner"), F.col("embedding").alias("e"))
    return PO.pooled(spots, scorer).select(F.col("photo").alias("photo_id"), F.col("owner").alias("candidate"), F.round("score", 6).alias("score"))


@add("vectors", sql=f"WITH {_V}, p AS (SELECT a.spot_id AS q, a.photo_id, b.individual_id AS candidate, ln(avg(exp((list_cosine_similarity(a.e, b.e) - 1) / 0.1))) AS s FROM v a JOIN v b ON a.photo_id <> b.photo_id GROUP BY 1, 2, 3) SELECT photo_id, candidate, round(avg(s), 6) AS score FROM p GROUP BY 1, 2")
def match_pooled_density(vectors: DataFrame) -> DataFrame:
    """Each photo against the pooled other photos of each individual, by how densely they lie around its spots."""
    return _pooled(vectors, PO.SoftDensity(0.1))


@add("vectors", sql=f"WITH {_V} SELECT a.spot_id AS a, b.spot_id AS b FROM v a JOIN v b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id WHERE list_cosine_similarity(a.e, b.e) >= 0.25")
def match_threshold(vectors: DataFrame) -> DataFrame:
    """All links above a cosine between the photos of an individual."""
    return T.met(_spots(vectors), 0.25, (), bare=True).select(F.col("q").alias("a"), F.col("g").alias("b"))


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, {_GEO}, z AS (SELECT *, greatest(s, 0) AS seen FROM r),
    c AS (SELECT a, b, round(sum(gw * (s >= 0.3)::INT) / (sum(gw) + 1e-9), 6) AS candidate_over, round(sum(gw * (s < 0.2)::INT) / (sum(gw) + 1e-9), 6) AS open_candidate FROM r WHERE back = 1 GROUP BY 1, 2),
    f AS (SELECT a, b, round(sum(qw * seen) / (sum(qw) + 1e-9), 6) AS w_mean, round(sum(qw * seen), 6) AS w_total, round(max(s), 6) AS best, round(sum(qw * (s < 0.2)::INT) / (sum(qw) + 1e-9), 6) AS open_query, round(max(qw * (1 - seen)) / (max(qw) + 1e-9), 6) AS worst_open,
      {", ".join(f"round(sum(qw * (s >= {x})::INT) / (sum(qw) + 1e-9), 6) AS w_over_{k}" for k, x in enumerate((0.4, 0.3, 0.2), 1))}, round(1 - exp(-(count(*) FILTER (WHERE back = 1 AND s >= 0.3)) / 2.5::DOUBLE), 6) AS support, count(*) FILTER (WHERE back = 1) AS mutual, round((count(*) FILTER (WHERE back = 1)) / count(*)::DOUBLE, 6) AS mutual_share
      FROM z WHERE k = 1 GROUP BY 1, 2)
    SELECT f.*, candidate_over, open_candidate, g."order" FROM f JOIN c USING (a, b) JOIN geometry g USING (a, b)""")
def match_strict_features(vectors: DataFrame) -> DataFrame:
    """Features weighted by distinctiveness; that of a fitted transform is in `match_ransac`."""
    return _rounded(T.strict_features(T.matched(_spots(vectors)), (0.4, 0.3, 0.2), 0.3, 0.3, 0.2))


@add("vectors")
def match_spotdesc(vectors: DataFrame) -> DataFrame:
    """Constellation and shape numbers together."""
    shaped = vectors.withColumn("embedding", F.slice("embedding", 1, 3))
    return _over(shaped, lambda x, y: {"score": K.spot_descriptor_match(_xy(x), _xy(y), x["e"], y["e"])}, "exy", "score double")


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, two AS (SELECT i.a, i.b, i.q, i.gt - i.qt AS own, j.gt - j.qt AS other, row_number() OVER (PARTITION BY i.a, i.b, i.q ORDER BY abs(i.qt - j.qt), j.q) AS n FROM l i JOIN l j ON i.a = j.a AND i.b = j.b AND i.q <> j.q),
    e AS (SELECT a, b, q, count(*) AS others, -abs(max(own) - median(other)) AS residual, avg((abs(own - other) <= 0.05 + 1e-9)::INT) FILTER (WHERE n <= 3) AS support FROM two GROUP BY 1, 2, 3),
    cq AS (SELECT a, b, q, cume_dist() OVER (PARTITION BY a, b ORDER BY qt) AS cq FROM r WHERE k = 1), cg AS (SELECT a, b, g, cume_dist() OVER (PARTITION BY a, b ORDER BY gt) AS cg FROM r WHERE back = 1)
    SELECT a, b, q AS i, g AS j, round(s, 6) AS cosine, CASE WHEN others >= 2 THEN round(residual, 6) + 0 END AS residual, CASE WHEN others >= 2 THEN round(support, 6) END AS support, round(-abs(cq - cg), 6) + 0 AS rank_agree FROM l LEFT JOIN e USING (a, b, q) JOIN cq USING (a, b, q) JOIN cg USING (a, b, g)""")
def edge_relational(vectors: DataFrame) -> DataFrame:
    """Each mutual link against the other links of its pair."""
    return _rounded(T.relational(T.matched(_spots(vectors))))


@add("vectors", sql=f"""
    WITH {_V}, {_SETS}, {_GEO}, g AS (SELECT a, b, "order" AS geom_spearman, neighbours AS geom_nbr_agree, one_shift AS geom_axial_inliers, kendall AS geom_kendall, sides AS geom_side_agree, gain AS geom_excess FROM geometry)
    SELECT a, b, statistic, value FROM (UNPIVOT g ON geom_spearman, geom_nbr_agree, geom_axial_inliers, geom_kendall, geom_side_agree, geom_excess INTO NAME statistic VALUE value)""")
def geom_order(vectors: DataFrame) -> DataFrame:
    """The geometry of links, one row for each statistic."""
    found = _rounded(T.geometry(T.links(T.matched(_spots(vectors)))))
    names = {"geom_spearman": "order", "geom_nbr_agree": "neighbours", "geom_axial_inliers": "one_shift", "geom_kendall": "kendall", "geom_side_agree": "sides", "geom_excess": "gain"}
    return found.select("a", "b", F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(c).alias("value")) for n, c in names.items()))).alias("x")).select("a", "b", "x.*")


@add("spots", sql="WITH r AS (SELECT image_id, spot_id, (row_number() OVER (PARTITION BY image_id ORDER BY area, spot_id) - 1) / greatest(count(*) OVER (PARTITION BY image_id) - 1, 1)::DOUBLE AS size, (row_number() OVER (PARTITION BY image_id ORDER BY mass, spot_id) - 1) / greatest(count(*) OVER (PARTITION BY image_id) - 1, 1)::DOUBLE AS bulk FROM spots) SELECT image_id, spot_id, round(0.25::DOUBLE * size + 0.75::DOUBLE * bulk, 6) AS blend FROM r")
def blend_weights(spots: DataFrame) -> DataFrame:
    """The factors blended by other weights."""
    return Q.blend(spots, ["image_id"], ["spot_id"], {"size": "area", "bulk": "mass"}, {"size": 1.0, "bulk": 3.0}).select("image_id", "spot_id", F.round("blend", 6).alias("blend"))


@add("spots")
def build_embeddings(spots: DataFrame) -> DataFrame:
    """Shape and place of each spot as one vector of 62 numbers."""
    a, b = F.col("area"), F.col("area") * (0.5 + F.col("axis_t") / 2)
    outline = F.array(F.array(-a, -b), F.array(F.lit(0.0), -b / 2), F.array(a, -b), F.array(a, b), F.array(-a, b))
    rows = spots.select("image_id", "spot_id", outline.alias("outline"), "axis_t", (F.col("axis_offset") * 20).alias("offset"), F.when(F.col("axis_offset") >= 0, "left").otherwise("right").alias("side"))
    return E.build(rows)


_HALF = _U.format("'half:' || sibling")


@add("vectors", sql=f"""
    WITH {_V}, t AS (SELECT *, ((spot_id * 29) % 97) / 97.0::DOUBLE AS t FROM v),
    p AS (SELECT a.photo_id AS a, b.photo_id AS b, a.spot_id AS q, b.spot_id AS g, list_cosine_similarity(a.e, b.e) AS c, a.t AS ta, b.t AS tb FROM t a JOIN t b ON a.individual_id = b.individual_id AND a.photo_id < b.photo_id),
    s AS (SELECT a, b, q, g, 'as_is' AS way, (c + exp(-pow(ta - tb, 2) / 0.045)) / 2 AS s FROM p UNION ALL SELECT a, b, q, g, 'turned', (c + exp(-pow(1 - ta - tb, 2) / 0.045)) / 2 FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY way, q, b ORDER BY s DESC, g) AS k, row_number() OVER (PARTITION BY way, a, g ORDER BY s DESC, q) AS back FROM s),
    n AS (SELECT a, b, count(*) FILTER (WHERE way = 'as_is' AND k = 1 AND back = 1 AND s >= 0.5) AS as_is, count(*) FILTER (WHERE way = 'turned' AND k = 1 AND back = 1 AND s >= 0.5) AS turned FROM r GROUP BY 1, 2),
    h AS (SELECT a AS photo, b AS sibling, as_is, turned FROM n UNION ALL SELECT b, a, as_is, turned FROM n), d AS (SELECT *, {_HALF} < 0.5 AS own FROM h)
    SELECT photo, count(*) AS siblings, CAST(sum(as_is) AS BIGINT) AS as_is, CAST(sum(turned) AS BIGINT) AS turned, CAST(sum(turned - as_is) FILTER (WHERE own) AS BIGINT) AS gain, CAST(sum(turned - as_is) FILTER (WHERE NOT own) AS BIGINT) AS held_out,
      coalesce(sum(turned - as_is) FILTER (WHERE own) > 0 AND sum(turned - as_is) FILTER (WHERE NOT own) > 0, FALSE) AS suspect FROM d GROUP BY 1""")
def axis_flip_scan(vectors: DataFrame) -> DataFrame:
    """Does turning the axis around give more mutual links with the other photos of an individual?

    Links weigh the likeness of spots and of their places alike. The gain over one half of the siblings, by hash, decides,
    and that over the other half must agree; without siblings in a half nothing is suspect.
    """

    out = T.turned_spots(_spots(vectors), 0.045, 0.5)
    side = lambda p, q: out.select(F.col(p).alias("photo"), F.col(q).alias("sibling"), "as_is", "turned")
    rows = side("a", "b").unionByName(side("b", "a")).withColumn("own", N.uniform(F.lit("half"), "sibling") < 0.5)
    more = F.col("turned") - F.col("as_is")
    out = rows.groupBy("photo").agg(F.count(F.lit(1)).alias("siblings"), F.sum("as_is").alias("as_is"), F.sum("turned").alias("turned"), F.sum(F.when(F.col("own"), more)).alias("gain"), F.sum(F.when(~F.col("own"), more)).alias("held_out"))
    return out.withColumn("suspect", F.coalesce((F.col("gain") > 0) & (F.col("held_out") > 0), F.lit(False)))


# Metrics and samples


@add("verdicts", sql="""
    WITH o AS (SELECT sum((NOT novel AND accepted)::INT) OVER w AS tp, sum((NOT novel)::INT) OVER w AS k, sum(novel::INT) OVER w AS fp, count(*) OVER w AS n, sum((NOT novel)::INT) OVER () AS nk, sum(novel::INT) OVER () AS nn FROM verdicts WINDOW w AS (ORDER BY score DESC, edge_id ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT tp / n::DOUBLE AS p, tp / nk::DOUBLE AS r, 0.5 * (k / nk::DOUBLE + (nn - fp) / nn::DOUBLE) AS b FROM o)
    SELECT (SELECT round(avg(accepted::INT), 6) FROM verdicts WHERE NOT novel) AS r1, round(max(CASE WHEN 0.25 * p + r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END), 6) AS census_f, round(max(b), 6) AS bal_acc FROM f""")
def m_pooled(verdicts: DataFrame) -> DataFrame:
    """Rank-1, best census F0.5 and best balanced accuracy over all prefixes of falling score."""
    return M.pooled(verdicts, "score", "edge_id", ~F.col("novel"), F.col("accepted"))


_SIGMAS, _CUTS = [0.12, 0.25, 0.5, 1.0], [k / 50 for k in range(1, 20)]
_F = "CASE WHEN tp > 0 THEN 1.25::DOUBLE * (tp / (tp + fp)::DOUBLE) * (tp / p::DOUBLE) / (0.25::DOUBLE * (tp / (tp + fp)::DOUBLE) + tp / p::DOUBLE) ELSE 0 END"


@add("verdicts", "vectors", sql=f"""
    WITH {_V}, e AS (SELECT CAST(floor({_U.format("'fold:' || a.individual_id")} * 3) AS INT) AS fold, list_cosine_similarity(a.e, b.e) AS c, CASE WHEN edge_id % 5 <> 0 THEN pow((edge_id * 29 % 97 - (edge_id + 1) * 29 % 97) / 97.0::DOUBLE, 2) END AS d2, accepted AS y
      FROM verdicts JOIN v a ON a.spot_id = edge_id JOIN v b ON b.spot_id = edge_id + 1 WHERE accepted IS NOT NULL),
    g AS (SELECT s, sigma FROM (SELECT unnest(range({len(_SIGMAS)})) AS s, unnest({_SIGMAS})::DOUBLE AS sigma)), cuts AS (SELECT unnest({_CUTS})::DOUBLE AS t),
    q AS (SELECT fold, s, y, CAST(floor(greatest(c, 0) * coalesce(exp(-d2 / (2 * sigma * sigma)), 1) * 1000 + 1e-9) AS INT) AS bin FROM e, g),
    f AS (SELECT CAST(unnest(range(-1, 3)) AS INT) AS fold),
    train AS (SELECT f.fold, s, bin, y FROM q JOIN f ON q.fold <> f.fold), test AS (SELECT f.fold, s, bin, y FROM q JOIN f ON q.fold = f.fold OR f.fold = -1),
    k AS (SELECT fold, s, y, rank() OVER w + (count(*) OVER (PARTITION BY fold, s, bin) - 1) / 2.0::DOUBLE AS k FROM train WINDOW w AS (PARTITION BY fold, s ORDER BY bin)),
    a AS (SELECT fold, s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, round((sum(k) FILTER (WHERE y) - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) AS auroc FROM k GROUP BY 1, 2),
    width AS (SELECT fold, s FROM a WHERE p > 0 AND n > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY auroc DESC, s) = 1),
    l AS (SELECT fold, s, t, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE y AND bin >= round(t * 1000)) AS tp, count(*) FILTER (WHERE NOT y AND bin >= round(t * 1000)) AS fp FROM train JOIN width USING (fold, s), cuts GROUP BY 1, 2, 3),
    cut AS (SELECT fold, s, t FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round({_F}, 9) DESC, t) = 1), good AS (SELECT min(t) AS good FROM l WHERE fold = -1 AND tp > 0 AND tp >= 0.9 * (tp + fp)),
    o AS (SELECT fold, s, t, count(*) AS n, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE y AND bin >= round(t * 1000)) AS tp, count(*) FILTER (WHERE NOT y AND bin >= round(t * 1000)) AS fp FROM test, cuts GROUP BY 1, 2, 3)
    SELECT o.fold, sigma, o.t AS threshold, round({_F.replace("tp", "o.tp").replace("fp", "o.fp").replace("/ p", "/ o.p")}, 6) AS f_test, round({_F.replace("tp", "x.tp").replace("fp", "x.fp").replace("/ p", "/ x.p")}, 6) AS f_current, o.n, CASE WHEN o.fold = -1 THEN good END AS good_threshold
    FROM cut JOIN o USING (fold, s, t) JOIN g USING (s) JOIN o x ON x.fold = o.fold AND x.s = 1 AND x.t = 0.2, good WHERE o.p > 0""")
def m_gate_fit(verdicts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Width and cut of the position gate of judged edges, chosen across individuals and tried on those left out."""
    place = lambda c: c * 29 % 97
    end = lambda n, shift: vectors.select((F.col("spot_id") - shift).alias("edge_id"), F.col("embedding").alias(n), *([F.col("individual_id").alias("individual")] if not shift else []))
    edges = verdicts.select("edge_id", "accepted").join(end("a", 0), "edge_id").join(end("b", 1), "edge_id")
    apart = F.pow((place(F.col("edge_id")) - place(F.col("edge_id") + 1)) / 97.0, 2)
    edges = edges.select("individual", "accepted", S.cosine("a", "b").alias("cos"), F.when(F.col("edge_id") % 5 != 0, apart).alias("d2"))
    return M.gate_fit(edges, "individual", "cos", "d2", "accepted", _SIGMAS, _CUTS, (0.25, 0.2), folds=3)


@add("images", sql=f"WITH p AS (SELECT image_id, individual_id, row_number() OVER (PARTITION BY individual_id ORDER BY {_U.format(chr(39) + 'photo:' + chr(39) + ' || image_id')}, image_id) AS k, count(*) OVER (PARTITION BY individual_id) AS n FROM images WHERE NOT is_synthetic), l AS (SELECT individual_id FROM p WHERE n >= 2 GROUP BY 1 ORDER BY {_U.format(chr(39) + 'label:' + chr(39) + ' || individual_id')}, individual_id LIMIT 16) SELECT image_id, individual_id FROM p WHERE k <= 2 AND individual_id IN (SELECT individual_id FROM l)")
def sample_pk(images: DataFrame) -> DataFrame:
    """16 individuals with two photos each, by hash."""
    w = Window.partitionBy("individual_id")
    p = images.where("NOT is_synthetic").select("image_id", "individual_id", F.row_number().over(w.orderBy(N.uniform(F.lit("photo"), "image_id"), "image_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n")).where("k <= 2 AND n >= 2")
    chosen = p.where("k = 1").select("individual_id").orderBy(N.uniform(F.lit("label"), "individual_id"), "individual_id").limit(16)
    return p.join(chosen, "individual_id", "left_semi").select("image_id", "individual_id")


@add("images")
def gen_population(images: DataFrame) -> DataFrame:
    """Generated identities, photos and spots."""
    return E.population(images.sparkSession, 20, 3, 12)


# Learned scorers


def _folds(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("edge_id", F.log1p("score").alias("x"), (F.col("score") % 7).alias("y"), "accepted", "novel", N.fold_of("label", 3).alias("fold"))


@add("verdicts")
def ml_conf_rel(verdicts: DataFrame) -> DataFrame:
    """Out-of-fold confidence without class weights."""
    return ML.out_of_fold(_folds(verdicts), ["x", "y"], "accepted", "fold", 3).select("edge_id", "confidence")


@add("verdicts")
def ml_novelty(verdicts: DataFrame) -> DataFrame:
    """Out-of-fold probability of being new."""
    return ML.out_of_fold(_folds(verdicts), ["x", "y"], "novel", "fold", 3, balanced=True).select("edge_id", "confidence")


@add("vectors")
def ml_survival(vectors: DataFrame) -> DataFrame:
    """Out-of-fold probability that a spot survives to another photo."""
    from .matching import spot_survival

    rows = spot_survival(vectors).select("spot_id", (F.col("survived") > 0).alias("alive"), "best_sim", F.col("siblings").cast("double").alias("n"), N.fold_of("photo_id", 2).alias("fold"))
    return ML.out_of_fold(rows, ["best_sim", "n"], "alive", "fold", 2, balanced=True).select("spot_id", "confidence")


@add("spots")
def ml_distinct(spots: DataFrame) -> DataFrame:
    """Out-of-fold probability that a spot is interesting, from its own numbers, folds by image."""
    rows = spots.select("image_id", "spot_id", "area", "axis_t", (F.col("mass") > 40000).alias("interesting"), N.fold_of("image_id", 2).alias("fold"))
    return ML.out_of_fold(rows, ["area", "axis_t"], "interesting", "fold", 2, balanced=True).select("image_id", "spot_id", "confidence")


@add("vectors", sql=f"""
    WITH {_V}, b AS (SELECT a.spot_id AS q, a.photo_id AS query, b.photo_id AS photo, b.individual_id, max(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.photo_id <> b.photo_id GROUP BY 1, 2, 3, 4),
    p AS (SELECT query, individual_id, photo, avg(s) AS sim FROM b GROUP BY 1, 2, 3), i AS (SELECT query, CAST(individual_id AS VARCHAR) AS candidate, max(sim) AS sim, arg_max(photo, sim) AS photo FROM p GROUP BY 1, 2),
    c AS (SELECT *, 1 / (1 + exp(-(6 * sim - 3))) AS c FROM i)
    SELECT query, candidate, photo, round(c, 4) AS confidence, row_number() OVER (PARTITION BY query ORDER BY c DESC, candidate) AS rank,
      CASE WHEN query LIKE '%\\_0' ESCAPE '\\' THEN 'confirmed' ELSE 'matched' END AS status, CASE WHEN query LIKE '%\\_0' ESCAPE '\\' THEN 0 ELSE 1 END AS rev FROM c QUALIFY rank <= 5""")
def wf_match(vectors: DataFrame) -> DataFrame:
    """Each photo against the gallery: best photos, calibrated, ranked, the first five; committed with the photos' status and read back."""
    best = P.best_in_groups(_sides(vectors), _sides(vectors))
    owner = vectors.select(F.col("photo_id").alias("g_group"), S.code("photo_id").alias("owner")).distinct()
    found = P.soft_chamfer(best, owner).withColumn("c", S.sigmoid_platt("sim", 6.0, -3.0))
    found = R.first_per(found.withColumn("rank", F.row_number().over(Window.partitionBy("q_group").orderBy(F.col("c").desc(), "owner")).cast("bigint")), ["q_group"], "rank", n=5)
    found = found.select(F.col("q_group").alias("query"), "rank", F.col("owner").alias("candidate"), F.col("g_group").alias("photo"), F.col("sim").alias("similarity"), F.round("c", 4).alias("confidence"))
    store = Store(vectors.sparkSession, scratch_folder(vectors.sparkSession))
    photos = vectors.select(F.col("photo_id").alias("image_id"), F.when(F.col("photo_id").endswith("_0"), "confirmed").otherwise("extracted").alias("status"), F.lit(0).alias("rev")).distinct()
    store.commit(store.snapshot(), {"images": Put(photos, ("image_id",))}, "load")
    now = W.record_matches(store, written(found), "soft chamfer", 0.9, 5)
    state = now.table("images").withColumnRenamed("image_id", "query")
    return W.latest_candidates(now).join(state, "query").select("query", "candidate", "photo", "confidence", "rank", "status", "rev")
