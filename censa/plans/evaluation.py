"""Queries for ranks and evaluation metrics, over human verdicts, model scores and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as M
from ..operators import ranking as R
from .roles import Catalogue

catalogue = Catalogue()
add = catalogue.add

# Ranks


@add("models", sql="SELECT kind, model_id, round(1 / (1 + exp(-(6 * bal_acc - 3))), 4) AS confidence, row_number() OVER (PARTITION BY kind ORDER BY 1 / (1 + exp(-(6 * bal_acc - 3))) DESC, model_id) AS rank FROM models QUALIFY rank <= 5")
def rank_candidates(models: DataFrame) -> DataFrame:
    """Candidates of each query by calibrated confidence."""
    rows = models.select("kind", "model_id", S.sigmoid_platt("bal_acc", 6.0, -3.0).alias("c"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("c").desc(), "model_id")).cast("bigint")).where("rank <= 5")
    return rows.select("kind", "model_id", F.round("c", 4).alias("confidence"), "rank")


@add("models", sql="""
    SELECT kind, model_id, rank FROM (SELECT kind, model_id, row_number() OVER (PARTITION BY kind ORDER BY bal_acc DESC, model_id) AS rank,
      coalesce(sum(bal_acc) OVER (PARTITION BY kind ORDER BY bal_acc DESC, model_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(bal_acc) OVER (PARTITION BY kind) AS total FROM models)
    WHERE rank = 1 OR (before / total + 1e-9 < 0.5 AND rank <= 20)""")
def rank_top_n_coverage(models: DataFrame) -> DataFrame:
    """The fewest candidates that cover half of a query's confidence."""
    return R.coverage(models.select("kind", "model_id", "bal_acc"), "kind", "bal_acc", "model_id", 0.5, 20).select("kind", "model_id", F.col("rank").cast("bigint").alias("rank"))


@add("images", sql="SELECT individual_id, image_id, blur FROM images WHERE blur IS NOT NULL QUALIFY row_number() OVER (PARTITION BY individual_id ORDER BY blur DESC, image_id) = 1")
def rank_best_per_key(images: DataFrame) -> DataFrame:
    rows = images.where("blur IS NOT NULL").groupBy("individual_id").agg(F.max(F.struct("blur", (-F.col("image_id")).alias("m"))).alias("b"))
    return rows.select("individual_id", (-F.col("b.m")).alias("image_id"), "b.blur")


@add("verdicts", sql="SELECT edge_id, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM verdicts")
def rank_avg_ties(verdicts: DataFrame) -> DataFrame:
    """Average ranks of all rows, from the counts of distinct scores."""
    return R.average_places(verdicts.select("edge_id", "score"), "score", "r").select("edge_id", "r")


@add("verdicts", sql="SELECT edge_id, round((rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY label), 6) AS pct FROM verdicts")
def rank_pct(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("edge_id", F.round(R.percent_of_rank("score", "label"), 6).alias("pct"))


@add("verdicts", sql="SELECT edge_id, round((row_number() OVER (PARTITION BY label ORDER BY score, edge_id) - 1) / greatest(count(*) OVER (PARTITION BY label) - 1, 1)::DOUBLE, 6) AS place FROM verdicts")
def rank_rank01(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("edge_id", F.round(R.rank01("score", ["edge_id"], "label"), 6).alias("place"))


@add("spots", sql="WITH s AS (SELECT image_id, spot_id, round(sqrt(4 * area / pi()) / nullif(image_id % 40, 0), 9) AS d FROM spots), r AS (SELECT *, 100.0::DOUBLE * (row_number() OVER (ORDER BY d, image_id, spot_id) - 1) / greatest(count(*) OVER () - 1, 1) AS p FROM s WHERE d IS NOT NULL) SELECT image_id, spot_id, round(p, 6) AS pct FROM s LEFT JOIN r USING (image_id, spot_id)")
def rank_size_pct(spots: DataFrame) -> DataFrame:
    """Percentile of a spot's diameter in body lengths among all spots; null without a body length. No task holds all spots."""
    length = F.nullif(F.col("image_id") % 40, F.lit(0))
    rows = spots.select("image_id", "spot_id", F.round(F.sqrt(4 * F.col("area") / F.pi()) / length, 9).alias("d"))
    return R.size_percentile(rows, "d", ["image_id", "spot_id"]).select("image_id", "spot_id", F.round("pct", 6).alias("pct"))


@add("models", sql="SELECT model_id, round((rank() OVER (PARTITION BY kind ORDER BY blur) - 1) / greatest(count(*) OVER (PARTITION BY kind) - 1, 1)::DOUBLE, 6) AS pct, round((blur - avg(blur) OVER (PARTITION BY kind)) / stddev_samp(blur) OVER (PARTITION BY kind), 6) AS z FROM models")
def rank_percentile_bisect(models: DataFrame) -> DataFrame:
    """Share of values below, and z-score, within a kind."""
    w = Window.partitionBy("kind")
    pct = (F.rank().over(w.orderBy("blur")) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1))
    return models.select("model_id", F.round(pct, 6).alias("pct"), F.round(F.try_divide(F.col("blur") - F.avg("blur").over(w), F.stddev_samp("blur").over(w)), 6).alias("z"))


_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, edge_id) AS place FROM verdicts)"


@add("verdicts", sql=f"WITH {_RANKED}, firsts AS (SELECT label, min(place) AS place FROM ranked WHERE accepted GROUP BY 1) SELECT round(avg((place <= 1)::INT), 6) AS r1, round(avg((place <= 5)::INT), 6) AS r5, round(avg((place <= 10)::INT), 6) AS r10, round(avg(1.0::DOUBLE / place), 6) AS mrr, quantile_cont(place, 0.5) AS median_rank FROM firsts")
def rank_true_position(verdicts: DataFrame) -> DataFrame:
    return M.true_positions(verdicts, "label", "score", "accepted", "edge_id")


@add("models", sql="SELECT kind, max(CASE WHEN k = 1 THEN model_id END) AS best, max(CASE WHEN k = 1 THEN bal_acc END) AS top1, coalesce(max(CASE WHEN k = 2 THEN bal_acc END), 0) AS top2, max(CASE WHEN k = 1 THEN bal_acc END) - coalesce(max(CASE WHEN k = 2 THEN bal_acc END), 0) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bal_acc DESC, model_id) AS k FROM models) WHERE k <= 2 GROUP BY 1")
def rank_top2_margin(models: DataFrame) -> DataFrame:
    return R.top_two(models, "kind", "bal_acc", "model_id")


@add("models", sql="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY bal_acc DESC, model_id) AS k, max(bal_acc) OVER (PARTITION BY kind) AS top FROM models)
    SELECT kind, round(max(top), 6) AS top1, round(max(top) - coalesce(max(CASE WHEN k = 2 THEN bal_acc END), 0), 6) AS margin, round(max(CASE WHEN k = 2 THEN bal_acc END) / max(top), 6) AS ratio,
      round((max(top) - avg(bal_acc)) / stddev_pop(bal_acc), 6) AS z, round(max(top) - quantile_cont(bal_acc, 0.5), 6) AS over_median, round(max(top) - avg(CASE WHEN k <= 5 THEN bal_acc END), 6) AS over_top5, round(stddev_pop(bal_acc), 6) AS spread,
      round(quantile_cont(bal_acc, 0.75) - quantile_cont(bal_acc, 0.25), 6) AS iqr, round(avg((bal_acc >= 0.9 * top)::INT), 6) AS near, round(ln(1 + count(*)), 6) AS log_n FROM r GROUP BY kind""")
def rank_relative_features(models: DataFrame) -> DataFrame:
    """Ten features of a query's score list."""
    w = Window.partitionBy("kind")
    r = models.withColumn("k", F.row_number().over(w.orderBy(F.col("bal_acc").desc(), "model_id"))).withColumn("top", F.max("bal_acc").over(w))
    x, second, top = F.col("bal_acc"), F.max(F.when(F.col("k") == 2, F.col("bal_acc"))), F.max("top")
    q = lambda p: F.percentile(x, F.lit(p))
    out = {"top1": top, "margin": top - F.coalesce(second, F.lit(0.0)), "ratio": F.try_divide(second, top), "z": F.try_divide(top - F.avg(x), F.stddev_pop(x)), "over_median": top - q(0.5), "over_top5": top - F.avg(F.when(F.col("k") <= 5, x)), "spread": F.stddev_pop(x), "iqr": q(0.75) - q(0.25), "near": F.avg((x >= 0.9 * F.col("top")).cast("double")), "log_n": F.log1p(F.count(F.lit(1)))}
    return r.groupBy("kind").agg(*(F.round(v, 6).alias(n) for n, v in out.items()))


@add("verdicts", sql=f"WITH {_RANKED} SELECT edge_id, CAST(sum(accepted::INT) OVER w AS BIGINT) AS tp, CAST(sum((NOT accepted)::INT) OVER w AS BIGINT) AS fp, round(sum(accepted::INT) OVER w / place::DOUBLE, 6) AS precision, round(CASE WHEN sum(accepted::INT) OVER (PARTITION BY label) > 0 THEN sum(accepted::INT) OVER w / sum(accepted::INT) OVER (PARTITION BY label)::DOUBLE ELSE 0 END, 6) AS recall FROM ranked WINDOW w AS (PARTITION BY label ORDER BY place ROWS UNBOUNDED PRECEDING)")
def win_running_prf(verdicts: DataFrame) -> DataFrame:
    out = R.running_prf(verdicts, ["label"], "score", "accepted", "edge_id")
    return out.select("edge_id", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@add("verdicts", sql=f"""
    WITH {_RANKED}, c AS (SELECT label, place, 1 - avg(accepted::INT) OVER w AS risk, place::DOUBLE / count(*) OVER (PARTITION BY label) AS cover FROM ranked WINDOW w AS (PARTITION BY label ORDER BY place ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT label, (risk + lag(risk) OVER v) / 2 * (cover - lag(cover) OVER v) AS area FROM c WINDOW v AS (PARTITION BY label ORDER BY place))
    SELECT label, round(sum(area), 6) AS aurc FROM a GROUP BY 1""")
def win_risk_coverage(verdicts: DataFrame) -> DataFrame:
    return M.risk_coverage(verdicts, "score", "accepted", "edge_id", "label")


@add("individuals", sql="SELECT individual_id, row_number() OVER (PARTITION BY site_id ORDER BY CAST(split_part(display_id, '#', 2) AS BIGINT), display_id) AS number FROM individuals")
def win_renumber(individuals: DataFrame) -> DataFrame:
    """Numbers from 1 in natural order within a site."""
    return individuals.select("individual_id", F.row_number().over(Window.partitionBy("site_id").orderBy(S.natural_key("display_id"))).cast("bigint").alias("number"))


@add("images", sql="SELECT image_id, coalesce(top, -1) + row_number() OVER (PARTITION BY individual_id ORDER BY image_id) AS k FROM (SELECT *, max(CASE WHEN is_synthetic THEN n_spots END) OVER (PARTITION BY individual_id) AS top FROM images) WHERE NOT is_synthetic")
def win_next_synth_idx(images: DataFrame) -> DataFrame:
    """The next free synthetic numbers of each individual."""
    w = Window.partitionBy("individual_id")
    rows = images.withColumn("top", F.max(F.when(F.col("is_synthetic"), F.col("n_spots"))).over(w)).where(~F.col("is_synthetic"))
    return rows.select("image_id", (F.coalesce("top", F.lit(-1)) + F.row_number().over(w.orderBy("image_id"))).cast("bigint").alias("k"))


@add("verdicts", sql=f"WITH {_RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM ranked) SELECT edge_id, CASE WHEN place <= 3 THEN 'top' WHEN place > n - 3 THEN 'bottom' ELSE 'mid' END AS slice FROM n WHERE place <= 3 OR place > n - 3 OR (place > n // 2 - 1 AND place <= n // 2 + 2)")
def win_slices(verdicts: DataFrame) -> DataFrame:
    """The top, middle and bottom three of each label."""
    w = Window.partitionBy("label")
    rows = verdicts.select("edge_id", F.row_number().over(w.orderBy(F.col("score").desc(), "edge_id")).alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    half = F.floor(F.col("n") / 2)
    top, bottom, mid = F.col("place") <= 3, F.col("place") > F.col("n") - 3, (F.col("place") > half - 1) & (F.col("place") <= half + 2)
    return rows.where(top | bottom | mid).select("edge_id", F.when(top, "top").when(bottom, "bottom").otherwise("mid").alias("slice"))


# Metrics


@add("verdicts", sql=f"WITH {_RANKED}, h AS (SELECT *, sum(accepted::INT) OVER (PARTITION BY label ORDER BY place ROWS UNBOUNDED PRECEDING) AS hit FROM ranked), q AS (SELECT label, min(place) AS first, avg(hit / place::DOUBLE) AS ap FROM h WHERE accepted GROUP BY 1) SELECT count(*) AS queries, round(avg((first <= 1)::INT), 6) AS rank1, round(avg((first <= 5)::INT), 6) AS rank5, round(avg(ap), 6) AS map FROM q")
def m_rank_k_map(verdicts: DataFrame) -> DataFrame:
    return M.rank_k_map(verdicts, "label", "score", "accepted", "edge_id", 1, 5)


_AUC = "SELECT method, round((sum(CASE WHEN {t} THEN r END) - count(*) FILTER (WHERE {t}) * (count(*) FILTER (WHERE {t}) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE {t}) * count(*) FILTER (WHERE NOT {t}), 0), 6) AS auroc FROM (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS r FROM verdicts) GROUP BY 1"


@add("verdicts", sql=_AUC.format(t="accepted"))
def m_roc_auc(verdicts: DataFrame) -> DataFrame:
    return M.roc_auc(verdicts, "score", "accepted", "method")


@add("verdicts", sql=_AUC.format(t="novel"))
def m_openset_auroc(verdicts: DataFrame) -> DataFrame:
    """How well the best similarity tells new from known queries."""
    return M.roc_auc(verdicts, "score", "novel", "method")


@add("verdicts", sql="WITH r AS (SELECT sum(accepted::INT) OVER w AS tp, sum((NOT accepted)::INT) OVER w AS fp, sum(accepted::INT) OVER () AS p, sum((NOT accepted)::INT) OVER () AS n FROM verdicts WINDOW w AS (ORDER BY score DESC, edge_id ROWS UNBOUNDED PRECEDING)) SELECT round(coalesce(max(CASE WHEN fp / n::DOUBLE <= 0.1 THEN tp / p::DOUBLE END), 0), 6) AS tpr FROM r")
def m_tpr_at_fpr(verdicts: DataFrame) -> DataFrame:
    return M.tpr_at_fpr(verdicts, "score", "accepted", 0.1, "edge_id")


_SWEEP = "c AS (SELECT method, score, count(*) FILTER (WHERE accepted) AS pos, count(*) FILTER (WHERE NOT accepted) AS neg FROM verdicts GROUP BY 1, 2), t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method) AS p FROM c WINDOW w AS (PARTITION BY method ORDER BY score DESC)), f AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, CASE WHEN p > 0 THEN tp / p::DOUBLE ELSE 0 END AS re FROM t)"


@add("verdicts", sql=f"WITH {_SWEEP} SELECT method, score AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN 0.25 * pr + re > 0 THEN 1.25 * pr * re / (0.25 * pr + re) ELSE 0 END, 6) AS fbeta FROM f QUALIFY row_number() OVER (PARTITION BY method ORDER BY round(CASE WHEN 0.25 * pr + re > 0 THEN 1.25 * pr * re / (0.25 * pr + re) ELSE 0 END, 6) DESC, score DESC) = 1")
def m_best_fbeta(verdicts: DataFrame) -> DataFrame:
    return M.best_fbeta(verdicts, "score", "accepted", 0.5, "method")


@add("verdicts", sql="WITH s AS (SELECT count(*) FILTER (WHERE accepted AND score >= 300) AS tp, count(*) FILTER (WHERE NOT accepted AND score >= 300) AS fp, count(*) FILTER (WHERE accepted AND score < 300) AS fn FROM verdicts), r AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS q FROM s) SELECT tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(1.25 * p * q / (0.25 * p + q), 6) AS fbeta FROM r")
def m_fbeta_at(verdicts: DataFrame) -> DataFrame:
    return M.fbeta_at(verdicts, "score", "accepted", 300.0)


@add("verdicts", sql=f"WITH {_RANKED}, h AS (SELECT *, sum(accepted::INT) OVER (PARTITION BY label ORDER BY place ROWS UNBOUNDED PRECEDING) / place::DOUBLE AS p FROM ranked) SELECT label, round(avg(CASE WHEN accepted THEN p END), 6) AS average_precision FROM h GROUP BY 1")
def m_avg_precision(verdicts: DataFrame) -> DataFrame:
    return M.average_precision(verdicts, "score", "accepted", "edge_id", "label")


@add("verdicts", sql="WITH s AS (SELECT count(*) FILTER (WHERE score >= 500 AND NOT novel AND accepted) AS tp, count(*) FILTER (WHERE score >= 500 AND NOT novel AND NOT accepted) AS fp_known, count(*) FILTER (WHERE score < 500 AND NOT novel) AS fn, count(*) FILTER (WHERE score < 500 AND novel) AS tn, count(*) FILTER (WHERE score >= 500 AND novel) AS fp_novel FROM verdicts) SELECT *, round(fn / nullif(tp + fp_known + fn, 0)::DOUBLE, 6) AS inflation, round(fp_novel / nullif(tn + fp_novel, 0)::DOUBLE, 6) AS deflation FROM s")
def m_census_confusion(verdicts: DataFrame) -> DataFrame:
    return M.census_confusion(verdicts.withColumn("known", ~F.col("novel")), "score", "known", "accepted", 500.0)


_GRID = [100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0]
_GRID_SQL = "(SELECT unnest([100.0, 200.0, 400.0, 800.0, 1600.0, 3200.0])::DOUBLE AS threshold)"


@add("verdicts", sql=f"SELECT threshold, count(*) FILTER (WHERE score >= threshold AND accepted AND NOT novel) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT accepted AND NOT novel) AS fp_known, count(*) FILTER (WHERE score >= threshold AND novel) AS fp_novel FROM verdicts, {_GRID_SQL} GROUP BY 1")
def m_census_sweep(verdicts: DataFrame) -> DataFrame:
    """Census outcomes at a grid of thresholds, in one pass."""
    known = ~F.col("novel")
    return M.at_thresholds(verdicts, _GRID, "score", ("tp", F.col("accepted") & known), ("fp_known", ~F.col("accepted") & known), ("fp_novel", F.col("novel")))


@add("verdicts", sql=f"SELECT threshold, round(count(*) FILTER (WHERE score >= threshold AND NOT novel) / count(*) FILTER (WHERE NOT novel)::DOUBLE, 6) AS known_recall, round(count(*) FILTER (WHERE score < threshold AND novel) / count(*) FILTER (WHERE novel)::DOUBLE, 6) AS novel_recall FROM verdicts, {_GRID_SQL} GROUP BY 1")
def m_novelty(verdicts: DataFrame) -> DataFrame:
    """Known and novel recall at each threshold; the totals are those of the lowest threshold of all."""
    counts = M.at_thresholds(verdicts, [float("-inf"), *_GRID], "score", ("known", ~F.col("novel")), ("novel", F.col("novel")))
    w = Window.partitionBy()
    out = counts.select("threshold", F.try_divide("known", F.max("known").over(w)).alias("k"), (1 - F.try_divide("novel", F.max("novel").over(w))).alias("v"))
    return out.where(F.col("threshold") > float("-inf")).select("threshold", F.round("k", 6).alias("known_recall"), F.round("v", 6).alias("novel_recall"))


@add("verdicts", sql="""
    WITH c AS (SELECT score, count(*) FILTER (WHERE NOT novel AND accepted) AS pos, count(*) FILTER (WHERE NOT (NOT novel AND accepted)) AS neg FROM verdicts GROUP BY 1),
    t AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos + neg) OVER () AS BIGINT) AS n FROM c WINDOW w AS (ORDER BY score DESC)),
    g AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (SELECT count(*) FROM verdicts WHERE NOT novel)::DOUBLE AS r FROM t WHERE EXISTS (SELECT 1 FROM range(200) AS r(k) WHERE (k * (n - 1) + 198) // 199 BETWEEN n - tp - fp AND n - tp - fp + pos + neg - 1)),
    f AS (SELECT *, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0), 6) AS fbeta FROM g)
    SELECT score AS threshold, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, fbeta FROM f ORDER BY fbeta DESC, score LIMIT 1""")
def m_census_best(verdicts: DataFrame) -> DataFrame:
    """The census threshold with the best F0.5 on the grid of quantiles."""
    return M.census_best(verdicts.withColumn("known", ~F.col("novel")), "score", "known", "accepted")


@add("verdicts", sql="""
    WITH c AS (SELECT score, count(*) FILTER (WHERE NOT novel) AS pos, count(*) FILTER (WHERE novel) AS neg FROM verdicts GROUP BY 1),
    t AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () AS BIGINT) AS p, CAST(sum(neg) OVER () AS BIGINT) AS n FROM c WINDOW w AS (ORDER BY score DESC)),
    g AS (SELECT * FROM t WHERE EXISTS (SELECT 1 FROM range(200) AS r(k) WHERE (k * (p + n - 1) + 198) // 199 BETWEEN p + n - tp - fp AND p + n - tp - fp + pos + neg - 1)),
    s AS (SELECT score, tp / p::DOUBLE AS k, 1 - fp / n::DOUBLE AS v, 2 * tp / (tp + fp + p)::DOUBLE AS f FROM g),
    u AS (SELECT 'balanced' AS criterion, *, round((k + v) / 2, 6) AS value FROM s UNION ALL SELECT 'youden', *, round(k + v - 1, 6) FROM s UNION ALL SELECT 'f1', *, round(f, 6) FROM s)
    SELECT criterion, score AS threshold, round(k, 6) AS known_recall, round(v, 6) AS novel_recall, value FROM u QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY value DESC, score) = 1""")
def m_threshold_choice(verdicts: DataFrame) -> DataFrame:
    """The threshold between known and new by balanced accuracy, Youden's index and F1, on the grid of quantiles."""
    return M.choose_thresholds(verdicts.withColumn("known", ~F.col("novel")), "score", "known")


@add("verdicts", sql=f"WITH {_SWEEP.replace('method, score,', 'score,').replace('GROUP BY 1, 2', 'GROUP BY 1').replace('PARTITION BY method ', '').replace('PARTITION BY method', '')}, n AS (SELECT sum(pos + neg) AS n FROM c) SELECT round(coalesce(max(CASE WHEN pr >= 0.85 THEN (tp + fp) / n::DOUBLE END), 0), 6) AS coverage FROM f, n")
def m_cov_at_precision(verdicts: DataFrame) -> DataFrame:
    return M.coverage_at_precision(verdicts, "score", "accepted", 0.85)


@add("verdicts", sql="WITH d AS (SELECT abs(score - 500) AS conf, (score >= 500) = accepted AS ok FROM verdicts), c AS (SELECT conf, count(*) FILTER (WHERE ok) AS pos, count(*) AS n FROM d GROUP BY 1), t AS (SELECT sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(n) OVER () AS total FROM c WINDOW w AS (ORDER BY conf DESC)) SELECT round(1 - coalesce(max(CASE WHEN tp / seen::DOUBLE >= 0.6 THEN seen / total::DOUBLE END), 0), 6) AS review FROM t")
def m_review_at_90(verdicts: DataFrame) -> DataFrame:
    """The share left for review when answers farthest from the cut are taken first, at the accuracy asked for."""
    rows = verdicts.select(F.abs(F.col("score") - 500).alias("conf"), ((F.col("score") >= 500) == F.col("accepted")).alias("ok"))
    return M.coverage_at_precision(rows, "conf", "ok", 0.6).select(F.round(1 - F.col("coverage"), 6).alias("review"))


@add("verdicts", sql="WITH r AS (SELECT row_number() OVER w AS k, avg(accepted::INT) OVER (ORDER BY score, edge_id ROWS UNBOUNDED PRECEDING) AS acc FROM verdicts WINDOW w AS (ORDER BY score, edge_id)) SELECT coalesce(max(CASE WHEN acc < 0.7 THEN k END), 0) AS n FROM r")
def m_abstain_point(verdicts: DataFrame) -> DataFrame:
    """The longest prefix of low scores whose accuracy stays below the target."""
    return M.abstain_point(verdicts, "score", "accepted", "edge_id", 0.7)


_WILSON = "CASE WHEN n > 0 THEN {f}((k / n::DOUBLE + 3.8416 / (2 * n)) / (1 + 3.8416 / n) {s} 1.96 / (1 + 3.8416 / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4 * n * n)), {e}) END"


@add("verdicts", sql=f"WITH b AS (SELECT CASE WHEN score >= 2000 THEN 'high' WHEN score >= 500 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (WHERE accepted) AS k FROM verdicts GROUP BY 1) SELECT band, n, round(k / n::DOUBLE, 6) AS acc, round({_WILSON.format(f='greatest', s='-', e='0')}, 6) AS lo, round({_WILSON.format(f='least', s='+', e='1')}, 6) AS hi FROM b")
def m_conf_bands(verdicts: DataFrame) -> DataFrame:
    """Accuracy of each band with its Wilson interval."""
    band = F.when(F.col("score") >= 2000, "high").when(F.col("score") >= 500, "mid").otherwise("low")
    rows = verdicts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("k"))
    lo, hi = S.wilson("k", "n")
    return rows.select("band", "n", F.round(F.col("k") / F.col("n"), 6).alias("acc"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@add("verdicts", sql="WITH e AS (SELECT unnest([0, 1, 2, 3]) AS b, unnest([quantile_cont(score, 0), quantile_cont(score, 0.25), quantile_cont(score, 0.5), quantile_cont(score, 0.75)]) AS lo, unnest([quantile_cont(score, 0.25), quantile_cont(score, 0.5), quantile_cont(score, 0.75), quantile_cont(score, 1)]) AS hi FROM verdicts) SELECT CAST(b AS INT) AS bucket, count(*) AS n, round(avg(score), 6) AS mean, round(avg(accepted::INT), 6) AS rate FROM e JOIN verdicts ON score >= lo AND score <= hi GROUP BY 1")
def m_reliability(verdicts: DataFrame) -> DataFrame:
    """Calibration by quartile; both edges belong to a bucket, so a score on an edge counts twice."""
    edges = verdicts.agg(F.percentile("score", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("e"))
    rows = verdicts.join(F.broadcast(edges))  # one row is broadcast
    inside = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("score") >= F.col("e")[k]) & (F.col("score") <= F.col("e")[k + 1]))
    return rows.select(F.explode(inside).alias("bucket"), "score", "accepted").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(F.col("accepted").cast("double")), 6).alias("rate"))


@add("images", sql="WITH e AS (SELECT quantile_cont(blur, 1/3::DOUBLE) AS a, quantile_cont(blur, 2/3::DOUBLE) AS b FROM images WHERE blur IS NOT NULL), s AS (SELECT unnest(['low', 'mid', 'high']) AS stratum, unnest([-1, a, b]) AS lo, unnest([a, b, 2]) AS hi FROM e) SELECT stratum, count(*) AS n, round(avg((status = 'confirmed')::INT), 6) AS acc FROM s JOIN images ON blur >= lo AND blur <= hi GROUP BY 1")
def m_quality_strata(images: DataFrame) -> DataFrame:
    """Accuracy by quality tercile, edges belonging to both sides."""
    rows = images.where("blur IS NOT NULL").select("blur", (F.col("status") == "confirmed").cast("double").alias("ok"))
    edges = rows.agg(F.percentile("blur", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("e"))
    rows = rows.join(F.broadcast(edges))  # one row is broadcast
    lo, hi, x = F.col("e")[0], F.col("e")[1], F.col("blur")
    strata = F.array_compact(F.array(F.when(x <= lo, "low"), F.when((x >= lo) & (x <= hi), "mid"), F.when(x >= hi, "high")))
    return rows.select(F.explode(strata).alias("stratum"), "ok").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("acc"))


_RANKS = "rank() OVER (PARTITION BY method ORDER BY {x}) + (count(*) OVER (PARTITION BY method, {x}) - 1) / 2.0::DOUBLE"


@add("verdicts", sql=f"""
    WITH v AS (SELECT method, score, accepted::INT AS share, CAST(edge_id % 7 AS INT) AS links FROM verdicts), c AS (SELECT method, quantile_cont(score, 0.333) AS lo, quantile_cont(score, 0.667) AS hi FROM v GROUP BY 1),
    r AS (SELECT method, {_RANKS.format(x='score')} AS a, {_RANKS.format(x='share')} AS b, {_RANKS.format(x='links')} AS d FROM v), k AS (SELECT method, round(CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS rho, round(CASE WHEN stddev_pop(a) * stddev_pop(d) > 0 THEN corr(a, d) END, 6) AS rho_count FROM r GROUP BY 1),
    t AS (SELECT method, count(*) AS n, avg(CASE WHEN score <= lo THEN share END) AS low, avg(CASE WHEN score >= hi THEN share END) AS high FROM v JOIN c USING (method) GROUP BY 1)
    SELECT method, rho, rho_count, n, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS delta, coalesce(sign(rho) <> sign(rho_count) AND abs(rho_count) > 0.05, FALSE) AS confounded FROM k JOIN t USING (method)""")
def m_comparability(verdicts: DataFrame) -> DataFrame:
    """Rank correlation of a factor with share and count of matches, the shares in its outer thirds, and whether the signs disagree."""
    rows = verdicts.select("method", "score", F.col("accepted").cast("int").alias("share"), (F.col("edge_id") % 7).cast("int").alias("links"))
    return M.comparability(rows, "score", "share", "links", "method")


@add("verdicts", sql=_AUC.format(t="accepted").replace("method, round(", "half, round(").replace("PARTITION BY method", "PARTITION BY half").replace("FROM verdicts)", "FROM (SELECT *, CASE WHEN edge_id >= (SELECT quantile_cont(edge_id, 0.5) FROM verdicts) THEN 'above' ELSE 'below' END AS half FROM verdicts))"))
def m_interaction(verdicts: DataFrame) -> DataFrame:
    """AUROC on either side of the median of a factor."""
    cut = verdicts.agg(F.percentile("edge_id", F.lit(0.5)).alias("cut"))
    rows = verdicts.join(F.broadcast(cut)).withColumn("half", F.when(F.col("edge_id") >= F.col("cut"), "above").otherwise("below"))  # one row is broadcast
    return M.roc_auc(rows, "score", "accepted", "half")


@add("verdicts", sql=f"WITH k AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS n, count(*) FILTER (WHERE score >= threshold AND accepted) AS k, count(*) FILTER (WHERE accepted) AS p FROM verdicts, {_GRID_SQL} GROUP BY 1) SELECT threshold, n, k, round(k / nullif(n, 0)::DOUBLE, 6) AS precision, round({_WILSON.format(f='greatest', s='-', e='0')}, 6) AS lo, round({_WILSON.format(f='least', s='+', e='1')}, 6) AS hi FROM k")
def m_mining_audit(verdicts: DataFrame) -> DataFrame:
    """Precision and yield of mined correspondences at each cutoff, with Wilson intervals."""
    rows = M.at_thresholds(verdicts, _GRID, "score", ("n", F.lit(True)), ("k", F.col("accepted")))
    lo, hi = S.wilson("k", "n")
    return rows.select("threshold", "n", "k", F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")), 6).alias("precision"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@add("verdicts", sql="""
    WITH e AS (SELECT *, score >= 400 AS yes, (edge_id % 10) / 10.0::DOUBLE AS ta, (edge_id % 13) / 13.0::DOUBLE AS tb FROM verdicts)
    SELECT method, count(*) AS judged, round(count(*) FILTER (WHERE accepted AND yes) / nullif(count(*) FILTER (WHERE yes), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE accepted AND yes) / nullif(count(*) FILTER (WHERE accepted), 0)::DOUBLE, 6) AS recall,
      round(count(*) FILTER (WHERE accepted) / nullif(count(*) FILTER (WHERE accepted OR novel), 0)::DOUBLE, 6) AS extraction, round(avg(CASE WHEN accepted THEN abs(ta - tb) END), 6) AS drift, coalesce(avg(CASE WHEN accepted THEN abs(ta - (1 - tb)) END) < avg(CASE WHEN accepted THEN abs(ta - tb) END), FALSE) AS inverted FROM e GROUP BY 1""")
def m_edge_prf(verdicts: DataFrame) -> DataFrame:
    """Precision and recall over judged edges, extraction recall, drift along the axis, and whether the axis looks turned.

    `novel` marks a spot whose partner was not extracted.
    """
    rows = verdicts.select("method", "accepted", "novel", (F.col("score") >= 400).alias("yes"), ((F.col("edge_id") % 10) / 10.0).alias("ta"), ((F.col("edge_id") % 13) / 13.0).alias("tb"))
    return M.edge_prf(rows, "yes", "accepted", "novel", "ta", "tb", "method")


@add("verdicts", sql="""
    WITH per AS (SELECT label, count(*) FILTER (WHERE accepted) AS k, count(*) AS n, row_number() OVER (ORDER BY label NULLS FIRST) - 1 AS p, count(*) OVER () AS clusters FROM verdicts GROUP BY 1),
    d AS (SELECT rep, CAST(floor(CAST('0x' || substr(md5(rep || ':' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * clusters) AS BIGINT) AS p
      FROM range(2000) r(rep), (SELECT p AS draw, clusters FROM per)),
    m AS (SELECT rep, sum(k) / nullif(sum(n), 0)::DOUBLE AS v FROM d JOIN per USING (p) GROUP BY 1)
    SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM m""")
def m_cluster_bootstrap(verdicts: DataFrame) -> DataFrame:
    """Percentile interval of a rate over 2,000 resamples of as many individuals as there are."""
    from ..operators.sampling import cluster_bootstrap

    return cluster_bootstrap(verdicts, "label", "accepted", 2000)


_TIMES = " + ".join(f"(u >= {p})::INT" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563))


@add("verdicts", sql=f"""
    WITH r AS (SELECT unnest(range(200)) AS rep),
    one AS (SELECT label, count(*) FILTER (WHERE accepted) - count(*) FILTER (WHERE score >= 400) AS k, count(*) AS n FROM verdicts GROUP BY 1),
    two AS (SELECT novel AS side, label, count(*) FILTER (WHERE accepted) AS k, count(*) AS n FROM verdicts GROUP BY 1, 2),
    u1 AS (SELECT rep, k, n, CAST('0x' || substr(md5(CAST(rep AS VARCHAR) || ':' || label), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM one, r),
    u2 AS (SELECT rep, side, k, n, CAST('0x' || substr(md5(CAST(rep AS VARCHAR) || ':' || CAST(side AS VARCHAR) || ':' || label), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM two, r),
    v AS (SELECT 'paired' AS kind, rep, sum(t * k) / nullif(sum(t * n), 0)::DOUBLE AS v FROM (SELECT *, {_TIMES} AS t FROM u1) GROUP BY 2
      UNION ALL SELECT 'two samples', rep, sum(t * k) FILTER (WHERE side) / nullif(sum(t * n) FILTER (WHERE side), 0)::DOUBLE - sum(t * k) FILTER (WHERE NOT side) / nullif(sum(t * n) FILTER (WHERE NOT side), 0)::DOUBLE FROM (SELECT *, {_TIMES} AS t FROM u2) GROUP BY 2)
    SELECT kind, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v GROUP BY 1""")
def m_bootstrap_delta(verdicts: DataFrame) -> DataFrame:
    """Intervals of differences of rates under resampling of individuals: two measures of the same rows, and two sets of rows."""
    from ..operators.sampling import paired_delta, two_sample_delta

    yes = F.col("accepted")
    one = paired_delta(verdicts, "label", yes, F.col("score") >= 400, 200).withColumn("kind", F.lit("paired"))
    return one.unionByName(two_sample_delta(verdicts, "label", yes, F.col("novel"), 200).withColumn("kind", F.lit("two samples")))


@add("verdicts", sql="SELECT label, round(avg(CASE WHEN NOT isnan(v) THEN v END), 6) AS mean FROM (SELECT label, method, CASE WHEN count(*) FILTER (WHERE novel) > 0 THEN count(*) FILTER (WHERE novel AND accepted) / count(*) FILTER (WHERE novel)::DOUBLE ELSE 'nan'::DOUBLE END AS v FROM verdicts GROUP BY 1, 2) GROUP BY 1")
def m_fold_aggregate(verdicts: DataFrame) -> DataFrame:
    """Mean over folds that skips folds without a value."""
    n = F.count_if("novel")
    folds = verdicts.groupBy("label", "method").agg(F.when(n > 0, F.count_if(F.col("novel") & F.col("accepted")) / n).otherwise(F.lit(float("nan"))).alias("v"))
    return folds.groupBy("label").agg(F.round(F.avg(F.when(~F.isnan("v"), F.col("v"))), 6).alias("mean"))
