"""Evaluation metrics over scored pairs and queries. Sums over falling scores run on counts of distinct scores, not on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fbeta
from ..sources.sinks import written
from .ranking import prefix_sums, running


def score_counts(df: DataFrame, score: str, truth: str, *group: str) -> DataFrame:
    """(group, score, pos, neg): the table all threshold metrics start from; a row for each distinct score."""
    return df.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))


def prefixes(counts: DataFrame, score: str, *group: str) -> DataFrame:
    """Adds tp and fp of the threshold at each score, and the totals P and N.

    Distinct scores may be as many as rows, so they are summed in ranges of equal numbers, by group as well.
    """
    out = prefix_sums(counts, list(group), [F.col(score).desc()], tp=F.col("pos"), fp=F.col("neg"))
    return out.withColumnsRenamed({"tp_all": "P", "fp_all": "N"})


def on_quantiles(rows: DataFrame, steps: int) -> DataFrame:
    """Of `prefixes` those scores that are quantiles of the rows' scores: the first at or above each of `steps` even shares."""
    n = F.col("P") + F.col("N")
    below = n - F.col("tp") - F.col("fp")
    place = lambda k: F.floor((k * (n - 1) + (steps - 2)) / (steps - 1))
    return rows.where(F.exists(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: (place(k) >= below) & (place(k) < below + F.col("pos") + F.col("neg"))))


def choose_thresholds(df: DataFrame, score: str, known: str, steps: int = 200) -> DataFrame:
    """(criterion, threshold, known_recall, novel_recall, value): the best threshold on the quantile grid by three criteria.

    balanced is the mean of both recalls, youden their sum less 1, f1 that of the known class; of equals the lowest
    threshold counts. No rows where one class is missing.
    """
    rows = on_quantiles(prefixes(score_counts(df, score, known), score), steps).where("P > 0 AND N > 0")
    rows = rows.select(F.col(score).alias("threshold"), (F.col("tp") / F.col("P")).alias("k"), (1 - F.col("fp") / F.col("N")).alias("v"), (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P"))).alias("f"))
    worth = {"balanced": (F.col("k") + F.col("v")) / 2, "youden": F.col("k") + F.col("v") - 1, "f1": F.col("f")}
    each = rows.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), F.round(x, 6).alias("value")) for n, x in worth.items()))).alias("c"))
    best = each.groupBy("c.criterion").agg(F.max(F.struct(F.col("c.value").alias("value"), (-F.col("threshold")).alias("low"), "k", "v")).alias("b"))
    return best.select("criterion", (-F.col("b.low")).alias("threshold"), F.round("b.k", 6).alias("known_recall"), F.round("b.v", 6).alias("novel_recall"), "b.value")


def roc_auc(df: DataFrame, score: str, truth: str, *group: str) -> DataFrame:
    """Mann-Whitney AUROC, ties counting half; null where a class is missing."""
    rows = prefixes(score_counts(df, score, truth, *group), score, *group)
    won = rows.groupBy(*group).agg(F.sum(F.col("pos") * (F.col("N") - F.col("fp")) + F.col("pos") * F.col("neg") / 2.0).alias("won"), F.max("P").alias("P"), F.max("N").alias("N"))
    return won.select(*group, F.round(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("won") / (F.col("P") * F.col("N"))), 6).alias("auroc"))


def average_precision(df: DataFrame, score: str, truth: str, tie: str, *group: str) -> DataFrame:
    """Mean, over the positives by falling score, of the precision at their place."""
    rows = prefix_sums(df.select(*group, score, truth, tie), list(group), [F.col(score).desc(), F.col(tie)], _h=F.col(truth).cast("int"), _n=F.lit(1))
    return rows.groupBy(*group).agg(F.round(F.avg(F.when(F.col(truth), F.col("_h") / F.col("_n"))), 6).alias("average_precision"))


def best_fbeta(df: DataFrame, score: str, truth: str, beta: float = 0.5, *group: str) -> DataFrame:
    """(threshold, precision, recall, fbeta) of the threshold with the best F-beta, the highest threshold of equals."""
    rows = prefixes(score_counts(df, score, truth, *group), score, *group)
    rows = rows.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(0.0))
    rows = rows.withColumn("f", F.round(fbeta("precision", "recall", beta), 6))
    best = rows.groupBy(*group).agg(F.max(F.struct("f", F.col(score).alias("threshold"), "precision", "recall")).alias("b"))
    return best.select(*group, "b.threshold", F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"), F.col("b.f").alias("fbeta"))


def fbeta_at(df: DataFrame, score: str, truth: str, threshold: float, beta: float = 0.5) -> DataFrame:
    hit, own = F.col(score) >= threshold, F.col(truth)
    sums = df.agg(F.count_if(hit & own).alias("tp"), F.count_if(hit & ~own).alias("fp"), F.count_if(~hit & own).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return sums.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(fbeta(p, r, beta), 6).alias("fbeta"))


def tpr_at_fpr(df: DataFrame, score: str, truth: str, most: float, tie: str) -> DataFrame:
    """TPR of the longest prefix of rows (by falling score) whose FPR is at most `most`."""
    hit = F.col(truth).cast("int")
    rows = running(df.select(score, tie, truth), score, tie, True, tp=hit, fp=1 - hit)
    return rows.agg(F.round(F.coalesce(F.max(F.when(F.coalesce(F.try_divide("fp", "fp_all"), F.lit(0.0)) <= most, F.try_divide("tp", "tp_all"))), F.lit(0.0)), 6).alias("tpr"))


def pooled(df: DataFrame, score: str, tie: str, known: Column, right: Column) -> DataFrame:
    """(r1, census_f, bal_acc): rank-1 of known rows, best census F0.5 and best balanced accuracy over prefixes of falling score."""
    rows = df.select(score, tie, known.alias("_k"), (known & right).alias("_h"))
    one = lambda c: F.col(c).cast("int")
    o = running(rows, score, tie, True, tp=one("_h"), k=one("_k"), fp=1 - one("_k"), n=F.lit(1))
    balanced = 0.5 * (F.try_divide("k", "k_all") + F.try_divide(F.col("fp_all") - F.col("fp"), "fp_all"))
    return o.agg(F.round(F.max(F.try_divide("tp_all", "k_all")), 6).alias("r1"), F.round(F.max(fbeta(F.col("tp") / F.col("n"), F.try_divide("tp", "k_all"))), 6).alias("census_f"), F.round(F.max(balanced), 6).alias("bal_acc"))


def abstain_point(df: DataFrame, score: str, right: str, tie: str, target: float) -> DataFrame:
    """(n): the longest prefix of rising scores whose accuracy stays below the target; 0 if there is none."""
    rows = running(df.select(score, tie, right), score, tie, k=F.lit(1), hit=F.col(right).cast("int"), seen=F.col(right).isNotNull().cast("int"))
    return rows.agg(F.coalesce(F.max(F.when(F.try_divide("hit", "seen") < target, F.col("k"))), F.lit(0)).cast("bigint").alias("n"))


def rank_k_map(df: DataFrame, query: str, score: str, same: str, tie: str, *ks: int) -> DataFrame:
    """rank-k and mean average precision over queries that have a positive candidate."""
    w = Window.partitionBy(query)
    order = w.orderBy(F.col(score).desc(), tie)
    rows = df.withColumn("place", F.row_number().over(order)).withColumn("hit", F.sum(F.col(same).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = rows.where(F.col(same)).groupBy(query).agg(F.min("place").alias("first"), F.avg(F.col("hit") / F.col("place")).alias("ap"))
    return per.agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg((F.col("first") <= k).cast("double")), 6).alias(f"rank{k}") for k in ks), F.round(F.avg("ap"), 6).alias("map"))


def true_positions(df: DataFrame, query: str, score: str, same: str, tie: str) -> DataFrame:
    """R@1, R@5, R@10, mean reciprocal rank and median rank of the true candidate."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), tie)
    first = df.withColumn("place", F.row_number().over(order)).where(F.col(same)).groupBy(query).agg(F.min("place").alias("place"))
    at = lambda k: F.round(F.avg((F.col("place") <= k).cast("double")), 6).alias(f"r{k}")
    return first.agg(at(1), at(5), at(10), F.round(F.avg(1 / F.col("place")), 6).alias("mrr"), F.percentile("place", F.lit(0.5)).alias("median_rank"))


def census_confusion(df: DataFrame, score: str, known: str, right: str, threshold: float) -> DataFrame:
    """Open-set census outcomes at a threshold: known and right, known but wrong, missed, rejected, and new taken for known."""
    yes, known, right = F.col(score) >= threshold, F.col(known), F.col(right)
    sums = df.agg(
        F.count_if(yes & known & right).alias("tp"),
        F.count_if(yes & known & ~right).alias("fp_known"),
        F.count_if(~yes & known).alias("fn"),
        F.count_if(~yes & ~known).alias("tn"),
        F.count_if(yes & ~known).alias("fp_novel"),
    )
    all_known = F.col("tp") + F.col("fp_known") + F.col("fn")
    new = F.col("tn") + F.col("fp_novel")
    return sums.select("*", F.round(F.when(all_known > 0, F.col("fn") / all_known), 6).alias("inflation"), F.round(F.when(new > 0, F.col("fp_novel") / new), 6).alias("deflation"))


def census_best(df: DataFrame, score: str, known: str, right: str, beta: float = 0.5, steps: int = 200) -> DataFrame:
    """(threshold, tp, fp, precision, recall, fbeta) of the threshold on the quantile grid with the best census F-beta.

    Right links of known ones count; recall is over all known ones. Of equals the lowest threshold counts.
    """
    rows = df.where(F.col(score).isNotNull())
    total = rows.agg(F.count_if(F.col(known)).alias("known"))
    grid = on_quantiles(prefixes(score_counts(rows.withColumn("_hit", F.col(known) & F.col(right)), score, "_hit"), score), steps).join(F.broadcast(total))  # one row
    grid = grid.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.coalesce(F.try_divide("tp", "known"), F.lit(0.0)))
    best = grid.agg(F.max(F.struct(F.round(fbeta("precision", "recall", beta), 6).alias("f"), (-F.col(score)).alias("low"), "tp", "fp", "precision", "recall")).alias("b")).where("b IS NOT NULL")
    return best.select((-F.col("b.low")).alias("threshold"), "b.tp", "b.fp", F.round("b.precision", 6).alias("precision"), F.round("b.recall", 6).alias("recall"), F.col("b.f").alias("fbeta"))


def at_thresholds(df: DataFrame, thresholds: list[float], score: str, *counts: tuple[str, Column]) -> DataFrame:
    """(threshold, name ...): for each threshold how many rows at or above it satisfy each condition, in one pass.

    Rows are first counted by the highest threshold they reach; the counts are then summed downwards, so the work does not
    grow with rows times thresholds.
    """
    grid = sorted(set(float(t) for t in thresholds))
    reach = F.lit(0)
    for t in grid:
        reach = reach + (F.col(score) >= t).cast("int")
    per = df.where(F.col(score).isNotNull()).groupBy(reach.alias("_r")).agg(*(F.count_if(c).alias(n) for n, c in counts))
    steps = df.sparkSession.createDataFrame([(k + 1, t) for k, t in enumerate(grid)], "_r int, threshold double")
    down = Window.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.join(per, "_r", "left").select("threshold", *(F.sum(F.coalesce(n, F.lit(0))).over(down).alias(n) for n, _ in counts))


def coverage_at_precision(df: DataFrame, score: str, right: str, least: float) -> DataFrame:
    """The largest share of rows that a threshold can answer with at least this precision."""
    rows = prefixes(score_counts(df, score, right), score)
    return rows.agg(F.round(F.coalesce(F.max(F.when(F.col("tp") / (F.col("tp") + F.col("fp")) >= least, (F.col("tp") + F.col("fp")) / (F.col("P") + F.col("N")))), F.lit(0.0)), 6).alias("coverage"))


def risk_coverage(df: DataFrame, score: str, right: str, tie: str, *group: str) -> DataFrame:
    """Area under the curve of running error over coverage, by trapezoids."""
    hit, seen = F.coalesce(F.col(right).cast("int"), F.lit(0)), F.col(right).isNotNull().cast("int")
    rows = prefix_sums(df.select(*group, score, tie, hit.alias("_own"), seen.alias("_known")), list(group), [F.col(score).desc(), F.col(tie)], hit=F.col("_own"), seen=F.col("_known"), n=F.lit(1))
    risk, last = 1 - F.try_divide("hit", "seen"), 1 - F.try_divide(F.col("hit") - F.col("_own"), F.col("seen") - F.col("_known"))
    area = F.when(F.col("n") > 1, (risk + last) / 2 / F.col("n_all"))
    return rows.withColumn("area", area).groupBy(*group).agg(F.round(F.sum("area"), 6).alias("aurc"))


def edge_prf(df: DataFrame, linked: str, same: str, missing: str, ta: str, tb: str, *group: str) -> DataFrame:
    """(judged, precision, recall, extraction, drift, inverted) of judged edges.

    `missing` marks true partners that were never extracted; drift is the mean distance of the places of true partners, and
    the axis looks inverted if they lie nearer with one side turned around.
    """
    yes, own = F.col(linked), F.col(same)
    tp = F.count_if(yes & own)
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    drift, turned = (F.avg(F.when(own, F.abs(F.col(ta) - x))) for x in (F.col(tb), 1 - F.col(tb)))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("judged"), share(tp, F.count_if(yes)).alias("precision"), share(tp, F.count_if(own)).alias("recall"), share(F.count_if(own), F.count_if(own | F.col(missing))).alias("extraction"), F.round(drift, 6).alias("drift"), F.coalesce(turned < drift, F.lit(False)).alias("inverted"))


def comparability(df: DataFrame, factor: str, share: str, count: str, *group: str) -> DataFrame:
    """Does a factor go with how well pairs matched? (rho, rho_count, n, low, high, delta, confounded) for each group.

    `share` is the matched share of a pair, `count` its number of links; low and high are the mean shares where the factor
    is in its lowest and highest third. A sign that differs between share and count (above 0.05) is that of the denominator.
    Rows with a null in any of the three are left out.
    """
    rows = df.dropna(subset=[factor, share, count])
    cuts = rows.groupBy(*group).agg(F.percentile(factor, F.lit(0.333)).alias("_lo"), F.percentile(factor, F.lit(0.667)).alias("_hi"))
    at = rows.join(cuts, list(group)).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(factor) <= F.col("_lo"), F.col(share))).alias("low"), F.avg(F.when(F.col(factor) >= F.col("_hi"), F.col(share))).alias("high"))
    rho = spearman(rows, factor, share, *group).join(spearman(rows, factor, count, *group).withColumnRenamed("rho", "rho_count"), list(group))
    out = rho.join(at, list(group))
    confounded = F.coalesce((F.signum("rho") != F.signum("rho_count")) & (F.abs("rho_count") > 0.05), F.lit(False))
    return out.select(*group, "rho", "rho_count", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(F.col("high") - F.col("low"), 6).alias("delta"), confounded.alias("confounded"))


def spearman(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """Correlation of average ranks; null where either side is constant."""
    from .ranking import average_rank

    ranked = df.select(*group, average_rank(a, *group).alias("_a"), average_rank(b, *group).alias("_b"))
    return ranked.groupBy(*group).agg(F.round(F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b")), 6).alias("rho"))


def gate_fit(edges: DataFrame, individual: str, cos: str, d2: str, truth: str, sigmas: list[float], thresholds: list[float], current: tuple[float, float], folds: int = 5, beta: float = 0.5, bins: int = 1000) -> DataFrame:
    """(fold, sigma, threshold, f_test, f_current, n, good_threshold): a position gate's width and cut, chosen across individuals.

    An edge's quality is its cosine, at least 0, times exp(-d2 / (2 sigma^2)), 1 where d2 is unknown; it is kept in `bins`
    steps. For each fold the width with the best AUROC and then the cut with the best F-beta are chosen on the other folds and
    tried on it, beside the `current` (width, cut), both of the grids; of equals the smaller counts. Row -1 is chosen on all
    and tried on all, with the lowest cut whose precision is 0.9 or more. Folds without a positive edge, or whose others lack
    a class, are left out; edges without cosine or truth too.

    One pass counts edges by fold, width and step; what the other folds hold is the total less the fold, so everything after
    that pass runs on a table whose size the grids bound.
    """
    from .sampling import fold_of

    rows = edges.where(F.col(cos).isNotNull() & F.col(truth).isNotNull())
    gate = lambda s: F.coalesce(F.exp(-F.col(d2) / (2 * s * s)), F.lit(1.0))
    step = lambda s: F.floor(F.greatest(F.col(cos), F.lit(0.0)) * gate(s) * bins + 1e-9).cast("int")
    each = F.array(*(F.struct(F.lit(k).alias("s"), step(s).alias("bin")) for k, s in enumerate(sigmas)))
    hist = rows.select(fold_of(individual, folds).alias("fold"), F.col(truth).alias("y"), F.explode(each).alias("x"))
    hist = written(hist.groupBy("fold", "x.s", "x.bin").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))
    whole = hist.groupBy("s", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    own = hist.select("fold", "s", "bin", F.col("pos").alias("p"), F.col("neg").alias("n"))
    less = lambda a, b: (F.col(a) - F.coalesce(b, F.lit(0))).alias(a)
    train = whole.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))).join(own, ["fold", "s", "bin"], "left").select("fold", "s", "bin", less("pos", "p"), less("neg", "n"))
    test = hist.unionByName(whole.withColumn("fold", F.lit(-1)))

    w = Window.partitionBy("fold", "s")  # one row a step
    area = train.withColumn("fp", F.sum("neg").over(w.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("N", F.sum("neg").over(w))
    won = F.sum(F.col("pos") * (F.col("N") - F.col("fp")) + F.col("pos") * F.col("neg") / 2.0)
    area = area.groupBy("fold", "s").agg(F.round(F.try_divide(won, F.sum("pos") * F.sum("neg")), 9).alias("auroc")).where("auroc IS NOT NULL")
    width = area.groupBy("fold").agg((-F.max(F.struct("auroc", (-F.col("s")).alias("k")))["k"]).alias("s"))

    def at(counts: DataFrame) -> DataFrame:
        """(fold, s, t, tp, fp, P, N, f) for each threshold."""
        reach = lambda c, t: F.sum(F.when(F.col("bin") >= round(t * bins), F.col(c)).otherwise(0))
        per = F.array(*(F.struct(F.lit(float(t)).alias("t"), reach("pos", t).alias("tp"), reach("neg", t).alias("fp")) for t in thresholds))
        out = counts.groupBy("fold", "s").agg(per.alias("x"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).select("fold", "s", "P", "N", F.explode("x").alias("x")).select("fold", "s", "P", "N", "x.*")
        f = fbeta(F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("P"), beta)
        return out.withColumn("f", F.round(F.when(F.col("tp") > 0, f).otherwise(0.0), 9))

    tried, learned = written(at(test)), at(train).join(width, ["fold", "s"])
    precise = F.col("tp") >= 0.9 * (F.col("tp") + F.col("fp"))
    cut = learned.groupBy("fold", "s").agg((-F.max(F.struct("f", (-F.col("t")).alias("k")))["k"]).alias("t"), F.min(F.when((F.col("fold") == -1) & (F.col("tp") > 0) & precise, F.col("t"))).alias("good_threshold"))
    now = tried.where((F.col("s") == sigmas.index(current[0])) & (F.col("t") == float(current[1]))).select("fold", F.col("f").alias("f_current"))
    out = cut.join(tried.where("P > 0"), ["fold", "s", "t"]).join(now, "fold")
    sigma = F.element_at(F.array(*(F.lit(float(s)) for s in sigmas)), F.col("s") + 1)
    return out.select("fold", sigma.alias("sigma"), F.col("t").alias("threshold"), F.round("f", 6).alias("f_test"), F.round("f_current", 6).alias("f_current"), (F.col("P") + F.col("N")).alias("n"), "good_threshold")
