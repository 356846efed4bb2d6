"""Splits, samples and resampling by hashes: the same rows give the same result on every run and any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written
from .ranking import prefix_sums


def uniform(*parts: Column | str, digits: int = 7) -> Column:
    """A number in [0, 1) from the first hex digits, at most 13, of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("double") / F.lit(float(16**digits))


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, at most 5."""
    times = F.lit(0)
    # The distribution function of Poisson(1) at 0 to 4.
    for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563):
        times = times + (u >= p).cast("int")
    return times


#: Draws of a replicate that one row gives.
DRAWS = 4096


def resampled(per: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """(rep, times, and the columns of `per`): clusters drawn with replacement, as many as there are, in each replicate.

    `per` holds a row for each cluster. Clusters are numbered in order, and draw d of replicate r takes the number that a hash
    of both gives. Draws come in runs of DRAWS and are counted before they meet the clusters, so there is at most one row for
    a cluster and replicate, and no task holds a replicate.
    """
    numbered = written(prefix_sums(per, [], [F.col(cluster)], _p=F.lit(1).cast("long")).withColumn("_p", F.col("_p") - 1))
    total = numbered.agg(F.count(F.lit(1)).alias("_all")).where("_all > 0")
    runs = total.select("_all", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    runs = runs.select("_all", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / DRAWS))).alias("_run")).repartition("rep", "_run")
    last = F.least(F.col("_all") - 1, (F.col("_run") + 1) * DRAWS - 1)
    draws = runs.select("_all", "rep", F.explode(F.sequence(F.col("_run") * DRAWS, last)).alias("_draw"))
    drawn = draws.select("rep", F.floor(uniform("rep", "_draw", digits=13) * F.col("_all")).alias("_p")).groupBy("rep", "_p").agg(F.count(F.lit(1)).alias("times"))
    return drawn.join(numbered.drop("_p_all"), "_p").drop("_p")


def cluster_bootstrap(df: DataFrame, cluster: str, hit: str, replicates: int) -> DataFrame:
    """(mean, lo, hi) of the rate of `hit` when clusters are drawn with replacement, as many as there are.

    Clusters are summed first, so the replicates multiply clusters, not rows.
    """
    per = df.groupBy(cluster).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    rows = resampled(per, cluster, replicates)
    return _interval(rows.groupBy("rep").agg((F.sum(F.col("times") * F.col("k")) / F.nullif(F.sum(F.col("times") * F.col("n")), F.lit(0))).alias("v")))


def _interval(rates: DataFrame) -> DataFrame:
    return rates.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.percentile("v", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("hi"))


def _replicated(per: DataFrame, replicates: int, *key: str) -> DataFrame:
    rows = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return rows.withColumn("times", poisson_one(uniform("rep", *(F.col(k).cast("string") for k in key))))


def paired_delta(df: DataFrame, cluster: str, hit: Column, other: Column, replicates: int) -> DataFrame:
    """(mean, lo, hi) of the rate of `hit` less that of `other` on the same rows, as clusters are resampled once for both."""
    per = df.groupBy(cluster).agg((F.count_if(hit) - F.count_if(other)).alias("k"), F.count(F.lit(1)).alias("n"))
    rates = _replicated(per, replicates, cluster).groupBy("rep").agg((F.sum(F.col("times") * F.col("k")) / F.nullif(F.sum(F.col("times") * F.col("n")), F.lit(0))).alias("v"))
    return _interval(rates)


def two_sample_delta(df: DataFrame, cluster: str, hit: Column, side: Column, replicates: int) -> DataFrame:
    """(mean, lo, hi) of the rate of `hit` where `side` is true less that where it is false, each side resampled on its own.

    A replicate in which a side has no rows is left out.
    """
    per = df.where(side.isNotNull()).groupBy(side.alias("side"), cluster).agg(F.count_if(hit).alias("k"), F.count(F.lit(1)).alias("n"))
    rate = lambda on: F.sum(F.when(on, F.col("times") * F.col("k"))) / F.nullif(F.sum(F.when(on, F.col("times") * F.col("n"))), F.lit(0))
    return _interval(_replicated(per, replicates, "side", cluster).groupBy("rep").agg((rate(F.col("side")) - rate(~F.col("side"))).alias("v")))


def fold_of(label: str, folds: int, seed: str = "fold") -> Column:
    return F.floor(uniform(F.lit(seed), label) * folds).cast("int")


def split_roles(images: DataFrame, folds: int) -> DataFrame:
    """(image_id, fold, role): individuals of several photos hold one back as a query, single ones are open queries.

    Synthetic images and images without spots take no part.
    """
    real = images.where(~F.col("is_synthetic") & (F.col("n_spots") > 0))
    w = Window.partitionBy("individual_id")
    order = F.row_number().over(w.orderBy(uniform(F.lit("query"), "image_id"), "image_id"))
    n = F.count(F.lit(1)).over(w)
    role = F.when(n == 1, "open_query").when(order == 1, "closed_query").otherwise("gallery")
    return real.select("image_id", "individual_id", fold_of("individual_id", folds).alias("fold"), role.alias("role"))


def nested_fractions(df: DataFrame, label: str, fractions: list[float]) -> DataFrame:
    """(fraction, labels): labels by hash, so that smaller fractions are parts of larger ones."""
    u = uniform(F.lit("nested"), label)
    labels = df.select(label).distinct().withColumn("u", u)
    counts = labels.agg(*(F.count_if(F.col("u") < f).alias(str(k)) for k, f in enumerate(fractions)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(float(f)).alias("fraction"), F.col(f"`{k}`").alias("labels")) for k, f in enumerate(fractions)))).alias("x")).select("x.*")


def negatives(queries: DataFrame, candidates: DataFrame, each: int) -> DataFrame:
    """(query, candidate): exactly `each` candidates of other labels for every query (query, label), all of them if they are fewer.

    Candidates (candidate, candidate_label; no candidate twice) stand on a ring in the order of a hash, and a query takes the
    successors of a hash of its own among those that are not of its label. Where the j-th of these stands follows from how
    many of the label come before it: the i-th of the label at place p has p - i others before it, so those with p - i <= j
    come first. Both are put in one order by label and summed up in ranges, so that neither a label of nearly all candidates
    nor the ring is in one task, and the work grows with rows, not with runs. A null label is a label.
    """
    ring = candidates.select("candidate", "candidate_label", uniform(F.lit("neg"), "candidate", digits=13).alias("_u"))
    ring = written(prefix_sums(ring, [], [F.col("_u"), F.col("candidate")], _p=F.lit(1).cast("long")).withColumn("_p", F.col("_p") - 1).drop("_u"))
    asked = queries.select(F.col("label").alias("_l")).distinct()
    own = ring.join(asked, F.col("candidate_label").eqNullSafe(F.col("_l")), "left_semi")
    own = prefix_sums(own.select("candidate_label", "_p"), ["candidate_label"], [F.col("_p")], _i=F.lit(1).cast("long"))
    own = written(own.select(F.col("candidate_label").alias("_l"), (F.col("_p") - F.col("_i") + 1).alias("_v"), F.col("_i_all").alias("_n")))
    counts = own.groupBy("_l").agg(F.max("_n").alias("_n"))
    rows = queries.join(counts, F.col("label").eqNullSafe(F.col("_l")), "left").select("query", "label", F.coalesce("_n", F.lit(0)).alias("_n"))
    rows = rows.join(F.broadcast(ring.agg(F.count(F.lit(1)).alias("_all")))).withColumn("_m", F.col("_all") - F.col("_n")).where("_m > 0")  # one row
    start = F.floor(uniform(F.lit("draw"), "query", digits=13) * F.col("_m"))
    turns = F.transform(F.sequence(F.lit(0), F.least(F.col("_m"), F.lit(each)).cast("int") - 1), lambda t: (start + t) % F.col("_m"))
    asks = rows.select(F.col("label").alias("_l"), F.explode(turns).alias("_v"), F.lit(1).alias("_k"), "query")
    points = own.select("_l", "_v", F.lit(0).alias("_k"), F.lit(None).cast(queries.schema["query"].dataType).alias("query"))
    found = prefix_sums(points.unionByName(asks), ["_l"], [F.col("_v"), F.col("_k"), F.col("query")], _before=1 - F.col("_k")).where("_k = 1")
    return found.select("query", (F.col("_v") + F.col("_before")).alias("_p")).join(ring.select("_p", "candidate"), "_p").select("query", "candidate")


def candidate_pairs(queries: DataFrame, gallery: DataFrame, each: int) -> DataFrame:
    """(query, candidate, same, photos): each query (query, label) with its own label and `each` others of the gallery.

    The gallery (image, label) may hold labels that no query has, distractors. A query is left out of its own label's photos,
    and has no rows at all if its label has no other photo there.
    """
    labels = gallery.groupBy(F.col("label").alias("candidate")).agg(F.count(F.lit(1)).alias("photos"))
    there = gallery.select(F.col("image").alias("query"), "label").withColumn("_in", F.lit(1))
    own = queries.join(there, ["query", "label"], "left").join(labels, F.col("label") == F.col("candidate"))
    own = written(own.select("query", "label", (F.col("photos") - F.coalesce("_in", F.lit(0))).alias("photos")).where("photos > 0"))
    other = negatives(own.select("query", "label"), labels.select("candidate", F.col("candidate").alias("candidate_label")), each)
    positive = own.select("query", F.col("label").alias("candidate"), F.lit(True).alias("same"), "photos")
    return positive.unionByName(other.join(labels, "candidate").select("query", "candidate", F.lit(False).alias("same"), "photos"))


def leakage_checks(roles: DataFrame) -> DataFrame:
    """Counts that must be zero: images in two roles, individuals in two folds, open queries with gallery photos, and so on."""
    per_image = roles.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles"))
    per_label = roles.groupBy("individual_id").agg(F.countDistinct("fold").alias("folds"), F.count_if(F.col("role") == "gallery").alias("g"), F.count_if(F.col("role") == "closed_query").alias("c"), F.count_if(F.col("role") == "open_query").alias("o"))
    a = per_image.agg(F.count_if(F.col("n") > 1).alias("repeated_images"), F.count_if(F.col("roles") > 1).alias("images_in_two_roles"))
    b = per_label.agg(F.count_if(F.col("folds") > 1).alias("labels_in_two_folds"), F.count_if((F.col("o") > 0) & (F.col("g") > 0)).alias("open_with_gallery"), F.count_if((F.col("c") > 0) & (F.col("g") == 0)).alias("closed_without_gallery"), F.count_if(F.col("c") > 1).alias("several_queries"))
    return a.join(F.broadcast(b))  # one row is broadcast
