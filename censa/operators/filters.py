"""Gates that keep or drop rows by quality, source, review and the spots of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows where any of the columns holds the text, in any case; null holds nothing."""
    pattern = "%" + text.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).like(pattern)
    return df.where(hit)


def quality_gate(least: float, most_outside: float, missing: bool) -> Column:
    """Synthetic images pass; `missing` says whether an unmeasured quality does; an unmeasured outside share is no fault."""
    measured = F.col("q_overall").isNotNull()
    fine = (F.col("q_overall") >= least) & (F.coalesce("outside", F.lit(0.0)) <= most_outside)
    return F.col("is_synthetic") | F.when(measured, fine).otherwise(F.lit(missing))


def source_gate(images: DataFrame, label_map: DataFrame, key: str, wanted: str) -> DataFrame:
    """Rows whose label is mapped to the wanted collection, or not mapped."""
    mapped = images.join(label_map.select(key, F.col("collection").alias("_collection")), key, "left")
    return mapped.where(F.coalesce("_collection", F.lit(wanted)) == wanted).drop("_collection")


def review_gate(images: DataFrame, decisions: DataFrame, keep_unreviewed: bool) -> DataFrame:
    """Accepted images, unreviewed ones as asked, and all synthetic ones."""
    known = images.join(decisions.select("image_id", F.col("accepted").alias("_accepted")), "image_id", "left")
    return known.where(F.col("is_synthetic") | F.coalesce("_accepted", F.lit(keep_unreviewed))).drop("_accepted")


def spot_qc(spots: DataFrame, key: str, area: str, sharpness: str, fewest: int, least_sharp: float, most_share: float) -> DataFrame:
    """Images that fail: (key, n, reasons). NaN sharpness is ignored; where all areas are zero, one spot holds everything."""
    sharp = F.when(~F.isnan(sharpness), F.col(sharpness))
    per = spots.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(area).alias("top"), F.sum(area).alias("total"), F.avg(sharp).alias("sharp"))
    share = F.when(F.col("total") > 0, F.col("top") / F.col("total")).otherwise(1.0)
    reasons = F.array_compact(F.array(F.when(F.col("n") < fewest, "few_spots"), F.when(F.col("sharp") < least_sharp, "blurred"), F.when(share > most_share, "dominant_spot")))
    return per.select(key, "n", reasons.alias("reasons")).where(F.size("reasons") > 0)
