"""Queries of table changes, workflow steps, splits, identifiers and learned scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import models as ML
from ..operators import ranking as R
from ..operators import sampling as N
from ..operators import workflow as W
from ..sources import sinks, tables
from ..sources.store import Put, Store
from ..streaming import activity as stream
from .roles import Catalogue

catalogue = Catalogue()
add = catalogue.add
_U = "CAST('0x' || substr(md5({}), 1, 7) AS BIGINT) / 268435456.0::DOUBLE"

# Sources and sinks


@add("images", "individuals")
def scan_catalog(images: DataFrame, individuals: DataFrame) -> DataFrame:
    """Tables and columns that are there."""
    return tables.catalogue({"images": images, "individuals": individuals})


@add("activity", sql="SELECT kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM activity GROUP BY 1, 2")
def scan_json(activity: DataFrame) -> DataFrame:
    """A JSON field read with a schema."""
    return activity.select("kind", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"))


def _review_store(images: DataFrame) -> DataFrame:
    """A store of reviews, written as JSON and read back: a match of up to three photos for each individual."""
    one = F.struct(F.col("image_id").cast("string").alias("image"), F.col("n_spots").alias("spot"))
    per = images.groupBy("individual_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("image_id").cast("string"), F.struct(F.col("status").alias("decision")))))).alias("images"),
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("image_id", one.alias("m")))), lambda x: x["m"]), 1, 3).alias("members"),
    )
    k = F.col("individual_id")
    match = F.struct(F.concat(F.lit("m"), k).alias("match_id"), "members", ((k % 4 == 0) | (k % 3 != 0)).alias("accepted"), F.when(k % 4 == 0, "human").otherwise("algorithm").alias("proposed_by"))
    rows = per.select(F.create_map(k.cast("string"), F.struct("images", F.array(match).alias("matches"))).alias("individuals"))
    path = f"{sinks.scratch_folder(images.sparkSession)}/reviews"
    rows.write.json(path)
    return tables.read_review_store(images.sparkSession, path, lines=True)


_REVIEWS = """m AS (SELECT image_id, individual_id AS i, n_spots, row_number() OVER (PARTITION BY individual_id ORDER BY image_id) AS k FROM images),
    e AS (SELECT 'm' || a.i AS match_id, CAST(a.i AS VARCHAR) AS individual, CAST(a.image_id AS VARCHAR) AS sid_a, a.n_spots AS spot_a, CAST(b.image_id AS VARCHAR) AS sid_b, b.n_spots AS spot_b, a.i % 4 = 0 OR a.i % 3 <> 0 AS accepted, CASE WHEN a.i % 4 = 0 THEN 'human' ELSE 'algorithm' END AS proposed_by
      FROM m a JOIN m b ON a.i = b.i AND a.k < b.k AND b.k <= 3)"""


@add("images", sql=f"WITH {_REVIEWS} SELECT * FROM e")
def scan_review_store(images: DataFrame) -> DataFrame:
    """The edges of a nested review store: matches of individuals, expanded to pairs of members."""
    return tables.match_verdicts(_review_store(images)).drop("method", "pair_kind")


@add("images", sql=f"""
    WITH {_REVIEWS}, s AS (SELECT count(*) AS n_edges, count(*) FILTER (WHERE proposed_by = 'algorithm') AS n_algorithm, count(*) FILTER (WHERE proposed_by = 'human') AS n_human, count(DISTINCT individual) AS n_individuals,
      count(*) FILTER (WHERE proposed_by = 'algorithm' AND accepted) AS tp, count(*) FILTER (WHERE proposed_by = 'algorithm' AND NOT accepted) AS fp, count(*) FILTER (WHERE proposed_by = 'human' AND accepted) AS missed FROM e)
    SELECT *, round(tp / greatest(tp + fp, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + missed, 1)::DOUBLE, 6) AS recall_upper FROM s""")
def agg_operating_point(images: DataFrame) -> DataFrame:
    """Precision of the matcher and an upper bound of its recall, from the verdicts of a review store."""
    return A.operating_point(tables.match_verdicts(_review_store(images)))


_IMG = "SELECT image_id, individual_id, status, n_spots FROM images"


def _plain(images: DataFrame) -> DataFrame:
    return images.select("image_id", "individual_id", "status", "n_spots")


@add("images", sql=f"SELECT image_id, individual_id, CASE WHEN image_id % 10 = 0 THEN 'changed' ELSE status END AS status, n_spots FROM images UNION ALL SELECT -image_id, individual_id, 'new', n_spots FROM images WHERE image_id % 100 = 50")
def sink_upsert(images: DataFrame) -> DataFrame:
    """Changes replace rows of equal key, the last version counts, and new keys are added."""
    rows = _plain(images)
    old = rows.where("image_id % 10 = 0").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("status", F.when(F.col("v") == 2, "changed").otherwise("stale"))
    new = rows.where("image_id % 100 = 50").select((-F.col("image_id")).alias("image_id"), "individual_id", F.lit("new").alias("status"), "n_spots", F.lit(1).alias("v"))
    return sinks.upsert(rows, old.unionByName(new), ["image_id"], "v").drop("v")


@add("images", sql="SELECT image_id, status FROM images WHERE image_id % 3 <> 0 UNION ALL SELECT image_id, 'added' AS status FROM images WHERE image_id % 3 = 0")
def sink_insert(images: DataFrame) -> DataFrame:
    """Rows of unseen keys are added, seen keys are left alone."""
    rows = images.select("image_id", "status")
    return sinks.insert_missing(rows.where("image_id % 3 <> 0"), rows.select("image_id", F.lit("added").alias("status")), ["image_id"])


@add("images", sql=_IMG)
def sink_ctas(images: DataFrame) -> DataFrame:
    """A table made from a query, replaced by a second one, then read."""
    path = sinks.scratch_folder(images.sparkSession)
    sinks.create_or_replace(_plain(images).limit(0), path)
    sinks.create_or_replace(_plain(images), path, "status")
    return _plain(images.sparkSession.read.parquet(path))


@add("images", sql="SELECT status, count(*) AS n FROM images GROUP BY 1")
def sink_report(images: DataFrame) -> DataFrame:
    """A report as one ordered CSV file with a header, read back."""
    path = sinks.scratch_folder(images.sparkSession)
    sinks.roster_csv(images.groupBy("status").agg(F.count(F.lit(1)).alias("n")), path, "status")
    return images.sparkSession.read.schema("status string, n long").option("header", "true").csv(path)


@add("images", "individuals", sql="SELECT i.image_id, d.display_id FROM images i JOIN individuals d ON i.individual_id = d.individual_id")
def sink_snapshot(images: DataFrame, individuals: DataFrame) -> DataFrame:
    """Two tables copied as they are, and the copies joined."""
    spark, source, target = images.sparkSession, *(sinks.scratch_folder(images.sparkSession) for _ in range(2))
    tables_ = {"images": _plain(images), "individuals": individuals.select("individual_id", "display_id")}
    for name, df in tables_.items():
        sinks.create_or_replace(df, f"{source}/{name}.parquet")
    sinks.snapshot(spark, source, target, list(tables_))
    copies = tables.attach(spark, target, list(tables_), "copy_")
    return copies["images"].join(copies["individuals"], "individual_id").select("image_id", "display_id")


@add("images", sql="SELECT status, count(*) AS images, 0::BIGINT AS missing FROM images GROUP BY 1")
def scan_attach(images: DataFrame) -> DataFrame:
    """Tables of another folder as views with a prefix; one that is not there is left out."""
    spark, root = images.sparkSession, sinks.scratch_folder(images.sparkSession)
    sinks.create_or_replace(_plain(images), f"{root}/images.parquet")
    found = tables.attach(spark, root, ["images", "absent"], "other_")
    return spark.sql("SELECT status, count(*) AS images FROM other_images GROUP BY status").withColumn("missing", F.lit(len(found) - 1).cast("bigint"))


@add("images", sql="SELECT individual_id % 10 AS digit, count(*) AS n FROM images GROUP BY 1")
def scan_df_register(images: DataFrame) -> DataFrame:
    """A frame under a name for SQL."""
    tables.register(images.sparkSession, "registered_images", _plain(images))
    return images.sparkSession.sql("SELECT individual_id % 10 AS digit, count(*) AS n FROM registered_images GROUP BY 1")


@add("images", sql=_IMG)
def scan_jsonl(images: DataFrame) -> DataFrame:
    """JSON lines with lines that do not parse, which are left out."""
    path = sinks.scratch_folder(images.sparkSession)
    lines = _plain(images).select(F.to_json(F.struct("image_id", "individual_id", "status", "n_spots")).alias("value"))
    lines.unionByName(images.select(F.concat(F.lit("{broken "), F.col("image_id").cast("string")).alias("value"))).write.text(path)
    return tables.read_jsonl(images.sparkSession, path, "image_id long, individual_id long, status string, n_spots int")


@add("individuals", sql="SELECT DISTINCT display_id AS label, CASE WHEN display_id LIKE 'Customer#00000000%' THEN 'first' WHEN display_id LIKE 'Customer#0000000%' THEN 'next' ELSE 'other' END AS collection FROM individuals")
def scan_csv(individuals: DataFrame) -> DataFrame:
    """Labels from a CSV with a header, each with the collection of its prefix."""
    path = sinks.scratch_folder(individuals.sparkSession)
    individuals.select(F.concat(F.lit(" "), "display_id").alias("label"), "nickname").write.option("header", "true").csv(path)
    return tables.read_label_map(individuals.sparkSession, path, "label", {"Customer#00000000": "first", "Customer#0000000": "next"}, "other")


@add("activity", sql="SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kind, count(*) AS n FROM activity WHERE actor % 2 = 0 GROUP BY 1 UNION ALL SELECT kind, count(*) FROM activity WHERE actor % 2 = 1 GROUP BY 1) GROUP BY 1")
def sink_add_counts(activity: DataFrame) -> DataFrame:
    """A usage counter that adds."""
    per = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return sinks.add_counts(per(activity.where("actor % 2 = 0")), per(activity.where("actor % 2 = 1")), ["kind"], "n")


def _store(df: DataFrame) -> Store:
    """A new store in the shared folder."""
    return Store(df.sparkSession, sinks.scratch_folder(df.sparkSession))


_BOX = "CAST(least(floor(axis_t * 4), 3) AS INT)"


@add("images", "spots", sql=f"""
    WITH s AS (SELECT image_id, spot_id, CASE WHEN image_id % 5 = 0 THEN area * 2 ELSE area END AS area, {_BOX} AS box FROM spots WHERE image_id % 5 <> 0 OR spot_id <= 2)
    SELECT 'images' AS name, image_id, CAST(n_spots AS BIGINT) AS n, weight AS total FROM images WHERE image_id % 5 <> 0 UNION ALL SELECT 'images', image_id, count(*), NULL FROM s WHERE image_id % 5 = 0 GROUP BY 2
    UNION ALL SELECT 'spots', image_id, count(*), round(sum(area), 6) FROM s GROUP BY 2
    UNION ALL SELECT 'bins', image_id, count(DISTINCT box), NULL FROM s GROUP BY 2
    UNION ALL SELECT 'axis', image_id, CAST(1 AS BIGINT), NULL FROM images WHERE has_axis AND image_id % 5 <> 0""")
def sink_replace_key(images: DataFrame, spots: DataFrame) -> DataFrame:
    """All that is held about some images is replaced by a new extraction, four tables in one commit; what a reader then sees.

    The new extraction finds two spots at most, of twice the area, and no axis.
    """
    rows = spots.select("image_id", "spot_id", "area", F.expr(_BOX).alias("box"))
    bins = lambda t: t.groupBy("image_id", "box").agg(F.count(F.lit(1)).alias("n_spots"))
    store = _store(images)
    put = {"images": images.select("image_id", F.col("n_spots").cast("bigint").alias("n_spots"), "weight"), "spots": rows, "bins": bins(rows), "axis": images.where("has_axis").select("image_id")}
    store.commit(store.snapshot(), {name: Put(t, ("image_id",)) for name, t in put.items()}, "load")
    some = images.where("image_id % 5 = 0").select("image_id")
    again = rows.where("image_id % 5 = 0 AND spot_id <= 2").withColumn("area", F.col("area") * 2)
    found = again.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_spots")).withColumn("weight", F.lit(None).cast("double"))
    now = W.replace_extraction(store, {"images": found, "spots": again, "bins": bins(again), "axis": some.limit(0)}, some)
    none = F.lit(None).cast("double")
    per = lambda name, n, total: now.table(name).groupBy("image_id").agg(n.cast("bigint").alias("n"), total.alias("total")).select(F.lit(name).alias("name"), "image_id", "n", "total")
    count = F.count(F.lit(1))
    out = per("images", F.max("n_spots"), F.max("weight")).unionByName(per("spots", count, F.round(F.sum("area"), 6)))
    return out.unionByName(per("bins", count, F.max(none))).unionByName(per("axis", count, F.max(none)))


@add("images", sql="SELECT image_id, individual_id, CASE WHEN status = 'in_review' AND n_spots > 5 THEN 'confirmed' ELSE status END AS status, n_spots FROM images")
def sink_update(images: DataFrame) -> DataFrame:
    return sinks.update(_plain(images), (F.col("status") == "in_review") & (F.col("n_spots") > 5), status="confirmed")


@add("images", sql="SELECT image_id, status, n_spots FROM images WHERE image_id % 2 = 0 UNION ALL SELECT image_id, status, NULL FROM images WHERE image_id % 2 = 1")
def sink_merge_dbs(images: DataFrame) -> DataFrame:
    """Two databases united; the poorer one's missing column is null."""
    rows = images.select("image_id", "status", "n_spots")
    return sinks.merge_databases([{"images": rows.where("image_id % 2 = 0")}, {"images": rows.where("image_id % 2 = 1").drop("n_spots")}])["images"]


@add("spots", sql="SELECT image_id, spot_id FROM spots")
def sink_delta_merge(spots: DataFrame) -> DataFrame:
    """Images not seen before come in; partly new images are skipped, as keys are whole images."""
    rows = spots.select("image_id", "spot_id")
    return sinks.delta_merge({"spots": rows.where("image_id % 4 <> 0")}, {"spots": rows}, {}, "image_id")["spots"]


@add("images", "spots", sql="SELECT 'images' AS t, count(*) AS n FROM images WHERE image_id % 7 <> 0 UNION ALL SELECT 'spots', count(*) FROM spots WHERE image_id NOT IN (SELECT image_id FROM images WHERE image_id % 7 = 0)")
def sink_cascade_delete(images: DataFrame, spots: DataFrame) -> DataFrame:
    """Ids deleted from every table that has the key."""
    left = sinks.cascade_delete({"images": images, "spots": spots}, images.where("image_id % 7 = 0"), "image_id")
    count = lambda n: left[n].agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"))
    return count("images").unionByName(count("spots"))


# Workflow


@add("images", sql="SELECT CASE WHEN image_id % 3 = 0 THEN 'added' WHEN image_id % 3 = 1 THEN 'unchanged' ELSE 'conflict' END AS outcome, count(*) AS n FROM images GROUP BY 1")
def wf_transfer(images: DataFrame) -> DataFrame:
    """An import met with what is there: added, unchanged or in conflict."""
    known = images.where("image_id % 3 <> 0").select("image_id", F.when(F.col("image_id") % 3 == 1, F.md5(F.col("image_id").cast("string"))).otherwise("other").alias("source_checksum"))
    new = images.select("image_id", F.md5(F.col("image_id").cast("string")).alias("source_checksum"))
    return W.transfer(known, new).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_MERGES = "merges AS (SELECT individual_id AS alias, individual_id - 1 AS keep FROM individuals WHERE individual_id % 10 IN (3, 4, 5))"


@add("individuals", sql=f"WITH {_MERGES}, chain AS (SELECT alias, keep FROM merges UNION ALL SELECT c.alias, m.keep FROM chain c JOIN merges m ON c.keep = m.alias) SELECT alias, min(keep) AS keep FROM chain GROUP BY 1")
def wf_alias_chains(individuals: DataFrame) -> DataFrame:
    """Merged labels followed to the end of their chain."""
    return W.chase_aliases(individuals.where("individual_id % 10 IN (3, 4, 5)").select(F.col("individual_id").alias("alias"), (F.col("individual_id") - 1).alias("keep")))


@add("images", "individuals", sql=f"WITH {_MERGES} SELECT image_id, coalesce(keep, individual_id) AS individual_id, CASE WHEN image_id % 50 = 0 OR coalesce(keep, individual_id) % 100 = 7 THEN 'disqualified' ELSE status END AS status FROM images LEFT JOIN merges ON individual_id = alias")
def wf_corrections(images: DataFrame, individuals: DataFrame) -> DataFrame:
    """Merges relabel by one hop; exclusions of images and of labels disqualify."""
    merges = individuals.where("individual_id % 10 IN (3, 4, 5)").select(F.col("individual_id").alias("alias"), (F.col("individual_id") - 1).alias("keep"))
    excluded = images.where("image_id % 50 = 0").select("image_id", F.lit(None).cast("bigint").alias("individual_id")).unionByName(individuals.where("individual_id % 100 = 7").select(F.lit(None).cast("bigint").alias("image_id"), "individual_id"))
    return W.apply_corrections(images.select("image_id", "individual_id", "status"), individuals, merges, excluded)[0]


@add("images", sql="SELECT status, count(*) AS n FROM (SELECT status FROM images UNION ALL SELECT CASE WHEN nullif(n_spots, 3) IS NULL THEN 'failed' WHEN n_spots = 0 THEN 'hand_correction' ELSE 'extracted' END FROM images WHERE image_id % 6 = 1) GROUP BY 1")
def wf_ingest(images: DataFrame) -> DataFrame:
    new = images.where("image_id % 6 = 1").select((-F.col("image_id")).alias("image_id"), F.expr("nullif(n_spots, 3)").alias("n_spots"))
    return W.ingest(images.select("image_id", "status", "n_spots"), new).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@add("images", sql="""
    SELECT image_id, CASE image_id % 8 WHEN 1 THEN individual_id + 1 WHEN 2 THEN -image_id ELSE individual_id END AS individual_id,
      CASE image_id % 8 WHEN 1 THEN 'confirmed' WHEN 2 THEN 'enrolled_new' WHEN 3 THEN 'flagged_uncertain' WHEN 4 THEN 'disqualified' ELSE status END AS status, CAST(CASE WHEN image_id % 8 IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS INT) AS rev FROM images""")
def wf_decide(images: DataFrame) -> DataFrame:
    """The last valid decision on each image, committed and read back; a disqualification without a reason is void."""
    return _decided(images).table("images").select("image_id", "individual_id", "status", "rev")


def _decided(images: DataFrame):
    """A store of the images after the decisions on them."""
    k = F.col("image_id") % 8
    rows = images.where("image_id % 8 BETWEEN 1 AND 5").select(
        F.col("image_id").alias("id"), "image_id", F.col("created_at").alias("decided_at"),
        F.when(k == 1, "confirm").when(k == 2, "new").when(k == 3, "uncertain").otherwise("disqualify").alias("verdict"),
        F.when(k == 4, F.array(F.lit("blurred"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        (F.col("individual_id") + 1).alias("chosen_individual_id"), (-F.col("image_id")).alias("new_individual_id"), F.col("individual_id").alias("suggested_individual_id"), F.col("q_overall").alias("suggested_confidence"),
    )
    stale = rows.withColumn("verdict", F.lit("uncertain")).withColumn("id", F.col("id") - 1)
    store = _store(images)
    store.commit(store.snapshot(), {"images": Put(images.select("image_id", "individual_id", "status", F.lit(0).alias("rev")), ("image_id",))}, "load")
    return W.record_decisions(store, rows.unionByName(stale.where("image_id % 8 < 4")), 0.5)


@add("images", sql="""
    WITH d AS (SELECT image_id, image_id % 8 AS k, coalesce(q_overall >= 0.5, FALSE) AS suggested FROM images WHERE image_id % 8 BETWEEN 1 AND 4)
    SELECT image_id, CASE k WHEN 1 THEN 'confirm' WHEN 2 THEN 'new' WHEN 3 THEN 'uncertain' ELSE 'disqualify' END AS verdict, k <= 2 AND suggested AS was_override,
      CASE WHEN k = 4 THEN 'blurred' END AS chip, CASE WHEN k = 2 THEN -image_id END AS enrolled FROM d""")
def wf_decide_log(images: DataFrame) -> DataFrame:
    """Decisions, their reasons and the individuals they enrolled, as one commit left them."""
    now = _decided(images)
    log = now.table("review_decisions").join(now.table("review_decision_reasons"), "id", "left")
    new = now.table("individuals").select(F.col("reference_image_id").alias("image_id"), F.col("individual_id").alias("enrolled"))
    return log.join(new, "image_id", "left").select("image_id", "verdict", "was_override", "chip", "enrolled")


@add("individuals", "images", sql="SELECT individual_id, CASE WHEN status = 'provisional' AND individual_id IN (SELECT individual_id FROM images WHERE review_batch_id = 5 AND status = 'confirmed') AND individual_id NOT IN (SELECT individual_id FROM images WHERE status = 'flagged_uncertain') THEN 'published' ELSE status END AS status FROM individuals")
def wf_publish(individuals: DataFrame, images: DataFrame) -> DataFrame:
    """Publishing a batch promotes individuals with a confirmed and no uncertain sighting."""
    return W.publish_batch(individuals, images, 5).select("individual_id", "status")


@add("models", sql="SELECT model_id, CASE WHEN kind = 'Brand#11' AND model_id = 123 THEN 'active' WHEN kind = 'Brand#11' AND status = 'active' THEN 'candidate' ELSE status END AS status FROM models")
def wf_models(models: DataFrame) -> DataFrame:
    return W.promote(models, "Brand#11", 123).select("model_id", "status")


@add("models", sql="SELECT kind, arg_max(model_id, (bal_acc, -model_id)) AS model_id FROM models GROUP BY 1")
def wf_best_models(models: DataFrame) -> DataFrame:
    """The model with the best balanced accuracy of each kind."""
    return W.best_per_kind(models, "bal_acc")


@add("models", sql="SELECT model_id, 'candidate' AS status FROM models WHERE model_id % 4 = 0 UNION ALL SELECT model_id, status FROM models WHERE model_id % 4 <> 0")
def wf_register_models(models: DataFrame) -> DataFrame:
    """Every fourth model is new to the registry and comes in as a candidate."""
    return W.register(models.where("model_id % 4 <> 0"), models.drop("status")).select("model_id", "status")


@add("models", sql="WITH b AS (SELECT kind, min(model_id) AS back FROM models GROUP BY 1) SELECT model_id, CASE WHEN model_id = back THEN 'active' WHEN status = 'active' THEN 'candidate' ELSE status END AS status FROM models JOIN b USING (kind)")
def wf_rollback_models(models: DataFrame) -> DataFrame:
    """Two promotions of each kind; the later one, before which the least id was active, is taken back."""
    ends = models.groupBy("kind").agg(F.min("model_id").alias("a"), F.max("model_id").alias("z"))
    entry = lambda k, name: ends.select(F.lit(k).alias("id"), F.expr(f"TIMESTAMP_NTZ '2024-01-0{k}'").alias("at_ts"), F.lit("promote").alias("action"), F.col("kind").alias("entity"), F.to_json(F.struct(F.col(name).alias("from"))).alias("before_json"))
    return W.rollback(models, entry(1, "z").unionByName(entry(2, "a"))).select("model_id", "status")


@add("spots", sql="SELECT image_id, spot_id, area FROM spots")
def wf_revert_spots(spots: DataFrame) -> DataFrame:
    """Spots of every third image are snapped, edited and reverted: all are as they were."""
    rows = spots.select("image_id", "spot_id", "area")
    snapshots = W.spot_snapshot(rows, rows.where("image_id % 3 = 0"))
    edited = rows.where("image_id % 3 <> 0 OR spot_id <> 2").withColumn("area", F.when(F.col("image_id") % 3 == 0, F.col("area") * 2).otherwise(F.col("area")))
    return W.revert_spots(edited, snapshots)


@add("images", "activity", sql="WITH l AS (SELECT coalesce(max(created_at), TIMESTAMP '1970-01-01') AS last FROM images WHERE status = 'flagged_uncertain') SELECT datediff('day', last, DATE '2001-09-01') >= 30 OR (SELECT count(*) FROM images WHERE created_at > last) >= 200 AS due, (SELECT count(*) FROM images WHERE created_at > last) AS new_images FROM l")
def wf_training_due(images: DataFrame, activity: DataFrame) -> DataFrame:
    runs = images.where("status = 'flagged_uncertain'").select(F.col("created_at").alias("finished_at"))
    return W.training_due(images, runs, F.to_date(F.lit("2001-09-01")), 30, 200)


@add("spots", sql="SELECT image_id, CASE WHEN spot_id = 3 THEN 1 ELSE spot_id END AS spot_id, round(sum(area), 6) AS area, count(*) AS parts FROM spots WHERE spot_id <> 2 GROUP BY 1, 2")
def wf_edit_spots(spots: DataFrame) -> DataFrame:
    """The second spot of each image is deleted, the third joined to the first."""
    edits = spots.where("spot_id IN (2, 3)").select("image_id", "spot_id", F.when(F.col("spot_id") == 2, "delete").otherwise("join").alias("action"), F.lit(1).cast("bigint").alias("into"))
    out = W.edit_spots(spots.select("image_id", "spot_id", "area"), edits)
    return out.select("image_id", "spot_id", F.round("area", 6).alias("area"), "parts")


@add("images", sql="SELECT count(*) AS n FROM images WHERE status = 'in_review'")
def wf_audit(images: DataFrame) -> DataFrame:
    """Changed rows leave an audit row each."""
    before = images.select("image_id", "status")
    after = sinks.update(before, F.col("status") == "in_review", status="confirmed")
    rows = W.audit_rows(before, after, "image_id", "update", "system", F.expr("TIMESTAMP_NTZ '2001-01-01'"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@add("activity", sql="SELECT CAST(count(*) AS BIGINT) AS used, greatest(500 - count(*), 0) AS left, count(*) >= 400 AS warn FROM activity WHERE CAST(at_ts AS DATE) = DATE '2024-01-05'")
def wf_budget(activity: DataFrame) -> DataFrame:
    usage = activity.groupBy(F.to_date("at_ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    return W.budget(usage, F.to_date(F.lit("2024-01-05")), 500)


@add("individuals", sql="SELECT display_id AS key, CASE WHEN individual_id % 3 = 0 THEN status ELSE 'default' END AS value FROM individuals")
def wf_settings(individuals: DataFrame) -> DataFrame:
    defaults = individuals.select(F.col("display_id").alias("key"), F.lit("default").alias("value"))
    return W.settings(defaults, individuals.where("individual_id % 3 = 0").select(F.col("display_id").alias("key"), F.col("status").alias("value")))


@add("activity", sql="SELECT kind AS type, count(*) FILTER (WHERE actor % 3 <> 0 AND actor % 2 <> 0) AS unread, count(*) FILTER (WHERE actor % 3 <> 0) AS open FROM activity GROUP BY 1")
def wf_notify(activity: DataFrame) -> DataFrame:
    rows = activity.select(F.col("kind").alias("type"), F.when(F.col("actor") % 2 == 0, F.col("at_ts")).alias("read_at"), F.when(F.col("actor") % 3 == 0, F.col("at_ts")).alias("dismissed_at"))
    return W.notifications(rows)


# Splits


@add("images", sql=f"SELECT image_id, individual_id, CAST(floor({_U.format(chr(39) + 'fold:' + chr(39) + ' || individual_id')} * 5) AS INT) AS fold, CASE WHEN count(*) OVER (PARTITION BY individual_id) = 1 THEN 'open_query' WHEN row_number() OVER (PARTITION BY individual_id ORDER BY {_U.format(chr(39) + 'query:' + chr(39) + ' || image_id')}, image_id) = 1 THEN 'closed_query' ELSE 'gallery' END AS role FROM images WHERE NOT is_synthetic AND n_spots > 0")
def split_folds(images: DataFrame) -> DataFrame:
    """Folds by individual, with gallery and query roles."""
    return N.split_roles(images, 5)


@add("images", sql=f"SELECT fold, count(*) AS labels FROM (SELECT individual_id, CASE WHEN count(*) >= 2 THEN CAST(floor({_U.format(chr(39) + 'cv:' + chr(39) + ' || individual_id')} * 5) AS INT) ELSE -1 END AS fold FROM images WHERE NOT is_synthetic GROUP BY 1) GROUP BY 1")
def split_cv(images: DataFrame) -> DataFrame:
    """Folds of labels with at least two real images; others only train (fold -1)."""
    per = images.where("NOT is_synthetic").groupBy("individual_id").agg(F.count(F.lit(1)).alias("n"))
    fold = F.when(F.col("n") >= 2, N.fold_of("individual_id", 5, "cv")).otherwise(F.lit(-1))
    return per.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("labels"))


@add("individuals", sql=f"SELECT CASE WHEN row_number() OVER (ORDER BY {_U.format(chr(39) + 'open:' + chr(39) + ' || individual_id')}, individual_id) <= CAST(round_even(0.35 * count(*) OVER (), 0) AS BIGINT) THEN 'novel' ELSE 'known' END AS role, individual_id FROM individuals")
def split_openset(individuals: DataFrame) -> DataFrame:
    """35 % of the labels, rounded half to even, are novel."""
    rows = individuals.select("individual_id", N.uniform(F.lit("open"), "individual_id").alias("u"))
    placed = R.global_places(rows, "u", ["individual_id"])
    return placed.select(F.when(F.col("place") < F.bround(0.35 * F.col("rows"), 0), "novel").otherwise("known").alias("role"), "individual_id")


@add("individuals", sql=f"WITH u AS (SELECT DISTINCT individual_id, {_U.format(chr(39) + 'nested:' + chr(39) + ' || individual_id')} AS u FROM individuals) SELECT f AS fraction, count(*) FILTER (WHERE u < f) AS labels FROM u, (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS f) GROUP BY 1")
def split_nested(individuals: DataFrame) -> DataFrame:
    return N.nested_fractions(individuals, "individual_id", [0.25, 0.5, 1.0])


@add("images", sql="""
    WITH c AS (SELECT image_id, individual_id, review_batch_id % 3 AS fold, CASE status WHEN 'confirmed' THEN 'gallery' WHEN 'in_review' THEN 'closed_query' ELSE 'open_query' END AS role FROM images UNION ALL SELECT image_id, individual_id, 0, 'gallery' FROM images WHERE image_id % 50 = 0),
    i AS (SELECT count(*) AS n, count(DISTINCT role) AS roles FROM c GROUP BY image_id), l AS (SELECT count(DISTINCT fold) AS folds, count(*) FILTER (WHERE role = 'gallery') AS g, count(*) FILTER (WHERE role = 'closed_query') AS c, count(*) FILTER (WHERE role = 'open_query') AS o FROM c GROUP BY individual_id)
    SELECT (SELECT count(*) FROM i WHERE n > 1) AS repeated_images, (SELECT count(*) FROM i WHERE roles > 1) AS images_in_two_roles, count(*) FILTER (WHERE folds > 1) AS labels_in_two_folds, count(*) FILTER (WHERE o > 0 AND g > 0) AS open_with_gallery,
      count(*) FILTER (WHERE c > 0 AND g = 0) AS closed_without_gallery, count(*) FILTER (WHERE c > 1) AS several_queries FROM l""")
def split_leakage(images: DataFrame) -> DataFrame:
    """The checks of a careless split, by batch and status, with some photos put in twice: all of them find something."""
    role = F.when(F.col("status") == "confirmed", "gallery").when(F.col("status") == "in_review", "closed_query").otherwise("open_query")
    rows = images.select("image_id", "individual_id", (F.col("review_batch_id") % 3).alias("fold"), role.alias("role"))
    twice = images.where("image_id % 50 = 0").select("image_id", "individual_id", F.lit(0).cast("long").alias("fold"), F.lit("gallery").alias("role"))
    return N.leakage_checks(rows.unionByName(twice))


@add("vectors", sql=f"SELECT spot_id, photo_id FROM vectors WHERE {_U.format(chr(39) + 'drop:' + chr(39) + ' || spot_id')} >= 0.3 OR spot_id IN (SELECT min(spot_id) FROM vectors GROUP BY photo_id)")
def aug_dropout(vectors: DataFrame) -> DataFrame:
    """Spots dropped by hash; each photo keeps its first."""
    first = F.min("spot_id").over(Window.partitionBy("photo_id"))
    rows = vectors.withColumn("first", first)
    return rows.where((N.uniform(F.lit("drop"), "spot_id") >= 0.3) | (F.col("spot_id") == F.col("first"))).select("spot_id", "photo_id")


_GAUSS = "sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


@add("vectors", sql=f"""
    WITH x AS (SELECT spot_id, i - 1 AS k, CAST(embedding[i] AS DOUBLE) AS e FROM vectors, range(1, 65) r(i)),
    n AS (SELECT spot_id, k, e + 0.05 * {_GAUSS.format(u=_U.format("'radius:' || spot_id || ':' || k"), v=_U.format("'angle:' || spot_id || ':' || k"))} AS e FROM x)
    SELECT spot_id, round(e / sqrt(sum(e * e) OVER (PARTITION BY spot_id)), 6) AS value, CAST(k AS INT) AS position FROM n""")
def aug_jitter(vectors: DataFrame) -> DataFrame:
    """Gaussian noise on unit vectors, by hash, made unit again; a row for each component."""
    u, v = (N.uniform(F.lit(n), "spot_id", "position") for n in ("radius", "angle"))
    rows = vectors.select("spot_id", F.posexplode("embedding").alias("position", "e"))
    noisy = rows.withColumn("e", F.col("e").cast("double") + 0.05 * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v))
    size = F.sqrt(F.sum(F.col("e") * F.col("e")).over(Window.partitionBy("spot_id")))
    return noisy.select("spot_id", F.round(F.col("e") / size, 6).alias("value"), "position")


# Functions


@add("vectors", sql="SELECT a.spot_id AS a, b.spot_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 2, 6) AS additive FROM vectors a JOIN vectors b ON b.spot_id = a.spot_id + 1")
def fn_cosine(vectors: DataFrame) -> DataFrame:
    """Cosine and the additive form, by higher-order functions."""
    a, b = vectors.select(F.col("spot_id").alias("a"), F.col("embedding").alias("x")), vectors.select((F.col("spot_id") - 1).alias("a"), F.col("spot_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(S.cosine("x", "y"), 6).alias("cosine"), F.round(S.additive_cosine("x", "y"), 6).alias("additive"))


@add("models", sql="SELECT model_id, round(1 / (1 + exp(-(4 * bal_acc - 2))), 6) AS platt, least(greatest(bal_acc * 1.5, 0), 1) AS identity, round(exp(-bal_acc / 0.5::DOUBLE), 6) AS gate, coalesce(least(greatest((r1 - 0.2) / 0.6, 0), 1), 0) AS observable FROM models")
def fn_calibration(models: DataFrame) -> DataFrame:
    """Platt scaling, the clamped identity, the position gate and the observability ramp."""
    return models.select("model_id", F.round(S.sigmoid_platt("bal_acc", 4.0, -2.0), 6).alias("platt"), S.sigmoid_platt(F.col("bal_acc") * 1.5, None).alias("identity"), F.round(S.gauss_gate("bal_acc", 0.5), 6).alias("gate"), S.observability("r1", F.lit(0.2), F.lit(0.8)).alias("observable"))


@add("models", sql="SELECT model_id, round(0.6 * coalesce(r1, 0) + 0.4 * bal_acc, 6) AS score FROM models")
def fn_score_linear(models: DataFrame) -> DataFrame:
    """A linear score from text coefficients; a malformed one and an unknown letter count 0."""
    coefficients = F.create_map(*(F.lit(x) for x in ("a", "0.6", "f", "0.4", "c", "many", "z", "9")))
    return models.select("model_id", S.score_linear({"a": "r1", "f": "bal_acc", "c": "blur"}, coefficients).alias("score"))


@add("vectors", sql="SELECT spot_id, regexp_replace(photo_id, '_[^_]*$', '') AS label, split_part(photo_id, '_', 1) AS code, upper(regexp_replace(photo_id, '_([^_]*)$', '-\\1')) AS display, regexp_matches(photo_id, '_g[0-9]+$') AS synthetic FROM vectors")
def fn_ids(vectors: DataFrame) -> DataFrame:
    """Labels, codes and displayed names from ids."""
    return vectors.select("spot_id", S.label_strict("photo_id").alias("label"), S.code("photo_id").alias("code"), S.display("photo_id").alias("display"), S.is_synthetic("photo_id").alias("synthetic"))


@add("activity", sql="SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM activity")
def fn_json_get(activity: DataFrame) -> DataFrame:
    return activity.select("id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@add("spots", sql="SELECT image_id, spot_id, round(2 * area * area, 6) AS polygon_area, round(6 * area, 6) AS perimeter FROM spots")
def fn_polygon_area(spots: DataFrame) -> DataFrame:
    """Area and perimeter of a rectangle of 2a by a, from arrays of points."""
    a = F.col("area")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = F.array(point(-a, -a / 2), point(a, -a / 2), point(a, a / 2), point(-a, a / 2))
    return spots.select("image_id", "spot_id", F.round(S.polygon_area(p), 6).alias("polygon_area"), F.round(S.perimeter(p), 6).alias("perimeter"))


# Models


@add("verdicts")
def ml_logreg(verdicts: DataFrame) -> DataFrame:
    """Out-of-fold probabilities of a balanced logistic regression over two features."""
    rows = verdicts.select("edge_id", F.log1p("score").alias("x"), F.length("label").cast("double").alias("y"), "accepted", N.fold_of("label", 3).alias("fold"))
    return ML.out_of_fold(rows, ["x", "y"], "accepted", "fold", 3, balanced=True).select("edge_id", "fold", "confidence")


@add("verdicts")
def ml_platt(verdicts: DataFrame) -> DataFrame:
    """Platt scaling fitted on half of the labels and applied to all."""
    rows = verdicts.select("edge_id", F.log1p("score").alias("s"), "accepted", N.fold_of("label", 2).alias("fold"))
    a, b = ML.platt(rows.where("fold = 0"), "s", "accepted")
    return rows.select("edge_id", S.sigmoid_platt("s", a, b).alias("confidence"))


@add("verdicts")
def match_llr(verdicts: DataFrame) -> DataFrame:
    """Log likelihood ratio of two fitted models, summed for each label."""
    rows = verdicts.select("edge_id", F.log1p("score").alias("x"), "accepted", "novel", "label")
    same, null = ML.Logistic(["x"], "accepted").fit(rows), ML.Logistic(["x"], "novel").fit(rows)
    return ML.log_likelihood_ratio(rows, same, null, ["label"])


# Streams, an extension; here as the batch form of the same plan


@add("activity", sql="SELECT CAST(date_trunc('hour', at_ts) AS TIMESTAMP) AS hour, kind, count(*) AS n, round(sum(value), 6) AS total FROM activity GROUP BY 1, 2")
def stream_windows(activity: DataFrame) -> DataFrame:
    """Hourly counts by kind."""
    log = activity.select(F.col("at_ts").alias("ts"), F.col("kind").alias("event_type"), "value")
    out = stream.windowed_counts(log)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("kind"), "n", F.round("total", 6).alias("total"))


@add("activity", sql="WITH f AS (SELECT actor, at_ts, CASE WHEN at_ts < lag(at_ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM activity WINDOW w AS (PARTITION BY actor ORDER BY at_ts)), s AS (SELECT actor, at_ts, sum(fresh) OVER (PARTITION BY actor ORDER BY at_ts RANGE UNBOUNDED PRECEDING) AS k FROM f) SELECT actor, CAST(min(at_ts) AS TIMESTAMP) AS begun, count(*) AS n FROM s GROUP BY actor, k")
def stream_sessions(activity: DataFrame) -> DataFrame:
    """Sessions of an actor: events less than six hours apart."""
    out = stream.sessions(activity.select(F.col("at_ts").alias("ts"), F.col("actor").alias("user_id")), "6 hours")
    return out.select(F.col("user_id").alias("actor"), F.col("session.start").cast("timestamp_ntz").alias("begun"), "n")
