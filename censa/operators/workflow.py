"""State transitions of the census workflow: each takes tables and events and gives the tables' next state.

Nothing is changed in place. Rows carry `rev`, which goes up with each change; a change that names an old rev is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import was_override
from ..sources.store import Append, Put, Replace, Snapshot, Store, changed


def transfer(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """`incoming` with an outcome: added, unchanged (same checksum) or conflict (another checksum; the old image stays)."""
    known = existing.select("image_id", F.col("source_checksum").alias("_known"))
    rows = incoming.join(known, "image_id", "left")
    outcome = F.when(F.col("_known").isNull(), "added").when(F.col("_known") == F.col("source_checksum"), "unchanged").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("_known")


def chase_aliases(merges: DataFrame, rounds: int = 40) -> DataFrame:
    """(alias, keep) with chains followed to their end by doubling; an alias that leads back to itself keeps its last step.

    Of several steps of an alias the least `keep` counts. Doubling ends after the logarithm of the longest chain; a ring
    of more aliases has no end, and raises.
    """
    now = merges.where("alias <> keep").groupBy("alias").agg(F.min("keep").alias("keep")).persist()
    for _ in range(rounds):
        step = now.select(F.col("alias").alias("keep"), F.col("keep").alias("_next"))
        on = F.col("_next").isNotNull() & (F.col("_next") != F.col("alias"))
        moved = now.join(step, "keep", "left").select("alias", F.when(on, F.col("_next")).otherwise(F.col("keep")).alias("keep"), on.alias("_moved")).persist()
        done = moved.where("_moved").isEmpty()
        now.unpersist()
        now = moved
        if done:
            return now.select("alias", "keep")
    raise ValueError("merges lead round in a ring")


def apply_corrections(images: DataFrame, individuals: DataFrame, merges: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images relabelled by single-hop merges and disqualified by exclusions (image_id or individual_id), individuals with merged_into."""
    hop = merges.select(F.col("alias").alias("individual_id"), "keep").dropDuplicates(["individual_id"])
    moved = images.join(hop, "individual_id", "left").withColumn("individual_id", F.coalesce("keep", "individual_id")).drop("keep")
    by_image = excluded.where("image_id IS NOT NULL").select("image_id").distinct().withColumn("_x", F.lit(True))
    by_label = excluded.where("individual_id IS NOT NULL").select("individual_id").distinct().withColumn("_y", F.lit(True))
    out = moved.join(by_image, "image_id", "left").join(by_label, "individual_id", "left")
    gone = F.coalesce("_x", "_y", F.lit(False))
    out = out.withColumn("status", F.when(gone, "disqualified").otherwise(F.col("status"))).drop("_x", "_y").select(*images.columns)
    people = individuals.join(hop, "individual_id", "left").withColumn("status", F.when(F.col("keep").isNotNull(), "merged").otherwise(F.col("status"))).withColumnRenamed("keep", "merged_into")
    return out, people


def ingest(images: DataFrame, sightings: DataFrame) -> DataFrame:
    """Adds sightings; their status follows from whether the extraction gave spots."""
    status = F.when(F.col("n_spots").isNull(), "failed").when(F.col("n_spots") == 0, "hand_correction").otherwise("extracted")
    return images.unionByName(sightings.withColumn("status", status), allowMissingColumns=True)


def decide(images: DataFrame, decisions: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Applies the last decision on each image.

    confirm sets the individual, new a provisional one, uncertain and disqualify only the status; a disqualification needs a
    reason and is otherwise void. Gives the images and the decisions with was_override.
    """
    valid = (F.col("verdict") != "disqualify") | (F.size(F.coalesce("reasons", F.array())) > 0)
    order = Window.partitionBy("image_id").orderBy(F.col("decided_at").desc(), F.col("id").desc())
    last = decisions.where(valid).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    suggested = F.when(F.col("suggested_confidence") >= threshold, F.col("suggested_individual_id"))
    chosen = F.when(F.col("verdict") == "confirm", F.col("chosen_individual_id"))
    log = last.withColumn("was_override", F.when(F.col("verdict").isin("confirm", "new"), was_override(chosen, suggested) & suggested.isNotNull()).otherwise(F.lit(False)))
    status = F.create_map(*(F.lit(x) for pair in (("confirm", "confirmed"), ("new", "enrolled_new"), ("uncertain", "flagged_uncertain"), ("disqualify", "disqualified")) for x in pair))
    step = log.select("image_id", "verdict", "chosen_individual_id", "new_individual_id")
    rows = images.join(step, "image_id", "left")
    own = F.when(F.col("verdict") == "confirm", F.col("chosen_individual_id")).when(F.col("verdict") == "new", F.col("new_individual_id")).otherwise(F.col("individual_id"))
    rows = rows.withColumn("individual_id", own).withColumn("status", F.coalesce(status[F.col("verdict")], F.col("status"))).withColumn("rev", F.col("rev") + F.col("verdict").isNotNull().cast("int"))
    return rows.select(*images.columns), log


def publish_batch(individuals: DataFrame, images: DataFrame, batch: int) -> DataFrame:
    """Provisional individuals with a confirmed sighting in the batch become published, unless one of their sightings is uncertain."""
    own = images.where(F.col("review_batch_id") == batch)
    sure = own.where("status = 'confirmed'").select("individual_id").distinct()
    held = images.where("status = 'flagged_uncertain' AND individual_id IS NOT NULL").select("individual_id").distinct()
    ready = sure.join(held, "individual_id", "left_anti").withColumn("_ready", F.lit(True))
    rows = individuals.join(ready, "individual_id", "left")
    return rows.withColumn("status", F.when((F.col("status") == "provisional") & F.coalesce("_ready", F.lit(False)), "published").otherwise(F.col("status"))).drop("_ready").select(*individuals.columns)


def register(models: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the models of `found` that are not yet there, as candidates; known ids stay as they are."""
    new = found.join(models.select("model_id"), "model_id", "left_anti")
    return models.unionByName(new.withColumn("status", F.lit("candidate")), allowMissingColumns=True)


def best_per_kind(models: DataFrame, measure: str) -> DataFrame:
    """(kind, model_id) of the model with the highest measure of each kind; of equals the least id, unmeasured ones last."""
    best = models.groupBy("kind").agg(F.max(F.struct(F.col(measure).isNotNull().alias("some"), F.coalesce(measure, F.lit(0)).alias("m"), (-F.col("model_id")).alias("i"))).alias("b"))
    return best.select("kind", (-F.col("b.i")).alias("model_id"))


def rollback(models: DataFrame, audit: DataFrame) -> DataFrame:
    """Each kind's last promotion taken back: the model that was active before, by the audit's JSON, is active again.

    Kinds without a promotion, and those whose earlier model is unknown or gone, stay as they are.
    """
    last = audit.where("action = 'promote'").groupBy(F.col("entity").alias("kind")).agg(F.max_by("before_json", F.struct("at_ts", "id")).alias("j"))
    back = last.select("kind", F.get_json_object("j", "$.from").cast("bigint").alias("_back"))
    back = back.join(models.select("kind", F.col("model_id").alias("_back")), ["kind", "_back"], "left_semi")
    status = F.when(F.col("_back").isNull(), F.col("status")).when(F.col("model_id") == F.col("_back"), "active").when(F.col("status") == "active", "candidate").otherwise(F.col("status"))
    return models.join(back, "kind", "left").withColumn("status", status).select(*models.columns)


def promote(models: DataFrame, kind: str, model_id) -> DataFrame:
    """One active model of a kind: the named one; the former becomes a candidate. The same call takes a promotion back."""
    own = F.col("kind") == kind
    return models.withColumn("status", F.when(own & (F.col("model_id") == model_id), "active").when(own & (F.col("status") == "active"), "candidate").otherwise(F.col("status")))


def rollback_target(audit: DataFrame, kind: str) -> DataFrame:
    """The model that was active before the last promotion of a kind, from the audit's JSON."""
    rows = audit.where((F.col("action") == "promote") & (F.col("entity") == kind))
    return rows.orderBy(F.col("at_ts").desc()).limit(1).select(F.get_json_object("before_json", "$.from").alias("model"))


def training_due(images: DataFrame, runs: DataFrame, now: Column, days: int, fresh: int) -> DataFrame:
    """(due, new_images): due when the last run is too long ago or enough images came since."""
    last = runs.agg(F.coalesce(F.max("finished_at"), F.expr("TIMESTAMP_NTZ '1970-01-01'")).alias("last"))
    new = images.join(F.broadcast(last), F.col("created_at") > F.col("last"))  # one row is broadcast
    counts = new.agg(F.count(F.lit(1)).alias("new_images")).join(F.broadcast(last))
    return counts.select(((F.datediff(now, "last") >= days) | (F.col("new_images") >= fresh)).alias("due"), "new_images")


def edit_spots(spots: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins and deletes spots of images: (image_id, spot_id, action, into). Joined spots add their areas to the target."""
    rows = spots.join(edits.select("image_id", "spot_id", "action", "into"), ["image_id", "spot_id"], "left").where("action IS NULL OR action <> 'delete'")
    target = F.when(F.col("action") == "join", F.col("into")).otherwise(F.col("spot_id"))
    return rows.groupBy("image_id", target.alias("spot_id")).agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("parts"))


def spot_snapshot(spots: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, snapshot): all spots of the named images as JSON, taken before an edit; [] for an image without spots."""
    own = spots.join(images.select("image_id").distinct(), "image_id", "left_semi")
    packed = own.groupBy("image_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("spot_id", *(c for c in spots.columns if c not in ("image_id", "spot_id")))))).alias("snapshot"))
    return images.select("image_id").distinct().join(packed, "image_id", "left").withColumn("snapshot", F.coalesce("snapshot", F.lit("[]")))


def revert_spots(spots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Spots with those of the snapshots' images replaced by what the snapshots hold; other images stay."""
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in spots.schema if f.name != "image_id")
    held = snapshots.select("image_id", F.explode(F.from_json("snapshot", f"array<struct<{kinds}>>")).alias("x")).select("image_id", "x.*")
    return spots.join(snapshots.select("image_id"), "image_id", "left_anti").unionByName(held)


def audit_rows(before: DataFrame, after: DataFrame, key: str, action: str, actor: str, at: Column) -> DataFrame:
    """A row for each changed row of a table: what it was and what it is, as JSON."""
    pack = lambda df, name: df.select(F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct(*sorted(df.columns))).alias(name))
    both = pack(before, "before_json").join(pack(after, "after_json"), "entity_id", "full")
    changed = both.where(~F.col("before_json").eqNullSafe(F.col("after_json")))
    return changed.select(at.alias("at_ts"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), "entity_id", "before_json", "after_json")


def guarded(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Splits changes by optimistic concurrency: those that name the current rev, and those that do not."""
    current = table.select(key, F.col("rev").alias("_rev"))
    rows = changes.join(current, key, "left")
    fits = F.coalesce(F.col("rev") == F.col("_rev"), F.lit(False))
    return rows.where(fits).drop("_rev"), rows.where(~fits).drop("_rev")


def budget(usage: DataFrame, day: Column, limit: int, warn: float = 0.8) -> DataFrame:
    """(used, left, warn) of a day's calls."""
    used = usage.where(F.col("day") == day).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("used"))
    return used.select("used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).alias("left"), (F.col("used") >= warn * limit).alias("warn"))


def settings(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Defaults overlaid by what is stored; unknown stored keys are ignored."""
    return defaults.join(stored.select("key", F.col("value").alias("_v")), "key", "left").select("key", F.coalesce("_v", "value").alias("value"))


def notifications(rows: DataFrame) -> DataFrame:
    """Counts of unread and open notifications by type."""
    open_ = F.col("dismissed_at").isNull()
    return rows.groupBy("type").agg(F.count_if(open_ & F.col("read_at").isNull()).alias("unread"), F.count_if(open_).alias("open"))


# Changes that are written: each is one commit of a store, all tables or none.


def replace_extraction(store: Store, tables: dict[str, DataFrame], images: DataFrame, key: str = "image_id") -> Snapshot:
    """Everything that is held about `images` goes, in all named tables, and their new rows come, if there are any."""
    return store.change(lambda _: {name: Replace(rows, images.select(key)) for name, rows in tables.items()}, "replace extraction")


def record_matches(store: Store, candidates: DataFrame, model: str, coverage: float, most: int) -> Snapshot:
    """Keeps ranked candidates (query, rank, candidate, photo, similarity, confidence) and marks their photos as matched.

    A result is known by query, model and version, so that a photo matched again has another result. Photos that are
    confirmed, disqualified or enrolled keep their status and rev; candidates may be empty.
    """

    def step(now: Snapshot) -> dict:
        result = F.md5(F.concat_ws(":", F.col("query").cast("string"), F.lit(model), F.lit(now.version)))
        found = candidates.withColumn("match_result_id", result)
        results = found.select(F.col("match_result_id").alias("id"), "query").distinct().withColumns({"model_name": F.lit(model), "coverage_target": F.lit(coverage), "max_candidates": F.lit(most), "version": F.lit(now.version + 1)})
        images = now.table("images")
        open_ = images.where("status NOT IN ('confirmed', 'disqualified', 'enrolled_new')").join(results.select(F.col("query").alias("image_id")), "image_id", "left_semi")
        matched = open_.withColumns({"status": F.lit("matched"), "rev": F.col("rev") + 1}).select(*images.columns)
        add = lambda name, rows: Append(rows) if name in now.tables else Put(rows)
        return {"match_results": add("match_results", results), "match_candidates": add("match_candidates", found.drop("query")), "images": Replace(matched)}

    return store.change(step, "match")


def latest_candidates(now: Snapshot) -> DataFrame:
    """The candidates of each photo's last result, as they were kept."""
    last = Window.partitionBy("query").orderBy(F.col("version").desc(), "id")
    results = now.table("match_results").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    return now.table("match_candidates").join(results.select("query", F.col("id").alias("match_result_id")), "match_result_id").drop("match_result_id")


def record_decisions(store: Store, decisions: DataFrame, threshold: float) -> Snapshot:
    """Applies decisions to the images of a store, and keeps them and their reasons; see `decide`.

    Only images that change are written. New individuals come with those that they were enrolled from.
    """

    def step(now: Snapshot) -> dict:
        images = now.table("images")
        after, log = decide(images, decisions, threshold)
        reasons = log.select("id", F.explode("reasons").alias("chip"))
        enrolled = log.where("verdict = 'new'").select(F.col("new_individual_id").alias("individual_id"), F.lit("provisional").alias("status"), F.col("image_id").alias("reference_image_id"))
        add = lambda name, rows: Append(rows) if name in now.tables else Put(rows)
        return {"images": Replace(changed(images, after, ["image_id"])), "review_decisions": add("review_decisions", log.drop("reasons")), "review_decision_reasons": add("review_decision_reasons", reasons), "individuals": add("individuals", enrolled)}

    return store.change(step, "decide")
