"""Sources: tables, JSON stores, JSON lines, CSV and pandas frames, and the catalogue of what is there."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Schemas of the extraction and workflow tables.
SCHEMAS = {
    "images": "image_id string, width int, height int, n_spots int, source_image string, created_at timestamp_ntz, body_mask_png binary, is_synthetic boolean",
    "spots": "image_id string, spot_id int, global_centroid_x double, global_centroid_y double, area_pixels double, local_contour array<array<double>>, bin int, axial_bin int, lateral_bin string, axis_t double, axis_side string, axis_offset double",
    "body_axis": "image_id string, head_x double, head_y double, tail_tip_x double, tail_tip_y double, length_px double, midline_x array<double>, midline_y array<double>, source string, judged_ok boolean, judge_feedback string",
    "body_bins": "bin_id string, image_id string, bin int, quartile int, side string, t_lo double, t_hi double, polygon_x array<double>, polygon_y array<double>",
    "image_quality": "image_id string, n_spots int, judged_ok boolean, blur_quality double, lighting_quality double, spot_extraction_quality double, body_extraction_quality double, overall_quality double",
    "spot_embeddings": "image_id string, spot_id int, embedding array<double>",
}

#: A review store: individuals, their matches and image decisions.
REVIEW_STORE = """
rev bigint, updated_at string, individuals map<string, struct<
  images: map<string, struct<decision: string, reasons: array<string>, train_ok: boolean, eval_ok: boolean, is_synthetic: boolean, n_spots: int>>,
  matches: array<struct<match_id: string, members: array<struct<image: string, spot: int>>, accepted: boolean, proposed_by: string, method: string>>>>
"""

VERDICT_SCHEMA = "match_id string, individual string, sid_a string, spot_a int, sid_b string, spot_b int, accepted boolean, proposed_by string, method string, pair_kind string"


def or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """What `read` gives, or an empty table of the schema where nothing is at its path."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table; with a schema, missing columns are null and a missing path is an empty table."""
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return or_empty(spark, lambda: reader.parquet(path), schema) if schema else reader.parquet(path)


def read_review_store(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Review stores, a JSON document a file, or with `lines` one a line, as many files as there are; a missing path is an empty store."""
    return or_empty(spark, lambda: spark.read.schema(REVIEW_STORE).option("multiLine", str(not lines).lower()).json(path), REVIEW_STORE)


def match_verdicts(store: DataFrame) -> DataFrame:
    """A row for each unordered pair of members of each match: see VERDICT_SCHEMA."""
    one = store.select(F.explode("individuals").alias("individual", "v")).select("individual", F.explode("v.matches").alias("m"))
    n = F.size("m.members")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(F.col("m.members")[i].alias("a"), F.col("m.members")[j].alias("b")))))
    rows = one.where(n >= 2).select("individual", "m", F.explode(pairs).alias("p"))
    kind = F.when(F.col("p.a.image") == F.col("p.b.image"), "same_image").otherwise("cross_image")
    return rows.select(F.col("m.match_id").alias("match_id"), "individual", F.col("p.a.image").alias("sid_a"), F.col("p.a.spot").alias("spot_a"), F.col("p.b.image").alias("sid_b"), F.col("p.b.spot").alias("spot_b"), "m.accepted", "m.proposed_by", "m.method", kind.alias("pair_kind"))


def image_decisions(store: DataFrame) -> DataFrame:
    """(image_id, individual, decision, reasons, train_ok, eval_ok) of each reviewed image."""
    one = store.select(F.explode("individuals").alias("individual", "v")).select("individual", F.explode("v.images").alias("image_id", "d"))
    return one.select("image_id", "individual", "d.decision", F.coalesce("d.reasons", F.array()).alias("reasons"), "d.train_ok", "d.eval_ok")


def reason_counts(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are left out."""
    return or_empty(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), schema)


def read_label_map(spark: SparkSession, path: str, label: str, rules: dict[str, str], default: str) -> DataFrame:
    """(label, collection) from a CSV with a header (and perhaps a byte order mark); the collection follows from a prefix."""
    rows = spark.read.option("header", "true").csv(path)
    rows = rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))
    collection = F.lit(default)
    for prefix, name in reversed(rules.items()):
        collection = F.when(F.trim(label).startswith(prefix), name).otherwise(collection)
    return rows.select(F.trim(label).alias("label"), collection.alias("collection")).where("label <> ''").distinct()


def register(spark: SparkSession, name: str, frame: pd.DataFrame | DataFrame) -> DataFrame:
    """A pandas or Spark frame under a name for SQL."""
    df = spark.createDataFrame(frame) if isinstance(frame, pd.DataFrame) else frame
    df.createOrReplaceTempView(name)
    return df


def attach(spark: SparkSession, root: str, names: list[str], prefix: str = "") -> dict[str, DataFrame]:
    """Tables of another database folder as views with a prefix; tables that are not there are left out."""
    out = {}
    for name in names:
        try:
            out[name] = register(spark, f"{prefix}{name}", spark.read.parquet(f"{root}/{name}.parquet"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, position) of the tables."""
    rows = [(t, f.name, f.dataType.simpleString(), k) for t, df in tables.items() for k, f in enumerate(df.schema)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMAS[name]))
