"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_digest, centroid_clusters, chat, embedding_dedup, fill_in_middle, html_text, mixing, packing, quality, secret_scan, simhash, vantage_trees, warc
from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored and classed; odd rows as `quality.classify` says."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likenesses; odd rows as `byte_digest.digests` says."""
    return byte_digest.digests(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; odd rows as `simhash.simhash_components` says."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; odd rows as `html_text.extract` says."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; odd rows as `secret_scan.scan` says."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back; odd rows as `chat.format_conversations` says."""
    own = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_conversations(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; odd rows as `warc.round_trip` says."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; odd rows as `embedding_dedup.embedding_duplicates` says."""
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins; odd rows as `packing.pack` says."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets; odd rows as `mixing.mix` says."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows to each row whose vec_id is divisible by 100; rows as the operator says."""
    return vantage_trees.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds of delta Lloyd; rows as the operator says."""
    return centroid_clusters.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut by code points, with digests of the output and of the text rebuilt from it; rows as the operator says."""
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_document_fingerprints,
        op3_simhash_dedup,
        op4_html_extraction,
        op5_secret_scan,
        op6_chat_formatting,
        op7_warc,
        op8_embedding_dedup,
        op9_best_fit_packing,
        op10_source_mixing,
        op11_nearest_neighbours,
        op12_centroid_clusters,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {"op6_chat_formatting": chat.SQL, "op7_warc": warc.SQL, "op10_source_mixing": mixing.SQL, "op11_nearest_neighbours": vantage_trees.SQL, "op12_centroid_clusters": centroid_clusters.SQL, "op13_fill_in_middle": fill_in_middle.SQL}
