"""The corpus pipeline: quality classifier, SimHash near-dedup, secret scans, mixing, best-fit packing.

Each stage takes the documents that its predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from censa.llm import common, mixing, near_duplicates, packing, quality, secret_scan


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    Null and empty texts are scored by the bias, like texts of no words. Repeated rows are scored alike and rows without doc_id
    like any other; columns are kept, whatever their names. An empty table stays empty.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, 0.8 or more, directly or through others).

    The smallest doc_id stays, rows without doc_id last, ties by a hash of the text; rows that repeat an id with another text
    are documents of their own. Null, empty and wordless texts are one group. An empty table stays empty.
    """
    own, h, k = common.fresh(docs, "_own", "_h", "_k")
    gone, repeated = (df.toDF(own, h) for df in near_duplicates.surplus(docs))
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (text_hash == F.col(h))
    left = docs.join(gone.unionByName(repeated).hint("merge"), same, "left_anti")
    # Of rows that repeat both id and text (few, as a rule) one is left.
    again = docs.join(repeated.hint("merge"), same, "left_semi").join(gone.hint("merge"), same, "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy(F.xxhash64("source", "lang")))
    return left.unionByName(again.withColumn(k, first).where(F.col(k) == 1).drop(k))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the values of secrets by a mark, and counts n_chars of those rows anew.

    Null and empty texts stay as they are, rows and other columns too. An empty table stays empty.
    """
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets.

    Null is a source of its own; documents without words are never needed but follow the running sum like others. Rows
    that repeat an id are told apart by source and text, equal rows by number. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of the documents in bins; copies that the mix made never share a bin.

    Texts without words (null, empty) have one piece of size 0. An empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Training and SimHash shards are not expressible in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents. Nulls, empty tables, repeats and further columns: as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
