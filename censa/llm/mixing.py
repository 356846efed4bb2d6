"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected target / source_size times. Documents stand in a fixed order; the running sum of
expected copies, moved by one random offset of the source, crosses an integer for each copy that is emitted. Within a
source the order goes by size class, then by a hash, then by size, so that copies spread evenly over short and long
documents and the words taken stay near the target.

The running sum needs no task that holds a whole source: a document's place is the number of documents in earlier cells
(source, size class, hash slice), summed in two levels, plus its place in its cell. The number of slices grows with the
table, so a cell keeps about the same number of rows at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, word_count, written

LARGEST_REPEAT = 3
#: Of the hash of a document's id: 32 bits.
_HASH = "conv(substr(md5(coalesce(cast(doc_id as string), '')), 1, 8), 16, 10)"


def _targets(sources: DataFrame, largest: int) -> DataFrame:
    """Adds `target`: min(largest * source_size, level * weight), the level chosen so that targets add up to all sizes."""
    w = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    sources = sources.withColumn("weight", (F.row_number().over(w) - 1) % 3 + 1)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - largest * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sources = sources.withColumn("try", left.cast("double") / F.sum("weight").over(after))
    # Capping a source below the level raises what is left for a unit of weight, capping one above it lowers it.
    sources = sources.withColumn("level", F.max("try").over(everything))
    capped = (largest * F.col("source_size")).cast("double")
    return sources.withColumn("target", F.least(capped, F.col("level") * F.col("weight")))


def _text_hash(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def mix(docs: DataFrame, seed: str = "mix", largest: int = LARGEST_REPEAT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of `docs`.

    size counts the words of the text (null: 0); taken is copies * size, copies at most `largest`. Sources weigh 1, 2, 3,
    repeating, by code point, null last (a source of its own), and share 100 % of all sizes. Sources without words have
    target 0 and no copies. Rows that repeat a doc_id are documents of their own; null ids are allowed. An empty table
    gives an empty result; further columns are ignored. The same table gives the same copies on every run.
    """
    return _mixed(docs, seed, largest).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mixed(docs: DataFrame, seed: str, largest: int) -> DataFrame:
    """(doc_id, source, h, number, size, source_size, target, copies) per row: h a hash of the text, number that of the row among equal ones, from 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), _text_hash(F.col("text")).alias("h"))
    binary = F.bin("size")
    rows = rows.select("*", F.expr(_HASH).cast("long").alias("hash"), F.concat(F.lpad(F.length(binary), 2, "0"), F.substring(binary, 1, 3)).alias("size_class"))
    # Equal rows (null ids, repeated rows) are counted, so that no slice is crowded by one id. Texts are read once.
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows")), "sizes")
    total = rows.agg(F.sum("rows")).first()[0] or 0
    slices = 16 * max(1, -(-total // 500_000))
    rows = rows.withColumn("slice", F.col("hash") % slices)
    cell = ["source", "size_class", "slice"]
    cells = written(rows.groupBy(*cell).agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("size")).alias("words")), "cells")
    # Prefix sums in two levels: over the size classes of a source (a few dozen), and over the slices of a size class.
    classes = cells.groupBy("source", "size_class").agg(F.sum("n").alias("rows"), F.sum("words").alias("words"))
    classes = written(classes.withColumn("before", F.sum("rows").over(Window.partitionBy("source").orderBy("size_class")) - F.col("rows")), "classes")
    sources = _targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), largest)
    sources = sources.select(F.col("source").alias("s"), "source_size", "target", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))), 1, 5), 16, 10).cast("double") / (1 << 20)).alias("offset"))
    classes = classes.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("size_class").alias("c"), "before", "source_size", "target", "offset")
    cells = cells.withColumn("ahead", F.sum("n").over(Window.partitionBy("source", "size_class").orderBy("slice")) - F.col("n"))
    cells = cells.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size_class") == F.col("c")))
    # The cell's facts join a table of plain rows, so a crowded cell can be split; places within a cell follow.
    cells = written(cells.select("s", "c", F.col("slice").alias("l"), (F.col("before") + F.col("ahead")).alias("ahead"), "source_size", "target", "offset"), "shares")
    order = Window.partitionBy(*cell).orderBy("size", "hash", "doc_id", "h")
    rows = rows.withColumn("inside", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows"))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("size_class") == F.col("c")) & (F.col("slice") == F.col("l")))
    # Two steps, so that no row holds a list as long as its count.
    rows = rows.withColumn("step", F.ceil(F.sqrt("rows")).cast("long")).withColumn("begin", F.explode(F.expr("sequence(0L, rows - 1, step)")))
    rows = rows.withColumn("number", F.explode(F.expr("sequence(begin, least(rows, begin + step) - 1)")))
    rows = rows.withColumn("place", F.col("inside") + F.col("number") + 1)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(k * each + F.col("offset"))
    at = F.col("ahead") + F.col("place")
    copies = F.least(F.lit(largest).cast("long"), upto(at) - upto(at - 1))
    return rows.select("doc_id", "source", "h", "number", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, seed: str = "mix", largest: int = LARGEST_REPEAT) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    Rows that share a doc_id are told apart by source and a hash of the text, so reruns repeat the same rows. Nulls, empty
    tables and clashing columns as in `mix`.
    """
    row, own, src, h, k, times, copy = fresh(docs, "_row", "_own", "_source", "_h", "_k", "_times", "_copy")
    copies = _mixed(docs, seed, largest).where("copies > 0").select(F.col("doc_id").alias(own), F.col("source").alias(src), F.col("h").alias(h), F.col("number").alias(k), F.col("copies").alias(times))
    key = (F.col("doc_id").cast("long"), F.col("source").cast("string"), _text_hash(F.col("text")))
    rows = docs.withColumn(row, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1)
    # A merge join by choice: the copies grow with the documents, so they are never broadcast, at any size.
    rows = rows.join(copies.hint("merge"), key[0].eqNullSafe(F.col(own)) & key[1].eqNullSafe(F.col(src)) & (key[2] == F.col(h)) & (F.col(row) == F.col(k)))
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(copy)).drop(copy)


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash
  FROM documents),
slices AS (SELECT 16 * greatest(1, CAST(ceil(count(*) / 500000.0) AS BIGINT)) AS n FROM rows),
placed AS (
  SELECT rows.*, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 3) AS size_class, hash % slices.n AS slice
  FROM rows, slices),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, slice, size, hash, doc_id) AS place FROM placed),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight
  FROM rows GROUP BY source),
tries AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try
  FROM sources),
level AS (SELECT max(try) AS level FROM tries),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce('=' || source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u
  FROM tries, level),
rated AS (
  SELECT ordered.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS r
  FROM ordered JOIN targets ON ordered.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, size * CAST(least(3, floor(place * r + u) - floor((place - 1) * r + u)) AS BIGINT) AS taken
FROM rated
"""
