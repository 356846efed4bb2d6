"""Best-fit packing of documents into fixed-size sequences, with conflicts.

A document longer than a bin is cut into full bins and a rest; the rests and the short documents are packed, largest
first. Open bins are kept ordered by residual, each with bitmaps of its sources and of its duplicate clusters. A piece
goes to the bin with the least residual that still holds it; while that bin conflicts, the search moves to the
successor, and a new bin is opened only when no open bin is compatible.

Packing is sequential by nature, so documents are dealt by hash into shards of about `shard_rows` pieces and each shard
is packed on its own; hot sources and clusters spread over all shards. More data makes more shards, not larger ones.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count, written

CAPACITY = 4096
PER_SOURCE = 2
SHARD_ROWS = 4096


class BestFit:
    """Open bins of one shard; `add` returns the bin number of a piece."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[list[int]] = []  # of each bin: for each k, a bitmap of the sources held more than k times
        self.clusters: list[int] = []
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}

    def add(self, size: int, source, cluster) -> int:
        s = 1 << self.source_bit.setdefault(source, len(self.source_bit))
        c = 0 if cluster is None else 1 << self.cluster_bit.setdefault(cluster, len(self.cluster_bit))
        k = bisect_left(self.order, (size, -1))
        while k < len(self.order):
            number = self.order[k][1]
            if not self.clusters[number] & c and not self.sources[number][-1] & s:
                residual = self.order.pop(k)[0]
                break
            k += 1
        else:
            number, residual = len(self.clusters), self.capacity
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        self.clusters[number] |= c
        levels = self.sources[number]
        for j in range(self.per_source):
            if not levels[j] & s:
                levels[j] |= s
                break
        if residual > size:
            insort(self.order, (residual - size, number))
        return number


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_word, size, source, cluster, bin_id) per piece; the pieces of a row cover its words once.

    size counts words. A bin holds at most `capacity` words, at most `per_source` pieces of a source (null is a source of
    its own) and no two pieces of one duplicate cluster; clusters are equal texts (null: empty), so copies of a document
    and pieces of one document never share a bin. Texts without words have one piece of size 0. Repeated rows and null
    ids are packed like any other; an empty table gives an empty result; further columns are ignored. The bins are the
    same however the rows are partitioned.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("words"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("cluster"),
    )
    full = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / capacity).cast("int")
    pieces = rows.select(
        "*",
        F.explode(F.sequence(F.lit(0), full)).alias("piece"),
    ).withColumn("first_word", F.col("piece").cast("long") * capacity)
    pieces = pieces.withColumn("size", F.least(F.col("words") - F.col("first_word"), F.lit(capacity).cast("long"))).drop("words")
    # Equal rows are counted and made anew with numbers, so that bins do not depend on how the input is partitioned.
    own = ["doc_id", "source", "cluster", "piece", "first_word", "size"]
    pieces = written(pieces.groupBy(*own).agg(F.count(F.lit(1)).alias("rows")), "pieces")
    total = pieces.agg(F.sum("rows")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    # Two steps, so that no row holds a list as long as its count.
    step = F.ceil(F.sqrt("rows")).cast("long")
    dealt = pieces.withColumn("step", step).withColumn("begin", F.explode(F.expr("sequence(0L, rows - 1, step)")))
    dealt = dealt.withColumn("number", F.explode(F.expr("sequence(begin, least(rows, begin + step) - 1)")))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "piece", "number"), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "piece", "source", "cluster", "number")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, None
        for batch in batches_in:
            if not batch.num_rows:
                continue
            numbers = []
            for at, size, source, cluster in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "size", "source", "cluster")), strict=True):
                if at != shard:
                    shard, packer = at, BestFit(capacity, per_source)
                numbers.append((at << 32) + packer.add(size, source, cluster))
            names = ("doc_id", "piece", "first_word", "size", "source", "cluster")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(numbers, pa.int64())], [*names, "bin_id"])

    return dealt.mapInArrow(run, "doc_id long, piece int, first_word long, size long, source string, cluster long, bin_id long")
