"""Helpers that the training-data operators share: the shared folder, written tables, Arrow text kernels."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own, but only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="censa-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, its lineage cut, and readable after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/censa-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._censa_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    path = getattr(df, "_censa_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of `df` has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string array in runs of about `limit` bytes: (first row, end row, bytes, offsets).

    Nulls are empty texts. `offsets` has one more entry than the run has rows and starts at 0. A text longer than
    `limit` makes a run of its own, so memory follows the longest text, not the batch.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def batches(rows: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Array]]:
    """The named columns of each batch that has rows."""
    for batch in rows:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(n)) for n in names]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))


@lru_cache(1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: is it space; its lower-case value plus 1."""
    space, lower = np.zeros(256, bool), np.arange(1, 257).astype(np.uint64)
    space[[32, *range(9, 14)]] = True
    lower[65:91] += np.uint64(32)
    return space, lower


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, first byte, end byte and 64-bit hash of each lower-cased (A-Z) word) of the texts data[at[k] : at[k + 1]]."""
    space, lower = _bytes()
    n = len(data)
    gap = space[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:n]
    end = ~gap
    end[:-1] &= gap[1:] | first[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(begin, at))
    if not len(begin):
        return counts, begin, end, np.zeros(0, np.uint64)
    powers, inverses = _powers(max(1 << 20, 1 << (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lower[data] * powers[:n], out=sums[1:])
    return counts, begin, end, mix((sums[end] - sums[begin]) * inverses[begin])


def dealt_in_chunks(rows: DataFrame, key: str, tie, limit: int) -> DataFrame:
    """Adds (part, role) to `rows` so that all rows of a key meet pairwise, in parts of about 2 * `limit` rows at most.

    A key of at most `limit` rows is one part, role 3. A larger one is cut into chunks by the hash `tie`, and each pair of
    chunks is a part: roles 1 and 2 meet each other, and in the part of a chunk with itself (role 3) all rows meet.
    """
    crowds = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    crowds = written(crowds.select(F.col(key).alias("_key"), F.ceil(F.col("_rows") / limit).cast("int").alias("_chunks")), "crowds")
    other = F.transform(
        F.sequence(F.lit(0), F.col("_chunks") - 1),
        lambda x: F.struct(
            (F.least(F.col("_own"), x) * F.col("_chunks") + F.greatest(F.col("_own"), x)).alias("part"),
            F.when(x == F.col("_own"), 3).when(F.col("_own") < x, 1).otherwise(2).alias("role"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(3).alias("role")))
    dealt = rows.join(crowds, rows[key] == crowds._key, "left").withColumn("_own", F.pmod(tie, F.col("_chunks")).cast("int"))
    return dealt.select(*rows.columns, F.explode(F.when(F.col("_chunks").isNull(), whole).otherwise(other)).alias("_x")).select(*rows.columns, "_x.part", "_x.role")


def whole_parts(rows: Iterator[pa.RecordBatch], key: str, part: str, *names: str) -> Iterator[list[np.ndarray]]:
    """The columns as arrays, in runs that hold complete (key, part) groups; rows come sorted by them."""
    held = None
    for cols in batches(rows, key, part, *names):
        now = [c.to_numpy(zero_copy_only=False) for c in cols]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        before = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(before[-1]) + 1 if len(before) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None:
        yield held
