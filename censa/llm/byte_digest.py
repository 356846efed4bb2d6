"""Document fingerprints: digests of statistically improbable byte windows.

Every byte window of a text has an entropy; windows are ranked by how rare their entropy is in the corpus, the rarest
first. A window is selected when it ranks first in at least `popularity` of the neighbourhoods that hold it (ties to the
left), and so is the first-ranked one of each stretch that holds none, as in text that repeats itself. The selected windows are hashed into a chain of Bloom filters, each with room for `per_filter` windows, in text
order. Two digests are compared by the overlap of set bits beyond what chance gives, filter by filter.

Short texts also contribute every window of fewer bytes (SHORT), since few or no full windows fit.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_chunks

WINDOW = 16
NEIGHBOURHOOD = 64
POPULARITY = 16
PER_FILTER = 128
FILTER_BITS = 2048
HASHES = 5
#: (texts of fewer bytes, window)
SHORT = ((256, 4), (32, 2), (2, 1))
#: Entropies are kept as whole multiples of a hundredth of a bit, times the window length.
CLASSES = 1 + WINDOW * 400
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _steps() -> np.ndarray:
    """n log n - (n - 1) log (n - 1), in hundredths of a bit, for n = 0 ... WINDOW."""
    n = np.arange(WINDOW + 1, dtype=float)
    f = np.where(n > 1, n * np.log2(np.maximum(n, 1)), 0)
    return np.r_[0, np.diff(np.round(100 * f))].astype(np.int32)


def entropies(data: np.ndarray) -> np.ndarray:
    """WINDOW times the entropy of each window, in hundredths of a bit; the windows are those of the whole buffer."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int32)
    # Of each byte: how many of the WINDOW - 1 bytes after it, and before it, equal it.
    after, before = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = data[d:] == data[:-d]
        after[:-d] += same
        before[d:] += same
    step = _steps()
    # The first window's sum, then what the byte that leaves takes away and the byte that enters adds.
    counts = np.bincount(data[:WINDOW])
    total = np.r_[0, np.cumsum(step[1:])][counts].sum()
    change = np.zeros(n, np.int32)
    change[1:] = step[before[WINDOW:]] - step[after[: n - 1]]
    change[0] = total
    full = int(round(100 * WINDOW * np.log2(WINDOW)))
    return full - np.cumsum(change, dtype=np.int32)


def _selected(e: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of the selected windows of a text with these entropies."""
    n = len(e)
    if n < 1:
        return np.zeros(0, np.int64)
    shift = np.int64(max(1, (n - 1).bit_length()))
    least, width, span = (ranks[e] << shift) | np.arange(n), 1, min(NEIGHBOURHOOD, n)
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n - span + 1], least[span - width :])
    place = least & ((np.int64(1) << shift) - 1)
    ends = np.flatnonzero(np.r_[place[1:] != place[:-1], True])
    runs = np.diff(np.r_[-1, ends])
    chosen = place[ends[runs >= min(POPULARITY, n - span + 1)]]
    bare = np.ones(-(-n // NEIGHBOURHOOD), bool)
    bare[chosen // NEIGHBOURHOOD] = False
    some = place[np.minimum(np.flatnonzero(bare) * NEIGHBOURHOOD, len(place) - 1)]
    return np.union1d(chosen, some)


def _hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    h = np.full(len(at), np.uint64(width), np.uint64)
    for k in range(width):
        h = (h ^ data[at + k]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Of each text its chain of Bloom filters, as rows of packed bits; a text without windows has one empty filter."""
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 18):
            size += len(texts[hi])
            hi += 1
        out += _fingerprints(texts[lo:hi], ranks)
        lo = hi
    return out


def _fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    e = entropies(data)
    keys, owner, order = [], [], []
    full = [starts[k] + _selected(e[starts[k] : max(starts[k], starts[k] + sizes[k] - WINDOW + 1)], ranks) for k in range(len(texts))]
    at = np.concatenate(full)
    keys.append(_hashes(data, at, WINDOW)), owner.append(np.repeat(np.arange(len(texts)), [len(x) for x in full])), order.append(at)
    for below, width in SHORT:
        some = [k for k in range(len(texts)) if width <= sizes[k] < below]
        if some:
            each = [np.arange(starts[k], starts[k] + sizes[k] - width + 1) for k in some]
            at = np.concatenate(each)
            keys.append(_hashes(data, at, width)), owner.append(np.repeat(some, [len(x) for x in each])), order.append(at)
    keys, owner, order = np.concatenate(keys), np.concatenate(owner), np.concatenate(order)
    sort = np.lexsort((order, owner))
    keys, owner = keys[sort], owner[sort]
    _, first = np.unique(keys ^ (owner.astype(np.uint64) * _ODD), return_index=True)
    first.sort()
    keys, owner = keys[first], owner[first]
    counts = np.bincount(owner, minlength=len(texts))
    lengths = np.maximum(1, -(-counts // PER_FILTER))
    base = np.cumsum(lengths) - lengths
    row = base[owner] + (np.arange(len(keys)) - (np.cumsum(counts) - counts)[owner]) // PER_FILTER
    filters = np.zeros((lengths.sum(), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        filters[row, ((keys >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.split(np.packbits(filters, axis=1), base[1:])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean, over the filters of the shorter chain, of the best bit overlap with a filter of the other, beyond chance."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    if not x.sum() or not y.sum():
        return float(x.sum() == y.sum())
    best = np.zeros(len(a))
    for k, row in enumerate(a):
        both = np.bitwise_count(row & b).sum(1)
        chance, most = x[k] * y / FILTER_BITS, np.minimum(x[k], y)
        best[k] = (np.maximum(both - chance, 0) / np.maximum(most - chance, 1e-9))[most > 0].max(initial=0.0)
    return float(min(1.0, np.average(best, weights=np.maximum(x, 1e-9))))


def encode(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy, the rarest first, from the windows of all texts: the tasks send counts of CLASSES numbers, summed in Spark."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for (texts,) in batches(rows, "text"):
            for _, _, data, at in text_chunks(texts):
                e = entropies(data)
                inside = np.ones(len(e), bool)
                for cut in at[1:-1]:
                    inside[max(0, cut - WINDOW + 1) : cut] = False
                total += np.bincount(e[inside], minlength=CLASSES)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["entropy", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES, np.int64)
    for entropy, n in found.collect():  # at most CLASSES rows
        counts[entropy] = n
    order = np.lexsort((np.arange(CLASSES), counts))
    ranks = np.empty(CLASSES, np.int64)
    ranks[order] = np.arange(CLASSES)
    return ranks


def _with_next(docs: DataFrame, rows_each: int) -> DataFrame:
    """(bucket, copy, doc_id, text), sorted within partitions so that each row is followed by its next document.

    Documents are dealt into ranges of (doc_id, hash of the text); the first document of a range is also sent, as a copy, to the end
    of the range before it, and the very first to the last range. The ranges are those into which Spark sorts the ids
    alone, so whole texts are shuffled once. What reaches the driver and the tasks is the head of each range: 16 bytes
    for `rows_each` documents.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("tie"))
    ids = rows.select("key", "tie")
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // rows_each))
    found = ids.repartitionByRange(ranges, "key", "tie").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = np.array(sorted((r.head.key, r.head.tie) for r in found.collect()), np.dtype([("key", np.int64), ("tie", np.int64)]))
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def places(key: pd.Series, tie: pd.Series) -> pd.Series:
        """The range of each row, twice that number and one more where the row is the head of its range."""
        heads = shared.value
        own = np.empty(len(key), heads.dtype)
        own["key"], own["tie"] = key.to_numpy(), tie.to_numpy()
        at = np.searchsorted(heads, own, "right") - 1
        return pd.Series(2 * at + (heads[at] == own))

    place = F.pandas_udf(places, "long")
    dealt = rows.withColumn("place", place("key", "tie"))
    bucket, n = F.shiftright("place", 1), max(1, len(heads))
    sent = F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("copy")), F.when(F.col("place") % 2 == 1, F.struct(F.pmod(bucket - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("copy"))))
    dealt = dealt.select(F.explode(F.array_compact(sent)).alias("p"), "key", "tie", "doc_id", "text").select("p.bucket", "p.copy", "key", "tie", "doc_id", "text")
    return dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "copy", "key", "tie")


def digests(docs: DataFrame, ranks: np.ndarray | None = None, rows_each: int = 20_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of `docs`.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document, by ascending doc_id (null ids first, equal ids by a hash of the text; after the last: the first; a sole
    document follows itself). Null texts are empty. Two empty texts are alike (1), an empty and another are not (0). An
    empty table gives an empty result; further columns are ignored. `ranks` may hold the ranks of another corpus.
    """
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(rarity(docs) if ranks is None else ranks)  # CLASSES numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, held = model.value, []
        schema = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

        def solve(rows):
            """Results of all rows but the last."""
            own = [x for x in range(len(rows) - 1) if not rows[x][1]]
            texts = [r[3] for r in rows]
            edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
            raw = [t.encode() for t in edited]
            plain, changed = fingerprints([t.encode() for t in texts], ranks), fingerprints(raw, ranks)
            out = [(rows[k][2], len(texts[k]), hashlib.sha256(raw[j]).hexdigest(), encode(plain[k]), encode(changed[j]), likeness(plain[k], changed[j]), likeness(plain[k], plain[k + 1])) for j, k in enumerate(own)]
            cols = list(zip(*out, strict=True)) or [[]] * len(schema)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema)

        for bucket, copy, ids, texts in batches(rows, "bucket", "copy", "doc_id", "text"):
            for lo in range(0, len(ids), 256):
                held += zip(*(c.slice(lo, 256).to_pylist() for c in (bucket, copy, ids, texts)), strict=True)
                yield solve(held)
                held = held[-1:]

    return _with_next(docs, rows_each).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
