"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A document is a sparse vector: the share of its words that hash to each feature, for words, word pairs, word shapes
(the classes of characters a word holds and its last byte), shape pairs and "same word as before". Its score is the
logistic of a sparse dot product. Labels are the only thing learned from; language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mix, text_chunks, word_hashes

#: Features are hashed to 2**BITS weights, so a model has a fixed size.
BITS = 18
#: At most about so many labelled rows are fitted (a documented bound; all labelled rows below it).
SAMPLE_ROWS = 16_000
#: Models are fitted side by side on disjoint parts of the sample of about so many rows, and averaged.
PART_ROWS = 2_000
#: At least so many updates a model: a small sample is gone through more often.
UPDATES = 8_000
THRESHOLD = 0.7
FAMILIES = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each byte its class, as a bit."""
    kind = np.full(256, 1, np.uint8)
    for bit, chosen in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".,;:", b"#$%&*", b"!?|")):
        kind[list(chosen)] = 2 << bit if bit < 7 else 1
    return kind


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per document, and for each feature family the hashed feature of each word, in text order."""
    n = len(data)
    counts, begin, end, word = word_hashes(data, at)
    if not len(begin):
        return counts, [np.zeros(0, np.int64)] * FAMILIES
    kinds = _kinds()[data]
    shape = np.bitwise_or.reduceat(kinds, np.stack([begin, np.minimum(end, n - 1)], 1).ravel())[::2] if n > 1 else kinds[begin]
    shape = (shape.astype(np.uint64) << np.uint64(8)) | data[end - 1]
    fresh = np.zeros(len(word), bool)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    fresh[starts[counts > 0]] = True
    before = np.r_[np.uint64(0), word[:-1]]
    before[fresh] = 1
    shaped = np.r_[np.uint64(0), shape[:-1]]
    shaped[fresh] = 1
    same = (before == word).astype(np.uint64)
    drop = np.uint64(64 - BITS)
    salts = (np.arange(1, FAMILIES + 1).astype(np.uint64) << np.uint64(40)) * _ODD
    raw = (word, word * _ODD + before, shape, (shape << np.uint64(17)) | shaped, same)
    return counts, [(mix((x + s) * _ODD) >> drop).astype(np.int64) for x, s in zip(raw, salts, strict=True)]


def _documents(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, share of words) of each text."""
    for lo, hi, data, at in text_chunks(texts):
        counts, families = features(data, at)
        cuts = np.r_[0, np.cumsum(counts)]
        for k in range(hi - lo):
            ids, times = np.unique(np.concatenate([f[cuts[k] : cuts[k + 1]] for f in families]), return_counts=True)
            yield ids, times / max(1, counts[k])


def train_part(texts: list[str], labels: np.ndarray, epochs: int | None = None, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates over the texts in the given order."""
    size = (1 << BITS) + 1
    z, g2 = np.zeros(size), np.zeros(size)
    docs = [(np.r_[i, size - 1], np.r_[x, 1.0]) for i, x in _documents(pa.array(texts, pa.string()))]

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    for _ in range(epochs or max(4, -(-UPDATES // max(1, len(docs))))):
        for (i, x), y in zip(docs, labels, strict=True):
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha
            z[i] += g - s * w
            g2[i] += g * g
    return weights(np.arange(size))


def held_out(doc_id):
    """True where crc32 of the doc_id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights learned from labelled documents whose ids are not held out.

    Of the labelled ids a share is taken by hash so that about `sample_rows` are fitted (all, if there are fewer). An id
    labelled twice has its larger label; null labels and ids are ignored. Without labels all weights are 0: score 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    total = known.count()
    share = min(1.0, sample_rows / max(1, total))
    chosen = known.where(F.col("order").bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)))
    # About sample_rows rows of 20 bytes, so the broadcast is bounded by that parameter.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id"])
        w = train_part(part["text"].tolist(), part["quality"].to_numpy(float))
        return pd.DataFrame({"n": [len(part)], "w": [w.astype(np.float32).tobytes()]})

    parts = rows.select(F.pmod(F.shiftright("order", 31), F.lit(max(1, round(min(total, sample_rows) / PART_ROWS)))).alias("part"), "order", "doc_id", "text", "quality").groupBy("part").applyInPandas(fit, "n long, w binary")
    found = parts.collect()  # sample_rows / PART_ROWS rows of 1 MB, whatever the input
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([np.frombuffer(r.w, np.float32) for r in found], axis=0, weights=[r.n for r in found]).astype(np.float32)


def scores(texts: pa.Array, w: np.ndarray) -> np.ndarray:
    """The score of each text."""
    out = np.empty(len(texts))
    for lo, hi, data, at in text_chunks(texts):
        counts, families = features(data, at)
        sums = np.r_[0.0, np.cumsum(sum(w[f] for f in families))]
        cuts = np.r_[0, np.cumsum(counts)]
        total = (sums[cuts[1:]] - sums[cuts[:-1]]) / np.maximum(counts, 1)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(total + w[-1], -35, 35)))
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) per row: the probability of label 1, from the whole text; null and empty texts score by the bias."""
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for ids, texts in batches(rows, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.round(scores(texts, w), 9))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`; repeated rows each get one, equal texts equal scores.

    An empty table gives an empty result; columns besides doc_id, text and quality are ignored, whatever their names.
    """
    scored = score(docs, train(docs, labels, sample_rows))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, as they are, whose text scores at least `threshold`."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in rows:
            if batch.num_rows:
                yield batch.filter(pa.array(np.round(scores(batch.column(batch.schema.get_field_index("text")), w), 9) >= threshold))

    return docs.mapInArrow(run, docs.schema)
