"""Near-duplicate texts: SimHash fingerprints in BK-trees first, then every other pair that the similarity allows.

Two texts are near-duplicates when the Jaccard overlap of their sets of word shingles (five words) is `similarity` or more.
SimHash alone cannot find all of them: at 0.8 two 64-bit fingerprints differ by some 8 bits, and at that radius shards
that lose nothing are too large. So links come in two rounds, and each is verified on the whole sets:

1. Fingerprints within `radius` bits, by the BK-trees of `simhash.links`, and each text with the hub of a token: of the
   texts whose prefix has it that with the largest share of tokens it has in common with others, so a text from
   which copies were made. These are about as many as there are tokens, whatever the size of the groups.
2. Pairs that share enough tokens of both prefixes and are not in one group after the first round. Where so many bits
   differ between the parities of two sets (the number of shingles of each of PARITY_BITS classes, odd or even)
   that they cannot be similar, the pair is not even proposed.

The prefix of a set of n shingles is its first n - ceil(similarity * n) + 1 in an order that all sets share. Two sets of n
and m that are similar have at least a = ceil((n + m) * similarity / (1 + similarity)) shingles in common, of which at least
1 + a - ceil(similarity * max(n, m)) are in both prefixes, so nothing is lost. The order puts frequent shingles last.
Frequencies are counted over all texts in a table of fixed size; they only order tokens, so its collisions cost time,
never links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, dealt_in_chunks, discard, mix, text_chunks, whole_parts, word_hashes, written
from .components import connected_components
from .simhash import fingerprint_bytes, links

WORDS = 5
SIMILARITY = 0.8
#: Shingles are counted in 2**SKETCH_BITS classes of hashes.
SKETCH_BITS = 17
#: Bits of the parities of a set.
PARITY_BITS = 1024
#: Rows of one token that are compared in one task; more are dealt into chunks, and each pair of chunks is a task.
TOKEN_ROWS = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Of each text its distinct shingles as sorted 64-bit hashes; a text of fewer words has one shingle, or none."""
    counts, _, _, word = word_hashes(data, at)
    ends = np.cumsum(counts)

    def joined(first: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(first), np.uint64(length), np.uint64)
        for k in range(length):
            h = mix(h * _ODD + word[first + k])
        return h

    whole = joined(np.arange(max(0, len(word) - words + 1)), words)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(whole[end - n : end - words + 1]))
        else:
            out.append(joined(np.array([end - n]), n) if n else np.zeros(0, np.uint64))
    return out


def set_hash(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles, whatever its order; 0 for the empty one."""
    return int(mix(np.add.reduce(tokens * _ODD ^ (tokens >> np.uint64(29)), dtype=np.uint64)[None] + np.uint64(len(tokens)))[0]) if len(tokens) else 0


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h) per row; h is a hash of the text, equal for null and empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def parities(tokens: np.ndarray) -> bytes:
    """A bit for each class of shingles: whether their number is odd. Sets differ in at least as many shingles as their parities in bits."""
    counts = np.bincount((tokens & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h, cls, n, fp, parity) per row: the hash of the text, that, the size and the parities of its set of shingles, and its SimHash."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hs, texts in batches(rows, "doc_id", "h", "text"):
            cls, fp, n, parity = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int32), []
            for lo, hi, data, at in text_chunks(texts):
                raw, sets = data.tobytes(), shingle_sets(data, at, words)
                cls[lo:hi], n[lo:hi] = [set_hash(s) for s in sets], [len(s) for s in sets]
                parity += [parities(s) for s in sets]
                fp[lo:hi] = [fingerprint_bytes(raw[at[k] : at[k + 1]]) for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([ids, hs, pa.array(cls.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), pa.array(parity, pa.binary())], ["doc_id", "h", "cls", "n", "fp", "parity"])

    return _texts(docs).mapInArrow(run, "doc_id long, h long, cls long, n int, fp long, parity binary")


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Of each class of hashes how far it exceeds the average: 0 up to a quarter above it, then four steps for each doubling."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for (texts,) in batches(rows, "text"):
            for _, _, data, at in text_chunks(texts):
                sets = shingle_sets(data, at, words)
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = written(found, "frequent")  # at most 2**SKETCH_BITS rows
    steps = np.zeros(1 << SKETCH_BITS, np.uint8)
    average = (found.agg(F.sum("n")).first()[0] or 0) / (1 << SKETCH_BITS)
    for bucket, n in found.where(F.col("n") > 1.25 * average + 1).collect():
        steps[bucket] = min(255, int(4 * np.log2(n / average)))
    discard(found)
    return steps


def _prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(token, cls): the tokens of the prefix of each set."""
    order = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))  # 2**SKETCH_BITS bytes

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = order.value
        for (texts,) in batches(rows, "text"):
            for _, _, data, at in text_chunks(texts, 4 << 20):
                sets = {set_hash(s): s for s in shingle_sets(data, at, words) if len(s)}
                if not sets:
                    continue
                some = []
                for s in sets.values():
                    late = steps[s >> np.uint64(64 - SKETCH_BITS)]
                    # Sets are sorted by hash, so a stable sort by step gives the order of all.
                    some.append((s[np.argsort(late, kind="stable")] if late.any() else s)[: prefix_length(len(s), similarity)])
                cls = np.repeat(np.fromiter(sets, np.uint64, len(sets)), [len(x) for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64)), pa.array(cls.view(np.int64))], ["token", "cls"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, cls long")


def _shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, cls) of the tokens of several sets; rows come sorted and pass by."""
    token, last_set, waiting = None, 0, False  # of the last token; waiting: it has one set so far, which is not out
    for tokens, sets in batches(rows, "token", "cls"):
        t, c = np.asarray(tokens), np.asarray(sets)
        if token is not None:
            t, c = np.r_[token, t], np.r_[last_set, c]
        fresh = np.r_[True, t[1:] != t[:-1]]
        keep = fresh | np.r_[True, c[1:] != c[:-1]]
        t, c, group = t[keep], c[keep], np.cumsum(fresh[keep]) - 1
        size = np.bincount(group)
        out = size[group] > 1
        if token is not None:
            out[0] = out[0] and waiting
        yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(c[out])], ["token", "cls"])
        waiting = bool(size[-1] == 1 and (waiting or token is None or len(size) > 1))
        token, last_set = t[-1], c[-1]


def _enough(n, m, similarity: float):
    """How many tokens the prefixes of similar sets of n and m shingles share at least; null where the sizes differ too much."""
    ratio = similarity / (1 + similarity)
    need = 1 + F.ceil(ratio * (n + m) - 1e-6) - F.ceil(similarity * F.greatest(n, m) - 1e-9)
    return F.when(F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6, need)


def _pairs_apart(similarity: float):
    """(a, n, b, m, tokens): pairs of sets of different groups and possible sizes, with the number of tokens of this run that they share."""

    ratio = similarity / (1 + similarity)

    def solve(key, part, role, cls, n, apart, parity):
        last = np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (part[1:] != part[:-1]), True])
        end = last[np.searchsorted(last, np.arange(len(key)))] + 1
        bits = np.frombuffer(b"".join(parity), np.uint64).reshape(len(key), -1)
        here, step = np.arange(len(key)), 1
        found = []
        while len(here := here[here + step < end[here]]):
            there = here + step
            x, y = n[here], n[there]
            ok = (apart[here] != apart[there]) & ((role[here] == 3) | (role[here] != role[there])) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
            i, j = here[ok], there[ok]
            both = n[i].astype(np.int64) + n[j]
            ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= both - 2 * np.ceil(ratio * both - 1e-6)
            i, j = i[ok], j[ok]
            swap = cls[i] > cls[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            found.append(np.stack([cls[i], n[i].astype(np.int64), cls[j], n[j].astype(np.int64)], 1))
            step += 1
        return np.unique(np.concatenate(found) if found else np.zeros((0, 4), np.int64), axis=0, return_counts=True)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_parts(rows, "token", "part", "role", "cls", "n", "apart", "parity"):
            pairs, tokens = solve(*cols)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in pairs.T), pa.array(tokens)], ["a", "n", "b", "m", "tokens"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, ends: DataFrame, words: int) -> DataFrame:
    """(cls, shingles) of the classes of `ends`, each from one of its texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, texts in batches(rows, "cls", "text"):
            out = [s.view(np.int64) for _, _, data, at in text_chunks(texts) for s in shingle_sets(data, at, words)]
            yield pa.RecordBatch.from_arrays([cls, pa.array(out, pa.list_(pa.int64()))], ["cls", "shingles"])

    # Merge joins by choice: the classes grow with the documents, so they are never broadcast, at any size.
    one = classes.join(ends.hint("merge"), "cls", "left_semi").select("cls", F.col("one.doc_id").alias("id"), F.col("one.h").alias("hash"))
    texts = _texts(docs).join(one.hint("merge"), (F.col("h") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return written(texts.select("cls", "text").mapInArrow(run, "cls long, shingles array<long>"), "sets")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose sets are similar. Rows that repeat a text and its id give a set twice, so the pairs may repeat."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets_of(docs, classes, ends, words)
    left, right = sets.toDF("a", "x").hint("merge"), sets.toDF("b", "y").hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    out = written(pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b"), "good")
    discard(sets)
    return out


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = 3, blocks: int = 5, token_rows: int = TOKEN_ROWS) -> DataFrame:
    """(doc_id, h, cls, component) per row of `docs`: rows of one component are near-duplicates, directly or through others.

    h is a hash of the text. Texts with the same set of shingles, among them equal ones, are of one cls, whatever their number, and so
    are all wordless and null texts. Null ids and rows that repeat an id are rows like any other. An empty table gives
    an empty result; further columns are ignored.
    """
    prints = written(_prints(docs, words), "prints")
    classes = written(prints.groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("parity").alias("parity")), "classes")
    # First round.
    codes = written(classes.groupBy("fp").agg(F.min("cls").alias("rep")), "codes")
    near = links(codes, radius, blocks).unionByName(classes.join(codes.hint("merge"), "fp").where("cls <> rep").select(F.col("cls").alias("a"), F.col("rep").alias("b")))
    prefixes = _prefixes(docs, words, similarity).repartition("token").sortWithinPartitions("token", "cls")
    shared = written(prefixes.mapInArrow(_shared, "token long, cls long"), "shared")
    # Of each set how much of its prefix it shares; the hub of a token has the largest share.
    length = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    shares = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).join(classes.select("cls", "n").hint("merge"), "cls").select("cls", "n", (F.col("k") / length).alias("share"))
    shared = written(shared.join(shares.hint("merge"), "cls"), "shares")
    hubs = shared.groupBy("token").agg(F.max(F.struct("share", "cls", "n")).alias("hub")).select(F.col("token").alias("t"), F.col("hub.cls").alias("b"), F.col("hub.n").alias("m"))
    stars = shared.join(hubs.hint("merge"), F.col("token") == F.col("t")).where("cls <> b").groupBy(F.col("cls").alias("a"), "b").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.count(F.lit(1)).alias("tokens"))
    stars = stars.where(F.col("tokens") >= _enough(F.col("n"), F.col("m"), similarity)).select("a", "b")
    tried = written(near.unionByName(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    good = _verified(docs, classes, tried, words, similarity)
    # Second round.
    groups = written(connected_components(good), "groups")
    rows = shared.join(groups.hint("merge"), shared.cls == groups.id, "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("apart"))
    rows = written(rows, "apart")
    several = rows.groupBy("token").agg(F.min("apart").alias("low"), F.max("apart").alias("high")).where("low <> high").select(F.col("token").alias("t"))
    crowded = rows.join(several.hint("merge"), F.col("token") == F.col("t"), "left_semi").join(classes.select("cls", "parity").hint("merge"), "cls")
    dealt = dealt_in_chunks(crowded, "token", F.xxhash64("cls"), token_rows).repartition("token", "part").sortWithinPartitions("token", "part")
    pairs = dealt.select("token", "part", "role", "cls", "n", "apart", "parity").mapInArrow(_pairs_apart(similarity), "a long, n long, b long, m long, tokens long")
    pairs = pairs.groupBy("a", "b").agg(F.min("n").alias("n"), F.min("m").alias("m"), F.sum("tokens").alias("tokens"))
    rest = pairs.where(F.col("tokens") >= _enough(F.col("n"), F.col("m"), similarity)).select("a", "b")
    rest = written(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"), "rest")
    more = _verified(docs, classes, rest, words, similarity)
    found = written(connected_components(good.unionByName(more)), "components")
    for old in (classes, codes, shared, tried, groups, rows, rest, good, more):
        discard(old)
    return prints.drop("n", "fp", "parity").join(found.hint("merge"), prints.cls == found.id, "left").select("doc_id", "h", "cls", F.coalesce("component", "cls").alias("component"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, component_id) per doc_id: the smallest doc_id of its group. Rows without id are left out; an id with several texts is in the group of each, and has a row for each."""
    rows = written(near_duplicate_classes(docs, **settings).where("doc_id IS NOT NULL"), "classed")
    first = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(first.hint("merge"), "component").select("doc_id", "component_id").distinct()


def surplus(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """What to drop so that one row of each group is left: ((doc_id, h) of rows that go, (doc_id, h) that several rows share).

    The row with the smallest doc_id stays, rows without id last, ties by a hash of the text. Of rows that share doc_id
    and text one may stay, if they are not among those that go.
    """
    rows = written(near_duplicate_classes(docs, **settings), "classed")
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "h")
    best = rows.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("component").alias("c"), "best")
    best = written(best, "best")
    beaten = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h")))
    gone = rows.join(best.hint("merge"), F.col("component") == F.col("c")).where(beaten).select("doc_id", "h").distinct()
    repeated = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "h")
    return written(gone, "gone"), written(repeated, "repeated")
