"""SimHash near-duplicate detection with BK-trees.

Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints are collapsed first, so exact copies never
meet in one task. The distinct fingerprints are dealt into shards that are complete for the radius: the 64 bits are cut
into `blocks` blocks, and two fingerprints within the radius agree on at least `blocks - radius` of them, so each
fingerprint joins the shard of every choice of that many blocks. Each shard holds a BK-tree (children keyed by integer
Hamming distance to the parent) and its members follow only edges within the radius. A shard of more than `shard_rows`
members is cut into chunks, and each pair of chunks is a task of its own: one chunk's tree is sent to the other's
members. A tree therefore has at most about `shard_rows` nodes, whatever the data.

Broadcasting the trees of all documents to all tasks would compare everything with everything, since at radius 3 a
BK-tree of 64-bit codes prunes little; the shards make the trees small and their number follow the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, dealt_in_chunks, discard, text_chunks, whole_parts, written
from .components import connected_components

SHARD_ROWS = 1024


def fingerprint_bytes(text: bytes, words: int = 3) -> int:
    """SimHash of a text's lower-cased (A-Z) word shingles, repeats included: a bit is 1 if set in over half the hashes."""
    return _simhash(text.lower().split(), words)


def _simhash(parts: list[bytes], words: int, seed: int = 42) -> int:
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    total, count, digest = np.zeros(64, np.int64), len(parts) - words + 1, xxhash.xxh64_digest
    for at in range(0, count, 1 << 16):
        run = parts[at : at + (1 << 16) + words - 1]
        hashes = b"".join([digest(b" ".join(x), seed) for x in zip(*(run[k:] for k in range(words)), strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        even = len(bits) // 255 * 255
        total += bits[:even].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[even:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of each row's whole text; null and wordless texts have 0."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(rows, "doc_id", "text"):
            out = np.zeros(len(ids), np.uint64)
            for lo, hi, data, at in text_chunks(texts):
                raw = data.tobytes()
                for k in range(lo, hi):
                    out[k] = fingerprint_bytes(raw[at[k - lo] : at[k - lo + 1]], words)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Forest:
    """BK-trees of many shards at once, as arrays. Rows of a shard are adjacent; `code` holds distinct codes per shard."""

    def __init__(self, shard: np.ndarray, code: np.ndarray):
        n = len(code)
        self.code = code
        self.roots = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        node = np.repeat(self.roots, np.diff(np.r_[self.roots, n]))
        rows = np.flatnonzero(np.arange(n) != node)
        node = node[rows]
        links, children = [], []
        while len(rows):
            key = node * 65 + np.bitwise_count(code[rows] ^ code[node])
            found, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = rows[first]
            links.append(found)
            children.append(child)
            node = child[back]
            stay = rows != node
            rows, node = rows[stay], node[stay]
        links = np.concatenate(links) if links else np.zeros(0, np.int64)
        children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(links, kind="stable")
        self.links, self.children = links[order], children[order]

    def search(self, codes: np.ndarray, roots: np.ndarray, radius: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) of all nodes within the radius; roots: the node where each query starts."""
        stack = [(np.arange(k, min(k + block, len(codes))), roots[k : k + block]) for k in range(0, len(codes), block)]
        while stack:
            query, node = stack.pop()
            far = np.bitwise_count(codes[query] ^ self.code[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield query[near], node[near], far[near]
            lo = np.searchsorted(self.links, node * 65 + np.maximum(far - radius, 0), "left")
            hi = np.searchsorted(self.links, node * 65 + np.minimum(far + radius, 64), "right")
            count = hi - lo
            query, lo, count = query[count > 0], lo[count > 0], count[count > 0]
            if not len(query):
                continue
            ends = np.cumsum(count)
            cuts = [0, *(np.searchsorted(ends, np.arange(block, ends[-1], block), "left") + 1).tolist(), len(query)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    c = count[i:j]
                    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    stack.append((np.repeat(query[i:j], c), self.children[np.repeat(lo[i:j], c) + step]))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def _shards(codes: DataFrame, radius: int, blocks: int, shard_rows: int) -> DataFrame:
    """(key, part, role, fp, rep): role 1 is in the part's tree, 2 searches it, 3 both."""
    agree = blocks - radius
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in chosen) for chosen in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = codes.select("fp", "rep", F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)])).alias("key"))
    return dealt_in_chunks(keyed, "key", F.xxhash64("fp", "rep"), shard_rows)


def _search_shards(radius: int):
    def solve(key, part, role, code, rep):
        """A spanning forest of the links of complete parts; rows are sorted by key and part."""
        fresh = np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        group = np.cumsum(fresh) - 1
        single = np.bincount(group) == 1
        keep = ~single[group]
        group, role, code, rep = group[keep], role[keep], code[keep], rep[keep]
        if not len(group):
            return rep, rep
        tree, probe = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        forest = Forest(group[tree], code[tree])
        root = np.full(group[-1] + 1, -1)
        root[group[tree][forest.roots]] = forest.roots
        start = root[group[probe]]
        probe, start = probe[start >= 0], start[start >= 0]
        left, right = [], []
        for q, node, _ in forest.search(code[probe], start, radius):
            q, node = probe[q], tree[node]
            ok = q != node
            left.append(q[ok]), right.append(node[ok])
        if not left:
            return rep[:0], rep[:0]
        label = least_labels(len(rep), np.concatenate(left), np.concatenate(right))
        own = label != np.arange(len(rep))
        return rep[own], rep[label[own]]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, role, code, rep in whole_parts(rows, "key", "part", "role", "fp", "rep"):
            a, b = solve(key, part, role, code.view(np.uint64), rep)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(codes: DataFrame, radius: int = 3, blocks: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) links between representatives of distinct fingerprints (fp, rep) within the radius.

    A spanning forest of each shard's links: no link is lost for components, and none of a crowd's many pairs is emitted.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    dealt = _shards(codes, radius, blocks, shard_rows)
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return dealt.mapInArrow(_search_shards(radius), "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable by links, itself included.

    Null and wordless texts have fingerprint 0 and are linked like any other. Rows that repeat a doc_id each get a row.
    Rows without doc_id link like others and get the component's id, null if no row of it has one. An empty table gives
    an empty result; further columns are ignored. A text of any length is read whole, in runs of shingles.
    """
    prints = written(fingerprints(docs, words), "simhash")
    # A fingerprint stands for itself in the links; ids only name the components.
    codes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("own")), "codes")
    found = connected_components(links(codes.select("fp", F.col("fp").alias("rep")), radius, blocks, shard_rows))
    parts = codes.join(found, codes.fp == found.id, "left").select("fp", "own", F.coalesce("component", "fp").alias("component"))
    least = parts.groupBy("component").agg(F.min("own").alias("component_id"))
    labels = written(parts.join(least, "component").select("fp", "component_id"), "labels")
    discard(codes)
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")
