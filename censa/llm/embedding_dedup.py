"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes, gives every vector the string of its signs, sorts the vectors of a label by it, and
compares each vector with its `window` successors. Pairs that reach the cosine are united across passes.

The number of passes follows from the size of a label, as for labels that sign bits split evenly; one that is no longer than
the window meets whole in its first pass. Dense labels split worse, so passes go on in rounds until a round joins hardly
anything new. Equal vectors are one vector with a weight. Windows alone would cap the partners of a vector in a crowd, so
links are counted afterwards within each component, exactly and in blocks: a crowd of any size is cut into chunks and each
pair of chunks is a task that emits counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import dealt_in_chunks, discard, written
from .components import connected_components
from .simhash import least_labels

COSINE = 0.93
WINDOW = 256
SIGN_BITS = 48
CHUNK = 1024
#: Rows compared with the window at a time.
BLOCK = 512
#: A further round of passes follows while one joins more than this share of all that is joined in a label.
FRESH = 0.001


def passes_needed(rows: int, cosine: float, window: int, miss: float) -> int:
    """Passes after which a pair at the threshold has met in a window with chance 1 - miss, for `rows` vectors of a label
    that sign bits split evenly; 1 where the window holds the label."""
    if rows <= window:
        return 1
    agree = 1 - math.acos(cosine) / math.pi
    meet = agree ** (math.log2(rows / window) + 1)
    return max(2, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 else 2


def _unit(values: pa.Array) -> np.ndarray:
    """Rows of a list array as unit vectors in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _vectors(table: DataFrame) -> DataFrame:
    """One row per vec_id as (vec_id, label, vector), with ids only. Only rows of repeated ids are shuffled whole."""
    kind = table.schema["embedding"].dataType
    element = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    rows = table.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("vector"))
    repeated = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated")
    again = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("v"))
    return rows.join(repeated, "vec_id", "left_anti").unionByName(again.select("vec_id", "v.label", "v.vector"))


def _hashed(vectors: DataFrame) -> DataFrame:
    """Adds dim and hashes; vectors that link with nothing become null, their hashes too."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    vectors = vectors.withColumn("vector", F.when(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & some, F.col("vector")))
    # Equal vectors are found by 128 bits of hashes.
    hashes = {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label")}
    return vectors.withColumns({"dim": F.size("vector")} | {name: F.when(F.col("vector").isNotNull(), h) for name, h in hashes.items()})


def _codes(seed: int, vectors: bool):
    """The codes of the passes first_pass to end_pass of each vector: its strings of signs, as sortable longs.

    `grp` is the code's first `bits` bits, so that rows of a group may meet in one task.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64)
        for batch in rows:
            names = ("vec_id", "label", "dim", "vector", "bits", "first_pass", "end_pass")
            ids, label, dim, vector, bits, first, end = (batch.column(batch.schema.get_field_index(n)) for n in names)
            dims, bits, first, end = (np.asarray(c) for c in (dim, bits, first, end))
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                x = _unit(vector.take(pa.array(of)))
                for p in range(int(first[of].min()), int(end[of].max())):
                    on = (first[of] <= p) & (p < end[of])
                    if not on.any():
                        continue
                    planes = np.random.default_rng([seed, p, int(d)]).standard_normal((int(d), SIGN_BITS))
                    code = (x[on] @ planes > 0) @ weights
                    at = pa.array(of[on])
                    out = [pa.array(np.full(len(at), p, np.int32)), label.take(at), pa.array(dims[of[on]].astype(np.int32)), pa.array(code >> (SIGN_BITS - bits[of[on]].astype(np.int64))), pa.array(code), ids.take(at)]
                    fields = ["pass", "label", "dim", "grp", "code", "vec_id"]
                    yield pa.RecordBatch.from_arrays([*out, vector.take(at)] if vectors else out, [*fields, "vector"] if vectors else fields)

    return run


def _windows(cosine: float, window: int):
    """Compares each vector with its successors within the window; rows come sorted.

    Of the verified pairs a spanning forest is emitted: what they connect, without a crowd's many pairs. `label` names
    the part of the forest that each held row belongs to, by the id of one of its vectors.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, label = None, None, None
        for batch in rows:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("pass", "label", "dim", "grp", "cut")]
            key = np.stack([np.asarray(c).astype(np.int64) for c in columns], 1)
            ids, vector = np.asarray(batch.column(batch.schema.get_field_index("vec_id"))), batch.column(batch.schema.get_field_index("vector"))
            cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(ids)]
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at != tuple(key[lo]):
                    at, held, label = tuple(key[lo]), None, ids[:0]
                for i in range(lo, hi, BLOCK):
                    j = min(i + BLOCK, hi)
                    x = _unit(vector.slice(i, j - i))
                    pool = x if held is None else np.concatenate([held, x])
                    label = np.r_[label, ids[i:j]]
                    left, right = np.nonzero(x @ pool.T >= cosine)
                    if len(left) > len(x):  # more than each row with itself
                        part, of = np.unique(label, return_inverse=True)
                        seen = np.zeros((len(x), len(part)), bool)
                        seen[left, of[right]] = True
                        left, right = np.nonzero(seen)
                        least = least_labels(len(part), of[len(of) - len(x) + left], right)
                        moved = np.flatnonzero(least != np.arange(len(part)))
                        a.append(part[moved]), b.append(part[least[moved]])
                        label = part[least][of]
                    held, label = pool[-window:], label[-window:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _pass_pairs(usable: DataFrame, sizes: DataFrame, cosine: float, window: int, seed: int) -> DataFrame:
    """Edges (a, b) from the passes that `sizes` (label, dim, bits, first_pass, end_pass) asks for.

    A pass sorts a label; what meets in a task is a group, the rows that share the first bits of their codes. A group far
    above the window is cut by further bits, and what then is still larger streams through its task.
    """
    rows = usable.join(sizes, ["label", "dim"])
    fields = "pass int, label long, dim int, grp long, code long, vec_id long"
    group = ["pass", "label", "dim", "grp"]
    codes = rows.where("bits > 0").select("vec_id", "label", "dim", "vector", "bits", "first_pass", "end_pass").mapInArrow(_codes(seed, False), fields)
    large = codes.groupBy(*group).count().where(F.col("count") > 4 * window).withColumn("more", (2 * F.ceil(F.log2(F.col("count") / window))).cast("int"))
    large = written(large.join(sizes, ["label", "dim"]).select(*group, F.greatest(F.lit(0), SIGN_BITS - F.col("bits") - F.col("more")).alias("shift")), "large")
    kind = usable.schema["vector"].dataType.simpleString()
    passes = rows.select("vec_id", "label", "dim", "vector", "bits", "first_pass", "end_pass").mapInArrow(_codes(seed, True), f"{fields}, vector {kind}")
    passes = passes.join(large, group, "left").withColumn("cut", F.coalesce(F.expr("shiftright(code, shift)"), F.lit(0).cast("long")))
    key = [*group, "cut"]
    return passes.select(*key, "code", "vec_id", "vector").repartition(*key).sortWithinPartitions(*key, "code", "vec_id").mapInArrow(_windows(cosine, window), "a long, b long")


def _groups(usable: DataFrame, cosine: float, window: int, miss: float, seed: int) -> DataFrame:
    """(id, component) of the vectors that have a link."""
    agree = 1 - math.acos(cosine) / math.pi
    n = F.col("rows") / window
    meet = F.pow(F.lit(agree), F.log2(n) + 1)
    # Two rounds at least; see passes_needed.
    each = F.when(n <= 1, 1).otherwise(F.ceil(F.greatest(F.lit(2), F.ceil(math.log(miss) / F.log(1 - meet))) / 2)).cast("int")
    sizes = usable.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows")).withColumn("bits", F.least(F.lit(SIGN_BITS), F.greatest(F.lit(0), F.ceil(F.log2(n)))).cast("int"))
    sizes = written(sizes.select("label", "dim", "bits", each.alias("each"), F.lit(0).cast("long").alias("joined")), "sizes")
    groups, turn, now = None, 0, sizes
    while True:
        asked = now.select("label", "dim", "bits", (turn * F.col("each")).alias("first_pass"), ((turn + 1) * F.col("each")).alias("end_pass"))
        pairs = _pass_pairs(usable, asked, cosine, window, seed)
        if groups is not None:
            pairs = pairs.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))
        found = written(connected_components(pairs), "groups")
        if groups is not None:
            discard(groups)
        groups, turn = found, turn + 1
        joined = usable.select("label", "dim", F.col("vec_id").alias("id")).join(groups.where("id <> component"), "id").groupBy("label", "dim").agg(F.count(F.lit(1)).alias("after"))
        after = now.where("bits > 0").join(joined, ["label", "dim"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
        if turn > 1:
            after = after.where(F.col("after") - F.col("joined") > FRESH * F.col("after"))
        now = written(after.select("label", "dim", "bits", "each", F.col("after").alias("joined")), "sizes")
        if now.isEmpty():
            return groups


def _count_links(cosine: float):
    """Sums, for the vectors of each part, the weights of those that they link with."""

    def solve(role, ids, weight, x):
        tree, probe = (role & 1) > 0, (role & 2) > 0
        hits = (x[probe] @ x[tree].T >= cosine).astype(np.float64)
        if (role == 3).all():
            np.fill_diagonal(hits, 0)
            return ids, hits @ weight
        return np.r_[ids[probe], ids[tree]], np.r_[hits @ weight[tree], hits.T @ weight[probe]]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(held):
            ids, n = solve(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["rep", "n"])

        held, at = [], None
        for batch in rows:
            if not batch.num_rows:
                continue
            names = ("component", "part", "role", "rep", "weight", "vector")
            *facts, vector = (batch.column(batch.schema.get_field_index(n)) for n in names)
            comp, part, role, ids, weight = (np.asarray(c) for c in facts)
            cuts = np.r_[0, np.flatnonzero((comp[1:] != comp[:-1]) | (part[1:] != part[:-1])) + 1, len(ids)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if held and at != (comp[i], part[i]):
                    yield counted(held)
                    held = []
                at = (comp[i], part[i])
                held.append((role[i:j], ids[i:j], weight[i:j].astype(np.float64), _unit(vector.slice(i, j - i))))
        if held:
            yield counted(held)

    return run


def embedding_duplicates(table: DataFrame, cosine: float = COSINE, window: int = WINDOW, miss: float = 1e-4, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vec_id.

    Vectors link when their labels and lengths are equal, the labels not null, and their cosine (double precision) is at
    least `cosine`. Null, empty and zero vectors and those with null or non-finite components link with nothing. A
    repeated vec_id is one vector, that of the least label and components; rows without vec_id are left out. An empty
    table gives an empty result; further columns are ignored.
    """
    vectors = _hashed(_vectors(table))
    copies = written(vectors.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")).where("weight > 1"), "copies")
    vectors = written(vectors.join(copies, ["h1", "h2"], "left").select("vec_id", "label", "dim", "vector", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight")), "vectors")
    single = vectors.where("vec_id = rep and vector is not null")
    groups = _groups(single, cosine, window, miss, seed)
    dealt = dealt_in_chunks(groups.select(F.col("id").alias("rep"), "component"), "component", F.xxhash64("rep"), chunk)
    dealt = dealt.join(single.select("rep", "weight", "vector"), "rep").select("component", "part", "role", "rep", "weight", "vector")
    counts = dealt.repartition("component", "part").sortWithinPartitions("component", "part").mapInArrow(_count_links(cosine), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    facts = groups.withColumnRenamed("id", "rep").join(counts, "rep", "left")
    component = F.coalesce("component", "rep")
    links = F.coalesce("n", F.lit(0)) + F.col("weight") - 1
    return vectors.select("vec_id", "rep", "weight").join(facts, "rep", "left").select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
