"""Fill-in-middle: a text is cut at two random units and its parts reordered, so that a model learns to fill the gap.

Units are the matches of a pattern, left to right: code points by default; words, lines or tokens with another pattern.
They are never listed. A first pass counts them, a second one advances a fresh iterator to the smaller rank and then to the
larger one; both hold one match at a time, so the memory a text needs is the text and its output, however many units it has.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"[\s\S]"
#: Of 100 texts, those that are cut, and of 100 that are cut those whose suffix comes first.
CUT_SHARE, SUFFIX_FIRST = 90, 20
#: Characters of text after which a batch of output is handed on.
RUN = 1 << 21


def count_units(pattern: re.Pattern, text: str) -> int:
    """The number of matches, one after another; none is kept."""
    n = count()
    deque(zip(pattern.finditer(text), n), maxlen=0)
    return next(n)


def ends_of(pattern: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` and the first `second` units end (first <= second); 0 units end where the text begins."""
    units, at, done = pattern.finditer(text), [], 0
    end = 0
    for rank in (first, second):
        last = next(islice(units, rank - done - 1, None), None) if rank > done else None
        done, end = rank, last.end() if last else end
        at.append(end)
    return at[0], at[1]


def transform(text: str, digest: str, pattern: re.Pattern, cut_share: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output) of a text.

    The first four groups of eight hex digits of `digest` are the random numbers: two ranks, whether to cut, which form.
    What stands before the first unit belongs to the prefix, what follows the last one to the suffix.
    """
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = count_units(pattern, text)
    if not text or h[2] % 100 >= cut_share or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = ends_of(pattern, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output, form):
    """The text that a column of outputs was made of, by its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, salt: str = "1", cut_share: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text as it is (plain), or in parts, prefix or suffix first.

    n counts units; prefix_chars and middle_chars count code points and are null for plain texts. Random numbers are the
    sha256 of `salt:doc_id`, so reruns agree; rows without doc_id count as an empty id, and rows that repeat an id are cut
    by the same numbers, each its own text. Null texts are empty, empty ones plain. Texts of any length are cut whole, in
    memory that does not grow with their units; a task hands its output on every RUN characters. An empty table gives an
    empty result; further columns are ignored, whatever their names. `unit` must not match an empty string.
    """
    pattern = re.compile(unit)
    if pattern.match(""):
        raise ValueError("a unit must not be empty")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("digest"),
    )
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, text, digest in zip(*(batch.column(k) for k in range(3)), strict=True):
                out.append((doc.as_py(), *transform(text.as_py(), digest.as_py(), pattern, cut_share, suffix_first)))
                held += len(out[-1][-1])
                if held > RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM o
"""
