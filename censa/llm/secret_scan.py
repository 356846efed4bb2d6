"""Secret scans: fixed patterns, and novelty measured with a dictionary-primed compressor.

The novelty method looks at strings of token characters near a sensitive word. Candidates and dictionaries are split into words
at separators, changes of case and changes between letters and digits, so that names in any style meet the words they are made of.
One compressor is primed with a large vocabulary and common identifiers, another with the text around the candidate; the
bytes that the candidate adds to each show how much of it is new. A candidate is reported if it adds no less than nearly all
random strings of the same alphabet and length do; long ones are scored in pieces.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
import warnings
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_chunks

#: Vocabulary of a public tokenizer, a token (base64) and its rank a line; the words among its tokens prime the compressor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text on either side that prime the compressor.
AROUND = 2048
#: A candidate counts as in a sensitive context if a sensitive word ends or begins at most so far before it.
REACH = 40
MIN_CANDIDATE = 20
#: Of so many random strings, so many may be less novel than the least that is reported.
RANDOM_STRINGS, LEAST = 200, 2
#: Longer candidates are scored in pieces of so many characters or a few more.
PIECE = 64
LEVEL = 12
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
_UNBROKEN = re.compile(r"[A-Za-z0-9]{%d,}" % MIN_CANDIDATE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api_?key|access_?key|private_?key|credential|auth|bearer|session_?id|signature", re.I | re.A)
# Words of identifiers that prime the compressor.
IDENTIFIERS = b"""
access_key_id secret_access_key api_key apikey client_id client_secret private_key public_key password passwd passphrase
username user_name token refresh_token access_token id_token session_id bearer authorization authentication credential
credentials signature certificate account_name connection_string database_url hostname endpoint region bucket_name
environment config configuration settings default development production staging testing example placeholder changeme
your_api_key_here your-secret-token xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 1234567890123456789012345678901234567890
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef import export return function class public static
get_set_update_delete_create_find_list_count_value_index_name_type_data_file_path_line_code_text_string_number_object
https://www.example.com/ localhost:8080 application/json text/html content-type user-agent accept-encoding
"""


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: is it a hexadecimal digit in lower case; may it stand in a candidate."""
    digit, token = np.zeros(256, bool), np.zeros(256, bool)
    digit[list(b"0123456789abcdef")] = True
    token[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
    return digit, token


def _has_run(mask: np.ndarray, length: int) -> np.ndarray:
    """Where a run of `length` true values starts."""
    width = 1
    while 2 * width <= length:
        mask = mask[:-width] & mask[width:] if len(mask) > width else mask[:0]
        width *= 2
    if width < length:
        step = length - width
        mask = mask[:-step] & mask[step:] if len(mask) > step else mask[:0]
    return np.flatnonzero(mask)


def folded(text: str) -> bytes:
    """The words of a text in lower case, a separator before, between and after them."""
    return f"_{'_'.join(_WORDS.findall(text))}_".lower().encode()


def dictionary(vocabulary: str = VOCABULARY) -> bytes:
    """What primes the compressor: the words of a tokenizer's vocabulary, frequent ones last, and common identifiers.

    Read on the driver (a vocabulary has a fixed size) and sent with the tasks. Without the file only identifiers are known, and
    names made of other words are reported like secrets.
    """
    words: dict[str, None] = {}
    if Path(vocabulary).is_file():
        for line in Path(vocabulary).read_bytes().splitlines():
            token = base64.b64decode(line.split()[0]).decode("ascii", "replace")
            if token.startswith(" ") and token[1:].isalpha() and token.isascii() and 3 <= len(token[1:]) <= 16:
                words.setdefault(token[1:].lower())
    else:
        warnings.warn(f"no vocabulary at {vocabulary}: secret scans know common identifiers only", stacklevel=2)
    return folded(" ".join(reversed(words)) + IDENTIFIERS.decode())


@lru_cache(8)
def _known(primer: bytes):
    """A function that gives the marginal compressed bytes of a string after the primer."""
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    empty = len(tool.compress(b""))
    return lambda own: len(tool.compress(folded(own))) - empty


@lru_cache(4096)
def _random_novelty(primer: bytes, alphabet: str, length: int) -> int:
    """Marginal bytes that nearly all random strings of the alphabet and length have or exceed."""
    chance, known = random.Random(f"{alphabet} {length}"), _known(primer)
    return sorted(known("".join(chance.choices(alphabet, k=length))) for _ in range(RANDOM_STRINGS))[LEAST]


def _alphabet(own: str) -> str:
    """The characters that a random text like this one is drawn from: those of an encoding, or of the kinds that occur."""
    letters = set(own)
    for some in ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz234567"):
        if letters <= set(some) | set("-_=") and letters & set(string.digits) and letters & set(string.ascii_letters):
            return some + "".join(sorted(letters & set("-_")))
    kinds = [k for k in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if letters & set(k)]
    return "".join(kinds) + "".join(sorted(letters & set("+/_-")))


def _all_new(own: str, primer: bytes) -> bool:
    """Whether most pieces of `own` add as many bytes to what is known as random strings of their alphabet do."""
    known, alphabet, pieces = _known(primer), _alphabet(own), max(1, len(own) // PIECE)
    cuts = [len(own) * k // pieces for k in range(pieces + 1)]
    missing = pieces // 2 + 1
    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        missing -= known(own[s:e]) >= _random_novelty(primer, alphabet, e - s)
        if missing <= 0 or missing > pieces - k - 1:
            break
    return missing <= 0


def is_novel(text: str, start: int, end: int, primer: bytes) -> bool:
    """Whether text[start:end], or an unbroken run of letters and digits in it, is as new as random text of its alphabet.

    Both to the dictionary and to the text around it, in which other places of the same string do not count.
    """
    own = text[start:end]
    runs = [own, *(m[0] for m in _UNBROKEN.finditer(own) if m[0] != own)]
    new = [x for x in runs if _all_new(x, primer)]
    if not new:
        return False
    around = f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}"
    return any(_all_new(x, folded(around.replace(x, " "))) for x in new)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, leftmost non-overlapping for each kind."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int, int]], primer: bytes) -> list[tuple[int, int, int, int]]:
    """Incompressible candidates in a sensitive context that overlap no base span."""
    out, begins, ends, k = [], None, None, 0
    taken = sorted((s, e) for s, _, e, _ in base)
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        if not _WORDS.search(text, s, e):  # a rule of dashes or the like
            continue
        if begins is None:
            words = [w.span() for w in _SENSITIVE.finditer(text)]
            begins, ends = [a for a, _ in words], [b for _, b in words]
        # Some word ends after s - REACH and begins before s: both lists are sorted, so it is the first that ends late enough.
        at = bisect_left(ends, s - REACH)
        if at < len(begins) and begins[at] < s and is_novel(text, s, e, primer):
            out.append((s, 3, e, s))
    return out


def secrets(texts: pa.Array, primer: bytes) -> Iterator[tuple[int, str, list, list]]:
    """(row, text, base spans, novel spans) of the texts that have any, from whole texts."""
    digit, token = _classes()
    for lo, hi, data, at in text_chunks(texts):
        raw = data.tobytes()
        low = raw.lower()
        runs = np.r_[_has_run(digit[data], 24), _has_run(token[data], MIN_CANDIDATE)]
        hot = set((np.searchsorted(at, runs, "right") - 1).tolist())
        for word in (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"):
            k = low.find(word)
            while k >= 0:
                hot.add(row := int(np.searchsorted(at, k, "right")) - 1)
                k = low.find(word, int(at[row + 1]))
        for k in sorted(hot):
            text = raw[at[k] : at[k + 1]].decode()
            base = base_spans(text)
            novel = novel_spans(text, base, primer)
            if base or novel:
                yield lo + k, text, base, novel


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e, _ in sorted(spans))


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) per row of `docs`.

    Positions count code points, ends exclusive. Null and empty texts have no spans. Repeated rows and null ids each get a
    row; an empty table gives an empty result; further columns are ignored. A text of any length is scanned whole, in time
    that follows its length and the candidates in it.
    """
    primer = dictionary(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for ids, texts in batches(rows, "doc_id", "text"):
            n = len(ids)
            counts, shas, spans = np.zeros((4, n), np.int64), [none] * n, [""] * n
            for k, _, base, novel in secrets(texts, primer):
                for _, kind, _, _ in base + novel:
                    counts[kind, k] += 1
                shas[k], spans[k] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + novel)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in counts), pa.array(shas), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with the values of all secrets in `text` replaced by `mark`, and n_chars, if there, counted anew for those rows."""
    primer, names = dictionary(vocabulary), docs.columns
    text_at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            cols = list(batch.columns)
            changed = {}
            for k, text, base, novel in secrets(cols[text_at], primer):
                out, end = [], 0
                for s, e in sorted((v, e) for _, _, e, v in base + novel):
                    if s >= end:
                        out += [text[end:s], mark]
                    end = max(end, e)
                changed[k] = "".join(out) + text[end:]
            if changed:
                texts = cols[text_at].to_pylist()
                for k, text in changed.items():
                    texts[k] = text
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if n_at is not None:
                    n = cols[n_at].to_pylist()
                    for k, text in changed.items():
                        n[k] = len(text)
                    cols[n_at] = pa.array(n, cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
