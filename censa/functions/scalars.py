"""Column expressions of the domain: tiers, triage, calibration, distances, scores and identifiers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Rules


def ladder_tier(quality: Col, has_axis: Col, n_spots: Col, accept: float = 0.65, correct: float = 0.40, fewest: int = 3) -> Column:
    """failed without a quality; auto_accept, hand_correction or needs_a_look otherwise."""
    q = col(quality)
    return F.when(q.isNull(), "failed").when((q >= accept) & col(has_axis) & (col(n_spots) >= fewest), "auto_accept").when(q < correct, "hand_correction").otherwise("needs_a_look")


def health(n_real: Col, worst: Col) -> Column:
    """strong, thin or weak; a worst quality of 0 or null counts as good, as in the service it mirrors."""
    worst = F.coalesce(F.nullif(col(worst), F.lit(0.0)), F.lit(1.0))
    n = F.coalesce(col(n_real), F.lit(0))
    return F.when((n >= 3) & (worst >= 0.4), "strong").when(n >= 2, "thin").otherwise("weak")


def triage(failed: Col, confidence: Col, sure: float = 0.95, likely: float = 0.55) -> Column:
    c = col(confidence)
    return F.when(col(failed), "hand_correction").when(c >= sure, "auto_confirm").when(c >= likely, "needs_decision").otherwise("likely_new")


def was_override(chosen: Col, suggested: Col) -> Column:
    """A decision (null: a new individual) that differs from the suggestion (null: none was made)."""
    return ~col(chosen).eqNullSafe(col(suggested))


# Numbers


def sigmoid_platt(score: Col, a: Col | float | None, b: Col | float = 0.0) -> Column:
    """1 / (1 + exp(-(a s + b))); without `a`, the score clamped to [0, 1]."""
    s = col(score)
    clamped = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    if a is None:
        return clamped
    a = F.lit(a) if isinstance(a, float) else col(a)
    b = F.lit(b) if isinstance(b, float) else col(b)
    return F.when(a.isNull(), clamped).otherwise(1 / (1 + F.exp(-(a * s + b))))


def fbeta(precision: Col, recall: Col, beta: float = 0.5) -> Column:
    """F-beta; 0 where its denominator is 0."""
    p, r = col(precision), col(recall)
    down = beta * beta * p + r
    return F.when(down > 0, (1 + beta * beta) * p * r / down).otherwise(0.0)


def wilson(k: Col, n: Col, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval, clipped to [0, 1]; null where n is 0."""
    n = col(n).cast("double")
    p = col(k) / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    some = n > 0
    return F.when(some, F.greatest(middle - half, F.lit(0.0))), F.when(some, F.least(middle + half, F.lit(1.0)))


def haversine(lat1: Col, lon1: Col, lat2: Col, lon2: Col) -> Column:
    """Metres on a sphere of radius 6,371,000."""
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin(F.radians(col(lat2) - col(lat1)) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * 6371000 * F.asin(F.sqrt(h))


def dms_to_degrees(d: Col, m: Col, s: Col) -> Column:
    return col(d) + col(m) / 60 + col(s) / 3600


def gauss_gate(d2: Col, sigma: float) -> Column:
    """exp(-d2 / (2 sigma^2)); an unknown distance passes."""
    return F.coalesce(F.exp(-col(d2) / (2 * sigma * sigma)), F.lit(1.0))


def observability(x: Col, lo: Col, hi: Col) -> Column:
    """0 below lo, 1 above hi, linear between; null is 0."""
    x, lo, hi = col(x), col(lo), col(hi)
    return F.coalesce(F.when(hi > lo, F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise((x >= lo).cast("double")), F.lit(0.0))


def score_linear(metrics: dict[str, Col], coefficients: Col) -> Column:
    """Sum of coefficient times metric over the letters of `metrics`; unknown letters and malformed coefficients count 0, as missing metrics do; 6 places."""
    table = col(coefficients)
    total = F.lit(0.0)
    for letter, metric in metrics.items():
        weight = F.coalesce(F.try_element_at(table, F.lit(letter)).try_cast("double"), F.lit(0.0))
        total = total + weight * F.coalesce(col(metric).cast("double"), F.lit(0.0))
    return F.round(total, 6)


# Vectors


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Col) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Col, b: Col, eps: float = 1e-12) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def unit(a: Col) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(col(a), lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def additive_cosine(a: Col, b: Col) -> Column:
    """Mean of the cosines of two unit halves: half the dot product."""
    return dot(a, b) / 2


def sinusoidal(x: Col, bands: int) -> Column:
    """sin and cos of x at doubling frequencies."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.pow(F.lit(2.0), k) * F.lit(3.141592653589793) * col(x))
    return F.concat(F.transform(angles, lambda a: F.sin(a)), F.transform(angles, lambda a: F.cos(a)))


def outer(a: Col, b: Col, lift: float = 1.0) -> Column:
    """The outer product, flat, of two vectors, each with `lift` appended and then of unit length: dot products are those of the two sides, multiplied."""

    def lifted(v: Col) -> Column:
        whole = F.concat(col(v).cast("array<double>"), F.array(F.lit(float(lift))))
        size = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(whole, lambda x: x / size)

    right = lifted(b)
    return F.flatten(F.transform(lifted(a), lambda x: F.transform(right, lambda y: x * y)))


def decimate(points: Col, most: int) -> Column:
    """At most `most` evenly spaced elements, the last one kept."""
    p = col(points)
    n = F.size(p)
    step = F.ceil(n / F.lit(most)).cast("int")
    return F.when(n <= most, p).otherwise(F.filter(p, lambda _, k: (k % step == 0) & (k < (most - 1) * step) | (k == n - 1)))


# Shapes: arrays of struct<x, y>


def _turned(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))


def polygon_area(points: Col) -> Column:
    p = col(points)
    return F.when(F.size(p) > 2, F.abs(F.aggregate(F.zip_with(p, _turned(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def perimeter(points: Col) -> Column:
    p = col(points)
    return F.when(F.size(p) > 1, F.aggregate(F.zip_with(p, _turned(p), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def bin_of(t: Col, side: Col) -> Column:
    """Boxes 1 to 8 from head to tail, odd ones on the left; null for neither side."""
    quarter = F.least(F.greatest(F.floor(col(t) * 4), F.lit(0)), F.lit(3)).cast("int")
    return F.when(col(side) == "left", 2 * quarter + 1).when(col(side) == "right", 2 * quarter + 2)


# Identifiers


def label_strict(image_id: Col) -> Column:
    """The label of `label_instance` or `label_gN`; null for anything else."""
    x = col(image_id)
    return F.when(x.rlike(r"^(.+)_([0-9]+|g[0-9]+)$"), F.regexp_extract(x, r"^(.+)_([0-9]+|g[0-9]+)$", 1))


def label_loose(image_id: Col) -> Column:
    """All before the last underscore, or the whole."""
    return F.regexp_replace(col(image_id), "_[^_]*$", "")


def label_two(image_id: Col) -> Column:
    """The first two tokens."""
    return F.substring_index(col(image_id), "_", 2)


def is_synthetic(image_id: Col) -> Column:
    return col(image_id).rlike("_g[0-9]+$")


def code(image_id: Col) -> Column:
    return F.split_part(col(image_id), F.lit("_"), F.lit(1))


def display(label: Col) -> Column:
    """Upper case, the last underscore as a dash."""
    return F.upper(F.regexp_replace(col(label), "_([^_]*)$", "-$1"))


def from_display(text: Col) -> Column:
    return F.lower(F.regexp_replace(col(text), "-([^-]*)$", "_$1"))


def is_provisional(label: Col) -> Column:
    return col(label).startswith("up_")


def natural_key(text: Col, width: int = 12) -> Column:
    """Sorts digit runs by value: each is padded with zeros."""
    parts = F.regexp_extract_all(F.lower(col(text)), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")
