"""Names: format characters, numbers, catalogue ids and letters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters of the Hebrew alphabet in order (final forms after their letters), and Latin letters by place.
HEBREW = "אבגדהוזחטיכךלמםנןסעפףצץקרשת"
LATIN = "abgdhwzjtykklmmnnsappccqrsu"


def strip_format(text: Column | str) -> Column:
    """Without invisible characters that steer the direction or the joining of text."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def first_digits(text: Column | str) -> Column:
    """The first run of digits as it stands, or null."""
    return F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit(""))


def parse_catalogue(df: DataFrame, name: str) -> DataFrame:
    """Adds year, series and number of names like KF-21-B-0042.jpg; null for other names."""
    pattern = r"^KF-(\d{2})-([A-Za-z])-(\d+)(?:\.[^.]+)?$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return df.select("*", part(1).cast("int").alias("year"), F.upper(part(2)).alias("series"), part(3).cast("bigint").alias("number"))


def name_code(name: Column | str) -> Column:
    """Two Latin letters: the first Hebrew letters of the first two words, or the first two of a single word."""
    latin = F.regexp_replace(F.translate(F.regexp_replace(name, rf"[^{HEBREW}\s]", ""), HEBREW, LATIN), r"^\s+|\s+$", "")
    words = F.filter(F.split(latin, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= 2, F.concat(F.substring(words[0], 1, 1), F.substring(words[1], 1, 1))).otherwise(F.substring(latin, 1, 2))
