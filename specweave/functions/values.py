"""Values that are a number, a truth value or a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def as_number(value: Column) -> Column:
    """The value as a number, null for anything else."""
    bare = F.trim(value)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def digits(number: Column, significant: int = 12) -> Column:
    """A rendering that is equal for numbers equal to so many significant digits; null for null."""
    return F.when(number == 0, F.format_string(f"%.{significant - 1}e", F.lit(0.0))).when(number.isNotNull(), F.format_string(f"%.{significant - 1}e", number))


def value_key(value: Column, significant: int = 12) -> Column:
    """The key by which recorded values agree: numbers by magnitude, words without case and blanks."""
    return F.coalesce(digits(as_number(value), significant), F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))))


def condition_key(condition: Column) -> Column:
    """A condition without case, blank runs and outer punctuation; null is the empty condition."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(condition, r"\s+", " ")), r"^[ .,;]+|[ .,;]+$", ""), F.lit(""))


def close(a: Column, b: Column, relative: float = 1e-6) -> Column:
    return F.when((a == 0) & (b == 0), True).otherwise(F.abs(a - b) < relative * F.greatest(F.abs(a), F.abs(b)))
