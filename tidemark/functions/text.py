"""Text and number grammar of the feeds: blanks, missing tokens, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks, missing tokens (exact case) and the number grammar.
BLANKS = " \t"
MISSING_TOKENS = ["", ".", "NA", "N/A", "null", "None"]
NUMBER_PATTERN = r"\A[+\-−]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-−]?[0-9]+)?\z"
PICK_PATTERN = r"\A[pP][kK]\z"


def trim_blanks(c: Column) -> Column:
    """Without spaces and tabs at either end."""
    return F.trim(c, F.lit(BLANKS))


def is_missing(trimmed: Column) -> Column:
    """A missing token, given a trimmed text."""
    return trimmed.isin(MISSING_TOKENS)


def is_number(trimmed: Column) -> Column:
    """A number by the feeds' grammar (``PK`` is one), given a trimmed text."""
    return trimmed.rlike(NUMBER_PATTERN) | trimmed.rlike(PICK_PATTERN)


def to_number(trimmed: Column) -> Column:
    """The double that a trimmed text stands for; null when it is no number."""
    return F.when(trimmed.rlike(NUMBER_PATTERN), F.regexp_replace(trimmed, "−", "-").try_cast("double")).when(
        trimmed.rlike(PICK_PATTERN), F.lit(0.0)
    )


def normal_name(c: Column) -> Column:
    """Trimmed of blanks, inner runs of blanks made one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "[ \t]+", " ")))


def normal_double(c: Column) -> Column:
    """NaN as null and -0.0 as 0.0."""
    return F.when(~F.isnan(c), c + F.lit(0.0))
