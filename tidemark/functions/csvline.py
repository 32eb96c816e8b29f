"""CSV records on one line, read with expressions only.

A field is either quoted (starts with ``"`` right at its start, doubles inner quotes, ends right before a comma or the
line's end) or holds no quote. Every repetition in the patterns is possessive, so neither long lines nor many quotes
make the matcher recurse or back up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_LINE = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


def without_cr(line: Column) -> Column:
    """One trailing carriage return is not part of a line."""
    return F.regexp_replace(line, r"\r\z", "")


def is_well_quoted(line: Column) -> Column:
    """Whether the quotes of a line are right; null for a null line."""
    return line.rlike(_LINE)


def split_fields(line: Column) -> Column:
    """The fields of a well quoted line, without their quotes. A comma before the line makes every match non-empty."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({_FIELD})"), F.lit(1))
    return F.transform(
        raw,
        lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
