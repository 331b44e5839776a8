"""Text to typed columns.

Raw tables hold text only. Every conversion here gives NULL for text that does not
fit, whether ANSI mode is on or off, so one bad cell never stops a load; the table
contract decides afterwards whether a NULL is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; empty or all-blank text becomes NULL."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


# What the casts accept. A refused cast costs an exception per cell, which a column of
# misfits would pay for every row, so text is looked at before it is cast; only a number
# too large for its type still gets as far as the exception.
_WHOLE = r"^\s*+[+-]?+\d++\s*+$"
_WITH_FRACTION = r"^\s*+[+-]?+\d++\.\d*+\s*+$"
_DECIMAL = r"^\s*+[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\s*+$"
_FLOAT = (
    r"(?i)^\s*+(?:[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:e[+-]?+\d++)?+[fd]?+"
    r"|[+-]?+inf(?:inity)?+|nan)\s*+$"
)
_BOOLEAN = r"(?i)^\s*+(?:t|true|y|yes|1|f|false|n|no|0)\s*+$"
_ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def to_whole(c: Column | str, dtype: str = "int") -> Column:
    """Text to an integer type; a decimal fraction is cut off (``'4.7'`` is 4)."""
    text = _col(c)
    whole_part = F.substring_index(text, ".", 1)
    number = F.when(text.rlike(_WHOLE), text).when(text.rlike(_WITH_FRACTION), whole_part)
    return number.try_cast(dtype)


def typed(c: Column | str, dtype: str) -> Column:
    """Text to ``dtype``; text that does not fit becomes NULL."""
    if dtype in ("int", "bigint"):
        return to_whole(c, dtype)
    if dtype.startswith("decimal"):
        shape = _DECIMAL
    else:
        shape = {"float": _FLOAT, "double": _FLOAT, "boolean": _BOOLEAN}[dtype]
    text = _col(c)
    return F.when(text.rlike(shape), text).try_cast(dtype)


def nullable_int(c: Column | str, dtype: str = "int") -> Column:
    """Blank-aware integer."""
    return to_whole(blank_to_null(c), dtype)


def nullable_float(c: Column | str) -> Column:
    """Blank-aware single-precision float."""
    return typed(blank_to_null(c), "float")


def nan_to_null(c: Column | str) -> Column:
    """NaN has no place in a keyed table: store it as NULL."""
    return F.when(~F.isnan(_col(c)), _col(c))


def parse_date(c: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    text = F.trim(_col(c))
    if pattern == "yyyy-MM-dd":
        text = F.when(text.rlike(_ISO_DAY), text)
    return F.try_to_date(text, pattern)


def repair_partial_date(
    text: Column | str,
    anchor: Column,
    gap_days: int = 7,
    partial_length: int = 7,
    pattern: str = "yyyy-MM-dd",
) -> Column:
    """Full dates are parsed; anything up to ``partial_length`` characters, blank and
    NULL included, becomes ``anchor - gap_days``. A long but malformed date is NULL."""
    is_full = F.length(F.trim(_col(text))) > partial_length
    return F.when(is_full, parse_date(text, pattern)).otherwise(F.date_sub(anchor, gap_days))
