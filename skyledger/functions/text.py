"""Text cleaning: codes, flight numbers, categorical labels, route strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference rules).
FLIGHT_NUMBER_PATTERN = r"^[A-Z]{2,3}[0-9]{1,4}$"
UNKNOWN = "Unknown"
ROUTE_SEPARATOR = " → "

# Blanks removed by Python's str.strip(): Unicode white space, separators and \x1c-\x1f.
_EDGE_BLANKS = r"^[\s\p{Z}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{1C}-\x{1F}\x{85}]+$"

_NOT_BLANK = r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c) -> Column:
    """Remove leading/trailing Unicode blanks (Spark's trim only removes ASCII spaces)."""
    return F.regexp_replace(_c(c).cast("string"), _EDGE_BLANKS, "")


def clean_code(c) -> Column:
    """Trim and upper-case an airline / airport / flight code; NULL stays NULL."""
    return F.upper(strip_blanks(c))


def is_valid_flight_number(c) -> Column:
    """Upper-cased, trimmed flight number matches carrier + 1-4 digits; NULL never matches."""
    return F.coalesce(clean_code(c).rlike(FLIGHT_NUMBER_PATTERN), F.lit(False))


def category(c) -> Column:
    """Categorical feature value as text with NULL -> 'Unknown'."""
    return F.coalesce(_c(c).cast("string"), F.lit(UNKNOWN))


def route_label(origin, destination) -> Column:
    return F.concat(F.coalesce(_c(origin).cast("string"), F.lit(UNKNOWN)), F.lit(ROUTE_SEPARATOR),
                    F.coalesce(_c(destination).cast("string"), F.lit(UNKNOWN)))


def blank_to_null(c) -> Column:
    """Empty or blank text -> NULL (API fields treat '' as missing): one look for a character that is no blank."""
    c = _c(c)
    return F.when(c.cast("string").rlike(_NOT_BLANK), c)
