"""Column expressions for raw ACS cells (all JVM-side, no UDF).

``normalise_cell``  text cell -> DOUBLE following the ACS conventions:
    quotes stripped, then surrounding whitespace; ``-``, ``null`` and empty
    are null; a trailing ``-`` negates ("2,500-" is -2500); trailing ``+``/``-``
    are dropped, commas removed; anything that is not a plain decimal or
    exponent number is null (this makes ``nan``/``inf`` null too).
``is_valid_number`` the text-quality predicate used by the validity report.
``year_from_path``  the 4-digit vintage in an ``ACSDT5Y<yyyy>`` path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number as Python's float() reads it, minus the forms we refuse on purpose
# (nan / inf / digit underscores / Java's 1d, 2F suffixes).
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Python's str.strip() removes every Unicode whitespace; (?U) makes \s do so.
_EDGE_SPACE = r"(?U)^\s+|\s+$"
NULL_TOKENS = ("-", "null", "")
INVALID_TOKENS = ("-", "", "null", "N/A")
ACS_YEAR_PATTERN = r"ACSDT5Y(\d{4})"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_cell(c) -> Column:
    """Quotes off both ends, then surrounding whitespace."""
    unquoted = F.btrim(_col(c), F.lit('"'))
    return F.regexp_replace(unquoted, _EDGE_SPACE, "")


def clean_text(c) -> Column:
    """Static text cells (GEO_ID, NAME): stripped, null tokens to null."""
    s = strip_cell(c)
    return F.when(s.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(s)


def normalise_cell(c, null_sentinels: tuple[float, ...] = ()) -> Column:
    s = strip_cell(c)
    negative = s.endswith("-")
    cleaned = F.regexp_replace(F.regexp_replace(s, r"[+-]+$", ""), ",", "")
    cleaned = F.regexp_replace(cleaned, _EDGE_SPACE, "")
    number = F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double"))
    signed = F.when(negative, -number).otherwise(number)
    out = F.when(s.isin(*NULL_TOKENS) | s.isNull(), F.lit(None).cast("double")).otherwise(signed)
    if null_sentinels:
        out = F.when(out.isin(*[float(v) for v in null_sentinels]),
                     F.lit(None).cast("double")).otherwise(out)
    return out


def is_valid_number(c) -> Column:
    """True when the text is a number after removing ``,`` and ``+``."""
    s = F.regexp_replace(_col(c), _EDGE_SPACE, "")
    body = F.regexp_replace(F.regexp_replace(s, ",", ""), r"\+", "")
    body = F.regexp_replace(body, _EDGE_SPACE, "")
    return (F.when(_col(c).isNull(), F.lit(False))
            .when(s.isin(*INVALID_TOKENS), F.lit(False))
            .otherwise(body.rlike(NUMBER_PATTERN)))


def year_from_path(c, pattern: str = ACS_YEAR_PATTERN) -> Column:
    """First capture of ``pattern`` as INT, null when absent."""
    return F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit("")).cast("int")
