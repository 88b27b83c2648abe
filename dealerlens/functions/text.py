"""String and number helpers that reproduce Python/pandas text semantics
with native Spark expressions (no UDFs).

Python's ``str.strip``/``split`` and regex ``\\s`` use Unicode whitespace plus
the four ASCII separators 0x1C-0x1F; Java's ``\\s`` is ASCII-only unless the
``(?U)`` flag is set, and Spark's ``trim`` removes spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python whitespace as a Java character class (use under the (?U) flag).
PY_WS = r"[\s\x1c-\x1f]"
# The same set as plain characters, by Python's own rule (str.isspace).
PY_WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# The strings pandas 2.x read_csv turns into missing values by
# default (exact match, no trimming).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# A decimal number with optional sign, fraction and exponent, as text.
NUMBER_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_RE = r"^\s*[+-]?[0-9]+\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: ``btrim`` over the whitespace set, only for the rows
    whose first or last character is whitespace (two hash-set probes)."""
    c = col(c)
    edge = F.substring(c, 1, 1).isin(*PY_WS_CHARS) | F.substring(c, -1, 1).isin(*PY_WS_CHARS)
    return F.when(edge, F.btrim(c, F.lit(PY_WS_CHARS))).otherwise(c)


def strip_lower(c: Column | str) -> Column:
    """``str.strip().lower()``."""
    return F.lower(py_strip(c))


def na_to_null(c: Column | str) -> Column:
    """pandas' default NA strings become null, as ``read_csv`` does."""
    c = col(c)
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def to_number(c: Column | str) -> Column:
    """``pd.to_numeric(errors='coerce')`` for text: a decimal literal or null.

    The regex guard keeps out what a bare ``try_cast`` would accept but pandas
    would not (``12d``, hex floats). ``inf``/``nan`` text also becomes null.
    """
    c = col(c)
    return F.when(c.rlike(NUMBER_RE), F.trim(c).try_cast("double"))


def py_split(c: Column | str) -> Column:
    """``str.split()``: runs of whitespace, no empty tokens."""
    return F.filter(F.split(col(c), rf"(?U){PY_WS}+"), lambda t: t != "")
