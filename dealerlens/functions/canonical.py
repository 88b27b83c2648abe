"""Model-name canonicaliser as native column expressions.

Steps (applied to a stripped, lower-cased raw model and a cleaned
manufacturer):

1. pre-clean: drop ``(...)`` groups (shortest match), the characters
   ``* # @ ! $ % & / \\``, and a leading 4-digit year followed by whitespace;
2. brand-specific prefix stripping;
3. known base model: the longest known name of the manufacturer that is a
   plain string prefix is the answer (needs the known-models dimension);
4. otherwise tokenise; a 4-digit first token is a year and is dropped;
5. token walk: token 1 is kept as is; tokens 2 and 3 are cleaned to
   ``[a-z0-9-]`` and classified STOP / NUM / ALPHA, giving ``t1``,
   ``t1 c2`` or ``t1 c2 c3``;
6. alias lookup on (manufacturer, name), one pass (needs the alias dimension).

Steps 3 and 6 are joins and live in :mod:`dealerlens.operators.canonicalize`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerlens.functions.text import PY_WS, col, py_strip
from dealerlens.sources.dims import trim_words

STOP, NUM, ALPHA = 0, 1, 2

# Brand-specific prefixes removed before matching, in order.
# (manufacturer, pattern); every pattern is anchored at the start.
BRAND_PREFIXES = (
    ("mercedes-benz", rf"^benz{PY_WS}+"),
    ("mercedes-benz", rf"^mercedes-amg{PY_WS}*"),
    ("mercedes-benz", rf"^[a-z]{{1,3}}-class{PY_WS}*"),
    ("ford", rf"^super{PY_WS}+duty{PY_WS}+"),
    ("ram", rf"^all-new{PY_WS}+"),
    ("alfa-romeo", rf"^romeo{PY_WS}*"),
    ("rover", rf"^rover{PY_WS}+"),
    ("harley-davidson", rf"^davidson{PY_WS}*"),
    ("mini", rf"^cooper{PY_WS}+"),
)
ANY_BRAND_PREFIX = rf"^lifted{PY_WS}+"


def _re(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, "")


def _staged(df: DataFrame, out: str, steps) -> DataFrame:
    """Column ``out`` by steps that each read ``out``: a column of its own each, so no step repeats the ones before."""
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return df


def _without_groups(s: Column) -> Column:
    # (?d): '.' stops only at \n, as in Python
    return F.when(F.contains(s, F.lit("(")), F.regexp_replace(s, r"(?d)\(.*?\)", "")).otherwise(s)


def precleaned(df: DataFrame, model_raw: str, out: str = "model_pre") -> DataFrame:
    """Step 1; '' when nothing is left."""
    return _staged(df.withColumn(out, F.col(model_raw)), out, (
        lambda s: F.lower(py_strip(s)),
        lambda s: _re(F.regexp_replace(_without_groups(s), r"[*#@!$%&/\\]", ""), rf"^\d{{4}}{PY_WS}+"),
        py_strip))


def prefixes_stripped(df: DataFrame, manufacturer: str, source: str = "model_pre", out: str = "model_stripped") -> DataFrame:
    """Step 2 on the pre-cleaned text."""
    return _staged(df.withColumn(out, F.col(source)), out, (
        lambda s: F.when(F.startswith(s, F.lit("lifted")), _re(s, ANY_BRAND_PREFIX)).otherwise(s),
        lambda s: _strip_brand(manufacturer, s),
        py_strip))


def _strip_brand(manufacturer: Column | str, s: Column) -> Column:
    m = col(manufacturer)
    by_brand: dict[str, list[str]] = {}
    for brand, pat in BRAND_PREFIXES:
        by_brand.setdefault(brand, []).append(pat)
    out = None
    for brand, pats in by_brand.items():
        t = s
        for p in pats:
            t = _re(t, p)
        out = (F.when(m == brand, t) if out is None else out.when(m == brand, t))
    return out.otherwise(s)


def clean_token(tok: Column) -> Column:
    return F.regexp_replace(tok, r"[^a-z0-9\-]", "")


def token_class(c: Column) -> Column:
    """STOP / NUM / ALPHA for a cleaned token (null = no token = STOP)."""
    return (
        F.when(c.isNull() | (c == ""), F.lit(STOP))
        .when(c.isin(*trim_words()), F.lit(STOP))
        .when(c.rlike(r"^[0-9]{5,}$"), F.lit(STOP))
        .when(c.rlike(r"^[0-9]+$") | c.rlike(r"^[a-z]?[0-9]{2,4}$"), F.lit(NUM))
        .when(c.contains("-") & c.rlike(r"[0-9]"), F.lit(NUM))
        .when(c.rlike(r"^[a-z]{1,6}$"), F.lit(ALPHA))
        .otherwise(F.lit(STOP))
    )


def tokens_without_year(s: Column | str) -> Column:
    """Step 4: whitespace tokens of a stripped string, a leading 4-digit token removed."""
    s = col(s)
    toks = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, rf"(?U){PY_WS}+"))
    return F.when(
        F.try_element_at(toks, F.lit(1)).rlike(r"(?U)^\d{4}$"), F.slice(toks, 2, 1 << 30)
    ).otherwise(toks)


def walk_columns(df, stripped: str = "model_stripped", known: str = "known_model", out: str = "model_walk"):
    """Step 5 in closed form over the first three tokens ('' if none).

    Each intermediate is its own projected column, so Catalyst evaluates the
    split, the token cleaning and the classification once per row instead of
    once per reference inside the final CASE.
    """
    x = df.withColumn("_toks", F.when(F.col(known).isNull(), tokens_without_year(stripped)))  # known names need no tokens
    x = (x.withColumn("_t1", F.try_element_at(F.col("_toks"), F.lit(1)))
          .withColumn("_c2", clean_token(F.try_element_at(F.col("_toks"), F.lit(2))))
          .withColumn("_c3", clean_token(F.try_element_at(F.col("_toks"), F.lit(3)))))
    x = x.withColumn("_k2", token_class(F.col("_c2"))).withColumn("_k3", token_class(F.col("_c3")))
    t1, c2, c3, k2, k3 = (F.col(c) for c in ("_t1", "_c2", "_c3", "_k2", "_k3"))
    walk = (
        F.when(F.col(stripped) == "", F.lit(""))
        .when(F.col(known).isNotNull(), F.col(known))
        .when(t1.isNull(), F.lit(""))
        .when(k2 == STOP, t1)
        .when(k2 == NUM, F.concat_ws(" ", t1, c2))
        .when(k3 == STOP, F.concat_ws(" ", t1, c2))
        .otherwise(F.concat_ws(" ", t1, c2, c3))
    )
    return x.withColumn(out, walk).drop("_toks", "_t1", "_c2", "_c3", "_k2", "_k3")


def first_prefix_match(s: Column | str, known_names: Column | str) -> Column:
    """Step 3: first (= longest, the array is sorted) known name that prefixes ``s``."""
    arr = F.coalesce(col(known_names), F.array().cast("array<string>"))
    return F.try_element_at(F.filter(arr, lambda k: F.startswith(col(s), k)), F.lit(1))
