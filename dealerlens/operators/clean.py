"""Listing cleaning (P1-P8): required fields, numeric coercion, range filters,
text normalisation, canonical model and the empty-model drop.

All steps are narrow (per-row) transformations; Catalyst pushes the
null checks down to the scan and fuses the rest into one codegen stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerlens.functions.text import strip_lower, to_number
from dealerlens.operators.canonicalize import canonicalize

REQUIRED = ("price", "year", "manufacturer", "model", "odometer")

# Defaults for missing categorical fields (before strip+lower).
CATEGORY_DEFAULTS = (
    ("fuel", "gas"),
    ("transmission", "automatic"),
    ("drive", "unknown"),
    ("type", "unknown"),
    ("condition", "unknown"),
    ("title_status", "clean"),
    ("cylinders", "unknown"),
)


@dataclass(frozen=True)
class Limits:
    """Inclusive range filters."""
    price_min: float = 1000
    price_max: float = 100000
    year_min: float = 2000
    year_max: float = 2025
    odometer_min: float = 0
    odometer_max: float = 300000


def drop_missing_required(df: DataFrame) -> DataFrame:
    """P1."""
    return df.na.drop(subset=list(REQUIRED))


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Price, year, odometer as double; unparsable text -> null."""
    return (df.withColumn("price", to_number("price"))
              .withColumn("year", to_number("year"))
              .withColumn("odometer", to_number("odometer")))


def within(c: Column, lo: float, hi: float) -> Column:
    """``lo <= c <= hi``, false for null and NaN.

    Written as "clamping does not change the value" so the (possibly
    expensive, inlined) ``c`` appears twice instead of four times once the
    filter is pushed below the projection that computes it. NaN sorts above
    every number in Spark, so it is clamped to ``hi`` and fails the test.
    """
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))) == c


def in_ranges(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """P3 + P4: drop null/NaN numbers, keep inclusive ranges."""
    return df.where(
        within(F.col("price"), limits.price_min, limits.price_max)
        & within(F.col("year"), limits.year_min, limits.year_max)
        & within(F.col("odometer"), limits.odometer_min, limits.odometer_max)
    )


def fill_categories(df: DataFrame) -> DataFrame:
    """P5 + P6: manufacturer strip+lower; defaults filled, then strip+lower."""
    out = df.withColumn("manufacturer", strip_lower("manufacturer"))
    for c, default in CATEGORY_DEFAULTS:
        out = out.withColumn(c, strip_lower(F.coalesce(F.col(c), F.lit(default))))
    return out


def clean_listings(scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """P1-P6 plus ``model_raw`` (strip+lower of the model text)."""
    df = in_ranges(coerce_numbers(drop_missing_required(scanned)), limits)
    df = fill_categories(df)
    return df.withColumn("model_raw", strip_lower("model")).drop("model")


def canonical_listings(scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cleaned rows with canonical ``model``; empty models dropped."""
    df = canonicalize(clean_listings(scanned, limits))
    return df.where(F.length("model") > 0)


def canonical_groups(scanned: DataFrame, by: tuple[str, ...] = (), limits: Limits = Limits()) -> DataFrame:
    """Cleaned listings summed up to (manufacturer, raw model, ``by``), with ``n`` and ``sum_price``, then given their canonical
    ``model``; empty models dropped. Counts and sums add up, so aggregates by model can read these rows in place of the
    listings: names that come often are canonicalised once, and names that never repeat cost one more aggregate."""
    sums = clean_listings(scanned, limits).groupBy("manufacturer", "model_raw", *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("sum_price"))
    return canonicalize(sums).where(F.length("model") > 0)


def cleaning_funnel(scanned: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """P7 + A12 in one aggregate pass over the scanned rows.

    Each row is tagged as passing the filters / having a non-empty canonical
    model; counts and distinct counts come from a single hash aggregate.
    """
    df = canonicalize(fill_categories(coerce_numbers(scanned)).withColumn("model_raw", strip_lower("model")))
    passes = F.coalesce(
        F.col("manufacturer").isNotNull() & F.col("model_raw").isNotNull()
        & within(F.col("price"), limits.price_min, limits.price_max)
        & within(F.col("year"), limits.year_min, limits.year_max)
        & within(F.col("odometer"), limits.odometer_min, limits.odometer_max), F.lit(False))
    kept = passes & (F.length("model") > 0)
    return df.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(passes).alias("filtered_rows"),
        F.count_if(kept).alias("kept_rows"),
        F.count_distinct(F.when(kept, F.col("model_raw"))).alias("models_before"),
        F.count_distinct(F.when(kept, F.col("model"))).alias("models_after"),
    )
