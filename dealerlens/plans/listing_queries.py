"""Registered queries over the listings fixture: sources, cleaning,
canonicaliser steps, catalogue and encoders. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.operators import catalogue as cat
from dealerlens.operators import clean, encoders
from dealerlens.operators.canonicalize import with_steps
from dealerlens.session import materialize
from dealerlens.sources.fixtures import fixture
from dealerlens.sources.listings import scan_listings


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_listings(fixture(spark, sf_dir, "listings"))


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.canonical_listings(scanned(spark, sf_dir))


def canon_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.canonical_groups(scanned(spark, sf_dir))


def q_listings_scan(spark, sf_dir):
    return scanned(spark, sf_dir)


def q_coerced_numbers(spark, sf_dir):
    df = clean.coerce_numbers(clean.drop_missing_required(scanned(spark, sf_dir)))
    return df.select("listing_id", "price", "year", "odometer")


def q_filled_categories(spark, sf_dir):
    df = clean.fill_categories(scanned(spark, sf_dir))
    return df.select("listing_id", "manufacturer", *[c for c, _ in clean.CATEGORY_DEFAULTS])


def q_clean_listings(spark, sf_dir):
    df = clean.clean_listings(scanned(spark, sf_dir))
    return df.select("listing_id", "price", "year", "odometer", "manufacturer", "model_raw", "fuel",
                     "transmission", "drive", "type", "condition", "title_status", "cylinders")


def _steps(spark, sf_dir):
    return with_steps(clean.clean_listings(scanned(spark, sf_dir)))


def q_model_precleaned(spark, sf_dir):
    return _steps(spark, sf_dir).select("listing_id", "manufacturer", "model_raw", "model_pre")


def q_model_prefix_stripped(spark, sf_dir):
    return _steps(spark, sf_dir).select("listing_id", "manufacturer", "model_stripped")


def q_known_model_match(spark, sf_dir):
    return _steps(spark, sf_dir).select("listing_id", "manufacturer", "known_model")


def q_normalized_models(spark, sf_dir):
    return _steps(spark, sf_dir).select("listing_id", "manufacturer", "model_walk")


def q_aliased_models(spark, sf_dir):
    return _steps(spark, sf_dir).select("listing_id", "manufacturer", "model_raw", "model")


def q_cleaning_funnel(spark, sf_dir):
    return clean.cleaning_funnel(scanned(spark, sf_dir))


def q_model_counts(spark, sf_dir):
    return cat.model_counts(canon_groups(spark, sf_dir))


def q_popular_models(spark, sf_dir):
    return cat.popular_models(canon_groups(spark, sf_dir))


def q_popular_summary(spark, sf_dir):
    return cat.popular_summary(cat.popular_models(canon_groups(spark, sf_dir)))


def q_popular_sample(spark, sf_dir):
    return cat.sorted_models(cat.popular_models(canon_groups(spark, sf_dir)), cat.SAMPLE_MAKERS, 20) \
        .withColumn("position", F.col("position").cast("long"))


def q_models_for_brand(spark, sf_dir):
    return cat.sorted_models(cat.popular_models(canon_groups(spark, sf_dir))) \
        .withColumn("position", F.col("position").cast("long"))


def q_brands_models(spark, sf_dir):
    return cat.brands_models(cat.popular_models(canon_groups(spark, sf_dir))).drop("models")


def q_top_types(spark, sf_dir):
    return cat.top_types(canon(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def _catalogue_rows(spark, sf_dir):
    """The canonical listings' catalogue columns, counted and written once for the several aggregates over them."""
    kinds = ("fuel", "transmission", "drive", "type")
    return materialize(clean.canonical_groups(scanned(spark, sf_dir), kinds).select("manufacturer", "model", *kinds, "n"), "catalogue_rows")


def q_category_values(spark, sf_dir):
    c = _catalogue_rows(spark, sf_dir)
    return cat.category_values(c, cat.top_types(c)).withColumn("position", F.col("position").cast("long"))


def q_car_options(spark, sf_dir):
    c = _catalogue_rows(spark, sf_dir)
    return cat.car_options(cat.popular_models(c), c, cat.top_types(c))


def q_global_mean(spark, sf_dir):
    return encoders.global_mean(canon_groups(spark, sf_dir))


def _encoders(spark, sf_dir):
    stats = materialize(encoders.pair_stats(canon_groups(spark, sf_dir)), "pair_stats")
    gm = encoders.global_mean(stats).first()["global_mean"]
    return encoders.encoders(stats, gm)


def q_encode_manufacturer(spark, sf_dir):
    return _encoders(spark, sf_dir)[0]


def q_encode_model(spark, sf_dir):
    return _encoders(spark, sf_dir)[1]


def q_price_cap(spark, sf_dir):
    return encoders.price_cap(materialize(canon(spark, sf_dir).select("price"), "prices"))  # read three times


QUERIES = {
    name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)
}
