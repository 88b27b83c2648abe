"""Registered queries for features, training and evaluation."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from dealerlens.operators import features as fe
from dealerlens.plans import training as tr
from dealerlens.plans.listing_queries import canon


def _features(spark, sf_dir):
    c = tr.written(canon(spark, sf_dir))
    prep = tr.fit_preprocessors(c)
    return tr.transform(c, prep), prep


def q_age_features(spark, sf_dir):
    return fe.add_age(canon(spark, sf_dir)).select("listing_id", "age", "miles_per_year")


def q_ordinal_features(spark, sf_dir):
    return fe.add_ordinals(canon(spark, sf_dir)).select("listing_id", "cylinders_num", "condition_ord", "clean_title")


def q_encoded_listings(spark, sf_dir):
    x, _ = _features(spark, sf_dir)
    return x.select("listing_id", "manufacturer_encoded", "model_encoded")


def q_type_bucketed(spark, sf_dir):
    x, _ = _features(spark, sf_dir)
    return x.select("listing_id", "type", "type_clean")


def q_one_hot(spark, sf_dir):
    x, prep = _features(spark, sf_dir)
    return x.select("listing_id", fe.active_one_hot(prep.one_hot).alias("one_hot_active"),
                    fe.one_hot_sum(prep.one_hot).alias("one_hot_sum"))


def q_feature_matrix(spark, sf_dir):
    x, prep = _features(spark, sf_dir)
    m = fe.feature_matrix(x.withColumn("one_hot_active", fe.active_one_hot(prep.one_hot)), keep=("listing_id", "one_hot_active"))
    return m.select("listing_id", *fe.NUMERIC_FEATURES, "one_hot_active",
                    F.lit(len(prep.feature_names)).cast("long").alias("n_features"))


def q_split_counts(spark, sf_dir):
    return canon(spark, sf_dir).groupBy(tr.split_column().alias("split")).agg(F.count(F.lit(1)).alias("n"))


@functools.lru_cache(maxsize=2)
def _trained(spark, sf_dir):
    """The model of the library's default parameters, trained once a session for the queries that need it."""
    return tr.train(canon(spark, sf_dir))


def _held_out(spark, sf_dir):
    trained, feats = _trained(spark, sf_dir)
    return trained.model.transform(feats.where(F.col("split") == "test"))


def q_train_and_score(spark, sf_dir):
    """M2, M7: the hold-out rows with their predictions."""
    return _held_out(spark, sf_dir).select("listing_id", "price", "prediction")


def q_held_out_rows(spark, sf_dir):
    """M1, M7: which rows are held out and scored."""
    return _held_out(spark, sf_dir).select("listing_id", "price", (~F.isnan("prediction")).alias("predicted"))


def q_model_metrics(spark, sf_dir):
    return tr.regression_metrics(_held_out(spark, sf_dir))


def q_validation_curve(spark, sf_dir):
    return tr.validation_curve(_trained(spark, sf_dir)[0], spark)


def q_regression_metrics(spark, sf_dir):
    """M4/M5 on a given prediction column: the model encoding as a baseline predictor."""
    x, _ = _features(spark, sf_dir)
    return tr.regression_metrics(x, prediction="model_encoded")


def q_spot_check(spark, sf_dir):
    """M6: the rows picked, with their predictions."""
    return tr.spot_check(_held_out(spark, sf_dir))


def q_spot_check_rows(spark, sf_dir):
    """M6: which rows are picked."""
    return tr.spot_check(_held_out(spark, sf_dir)).select("listing_id", "actual", (~F.isnan("prediction")).alias("predicted"))


QUERIES = {name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)}
