"""Smoothed target encoders, global mean and price cap.

One partial+final hash aggregate at (manufacturer, model) level; the
manufacturer encoder and the grand mean are re-aggregations of that small
result (sums and counts add up), so the listings are scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.operators.stats import exact_percentile

SMOOTHING = 50
PRICE_CAP_QUANTILE = 0.99


def pair_stats(canon: DataFrame, target: str = "price") -> DataFrame:
    """Price sums and counts by pair, of listings or of rows that already hold such sums."""
    summed = "sum_price" in canon.columns
    return canon.groupBy("manufacturer", "model").agg(
        F.sum("sum_price" if summed else target).alias("sum_price"), (F.sum("n") if summed else F.count(F.lit(1))).alias("n"))


def global_mean(canon_or_stats: DataFrame, target: str = "price") -> DataFrame:
    """One row (global_mean, n)."""
    if "sum_price" in canon_or_stats.columns:
        s = canon_or_stats.agg(F.sum("sum_price").alias("s"), F.sum("n").alias("n"))
    else:
        s = canon_or_stats.agg(F.sum(target).alias("s"), F.count(F.lit(1)).alias("n"))
    return s.select((F.col("s") / F.col("n")).alias("global_mean"), F.col("n"))


def _smooth(mean: F.Column, n: F.Column, gm: F.Column, smoothing: float) -> F.Column:
    w = n / (n + F.lit(float(smoothing)))
    return w * mean + (F.lit(1.0) - w) * gm


def encoders(stats: DataFrame, gm: float, smoothing: float = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """A10: (manufacturer encoder, model encoder) as DataFrames.

    ``gm`` is the fitted grand mean (a scalar of the bundle).
    """
    g = F.lit(float(gm))
    model_enc = stats.select(
        "manufacturer", "model", "n",
        (F.col("sum_price") / F.col("n")).alias("mean_price"),
    ).withColumn("encoding", _smooth(F.col("mean_price"), F.col("n"), g, smoothing))
    mfr_enc = (
        stats.groupBy("manufacturer").agg(F.sum("sum_price").alias("s"), F.sum("n").alias("n"))
        .select("manufacturer", "n", (F.col("s") / F.col("n")).alias("mean_price"))
        .withColumn("encoding", _smooth(F.col("mean_price"), F.col("n"), g, smoothing))
    )
    return mfr_enc, model_enc


def price_cap(canon: DataFrame, q: float = PRICE_CAP_QUANTILE) -> DataFrame:
    """Exact 99th percentile of price, one row ``price_cap``."""
    return exact_percentile(canon, "price", q, alias="price_cap")


def apply_encoders(df: DataFrame, mfr_enc: DataFrame, model_enc: DataFrame, gm: float) -> DataFrame:
    """F8: left joins on the fitted tables; a missing key gets the grand mean.

    The encoder tables have one row per key; AQE turns these into broadcast
    joins when their measured size is under the broadcast threshold and keeps
    a (skew-split) shuffle join otherwise.
    """
    m = mfr_enc.select(F.col("manufacturer").alias("_em"), F.col("encoding").alias("_me"))
    p = model_enc.select(F.col("manufacturer").alias("_pm"), F.col("model").alias("_pmodel"),
                         F.col("encoding").alias("_pe"))
    out = df.join(m, df["manufacturer"] == m["_em"], "left")
    out = out.join(p, (out["manufacturer"] == p["_pm"]) & (out["model"] == p["_pmodel"]), "left")
    g = F.lit(float(gm))
    return (out.withColumn("manufacturer_encoded", F.coalesce(F.col("_me"), g))
               .withColumn("model_encoded", F.coalesce(F.col("_pe"), g))
               .drop("_em", "_me", "_pm", "_pmodel", "_pe"))
