"""Exact order statistics without gathering rows, or all distinct values, in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: the quantile's rank lies within a share of 1 / ACCURACY of the rows.
ACCURACY = 100_000


def exact_percentile(df: DataFrame, column: str, q: float, alias: str = "value") -> DataFrame:
    """One-row DataFrame with the exact ``q``-quantile (linear interpolation,
    as pandas ``quantile`` and DuckDB ``quantile_cont``); null without values.

    Distributed selection: a mergeable sketch gives two values between which the quantile's ranks must lie; rows below are
    only counted, rows between them (some hundred-thousandths) are reduced to (value, count), and the two ranks are found in that.
    """
    x = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    near = 2 / ACCURACY
    shares = F.array(F.lit(max(q - near, 0.0)), F.lit(min(q + near, 1.0)))
    told = x.agg(F.percentile_approx("v", shares, F.lit(ACCURACY)).alias("p"), F.count("v").alias("n"))
    low = F.lit(None) if q <= near else told.select(F.col("p")[0]).scalar()  # at the ends all values on that side count
    high = F.lit(None) if q >= 1 - near else told.select(F.col("p")[1]).scalar()
    place = F.when(F.col("v") < low, -1).when(F.col("v") > high, 1).otherwise(0)
    # each side outside is one row of the histogram, which stands for its value next to the range (an upper rank may lie one beyond)
    value = F.when(place == 0, F.col("v"))
    hist = (x.groupBy(place.alias("place"), value.alias("between")).agg(F.count(F.lit(1)).alias("freq"), F.min("v").alias("least"), F.max("v").alias("most"))
            .select("place", "freq", F.when(F.col("place") < 0, F.col("most")).otherwise(F.col("least")).alias("v")))
    ordered = Window.orderBy("place", "v")
    upto = F.sum("freq").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.sum("freq").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    position = F.lit(q) * (F.col("n") - 1)

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col("freq") <= rank) & (rank < F.col("upto")), F.col("v")))

    found = hist.withColumn("upto", upto).withColumn("n", n).withColumn("at", position)
    found = found.agg(F.max("at").alias("at"), at(F.floor("at")).alias("lower"), at(F.ceil("at")).alias("upper"))
    share = F.col("at") - F.floor("at")
    return found.select(F.when(F.col("lower") == F.col("upper"), F.col("lower"))
                        .otherwise((1 - share) * F.col("lower") + share * F.col("upper")).alias(alias))
