import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerlens.operators import stats


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 100 + [1e300, -1e300], list(range(1000))], ids=len)
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "price double")
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = stats.exact_percentile(df, "price", q, "p").first().p
        assert got is None if not values else abs(got - float(np.quantile(np.array(values, float), q))) <= 1e-9 * max(1, abs(got))


def test_only_values_around_the_quantile_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(stats, "ACCURACY", 1000)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    for q in (0.1, 0.5, 0.99):
        assert abs(stats.exact_percentile(df, "v", q, "p").first().p - q * 49_999) < 1e-6
