"""Canonical model names (N1-N6) on any DataFrame with a manufacturer and a
raw model column.

The name rules are native column expressions plus two broadcast joins against
constant dimensions (a few hundred rows, fixed by the shipped files). They run
row by row in place: no shuffle of the listings, no action while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.functions import canonical as C
from dealerlens.sources.dims import aliases_df, known_models_df



def with_steps(df: DataFrame, manufacturer: str = "manufacturer", model_raw: str = "model_raw") -> DataFrame:
    """Adds step columns row by row: ``model_pre`` (N1), ``model_stripped``
    (N2), ``known_model`` (N3), ``model_walk`` (N1-N5, before aliases) and
    ``model`` (after the alias table; may be '')."""
    spark = df.sparkSession
    if "model" in df.columns and model_raw != "model":
        df = df.drop("model")
    known = F.broadcast(known_models_df(spark))
    aliases = F.broadcast(aliases_df(spark))
    x = (
        C.prefixes_stripped(C.precleaned(df, model_raw), manufacturer)
        .join(known, F.col(manufacturer) == F.col("k_manufacturer"), "left")
        .withColumn("known_model", C.first_prefix_match("model_stripped", "known_names"))
        .drop("k_manufacturer", "known_names")
    )
    x = (
        C.walk_columns(x)
        .join(
            aliases,
            (F.col(manufacturer) == F.col("a_manufacturer")) & (F.col("model_walk") == F.col("a_alias")),
            "left",
        )
        .withColumn("model", F.coalesce(F.col("a_canonical"), F.col("model_walk")))
        .drop("a_manufacturer", "a_alias", "a_canonical")
    )
    return x


def canonicalize(df: DataFrame, manufacturer: str = "manufacturer", model_raw: str = "model_raw",
                 out: str = "model") -> DataFrame:
    """Replace/add ``out`` with the canonical model name; keeps other columns. Lazy, also on streams."""
    base = df.drop(out) if out in df.columns and out != model_raw else df
    steps = with_steps(base, manufacturer, model_raw)
    steps = steps.drop("model_pre", "model_stripped", "known_model", "model_walk")
    return steps.withColumnRenamed("model", out) if out != "model" else steps
