"""Feature engineering (F1-F11): age, ordinals, type buckets, one-hot blocks
and the ordered feature matrix. All per-row column expressions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_YEAR = 2021

# Cylinder text -> number (anything else -> 4).
CYLINDERS = (
    ("3 cylinders", 3), ("4 cylinders", 4), ("5 cylinders", 5), ("6 cylinders", 6),
    ("8 cylinders", 8), ("10 cylinders", 10), ("12 cylinders", 12), ("other", 4), ("unknown", 4),
)
# Condition -> ordinal (anything else -> 3).
CONDITION_ORDER = (
    ("new", 6), ("like new", 5), ("excellent", 4), ("good", 3), ("fair", 2), ("salvage", 1), ("unknown", 3),
)

NUMERIC_FEATURES = (
    "odometer", "age", "miles_per_year", "cylinders_num", "condition_ord", "clean_title",
    "manufacturer_encoded", "model_encoded",
)
# One-hot blocks in matrix order: (source column, prefix).
ONE_HOT_BLOCKS = (("fuel", "fuel"), ("transmission", "trans"), ("drive", "drive"), ("type_clean", "type"))


def _lookup(pairs, c: Column, default: int) -> Column:
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default)).cast("int")


def add_age(df: DataFrame, as_of_year: int = TRAINING_YEAR) -> DataFrame:
    """Age floored at 0 and miles per year."""
    age = F.greatest(F.lit(float(as_of_year)) - F.col("year"), F.lit(0.0))
    return (df.withColumn("age", age)
              .withColumn("miles_per_year", F.col("odometer") / (F.col("age") + F.lit(1.0))))


def add_ordinals(df: DataFrame) -> DataFrame:
    """F4-F6."""
    return (df.withColumn("cylinders_num", _lookup(CYLINDERS, F.col("cylinders"), 4))
              .withColumn("condition_ord", _lookup(CONDITION_ORDER, F.col("condition"), 3))
              .withColumn("clean_title", (F.col("title_status") == "clean").cast("int")))


def bucket_types(df: DataFrame, top: list[str]) -> DataFrame:
    """types outside the fitted top list become 'other'."""
    return df.withColumn("type_clean", F.when(F.col("type").isin(*top), F.col("type")).otherwise(F.lit("other")))


def fit_one_hot(df: DataFrame) -> PipelineModel:
    """The one-hot blocks' values (in order of the alphabet), as Spark ML's own indexer and encoder: sparse vectors
    whatever the number of values; a value not seen in the fit, or null, is all zeros."""
    sources, names = [s for s, _ in ONE_HOT_BLOCKS], [p for _, p in ONE_HOT_BLOCKS]
    indexer = StringIndexer(inputCols=sources, outputCols=[f"{n}_index" for n in names], handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=[f"{n}_index" for n in names], outputCols=[f"{n}_one_hot" for n in names])
    return Pipeline(stages=[indexer, encoder]).fit(df.select(*sources))


def vocabulary(one_hot: PipelineModel) -> dict[str, list[str]]:
    """Values by block."""
    return {prefix: list(labels) for (_, prefix), labels in zip(ONE_HOT_BLOCKS, one_hot.stages[0].labelsArray, strict=True)}


def add_one_hot(df: DataFrame, one_hot: PipelineModel) -> DataFrame:
    """for each block ``<prefix>_index`` and the sparse vector ``<prefix>_one_hot``; unseen -> all 0."""
    return one_hot.transform(df)


def feature_names(one_hot: PipelineModel) -> list[str]:
    vocab = vocabulary(one_hot)
    return list(NUMERIC_FEATURES) + [f"{prefix}_{v}" for _, prefix in ONE_HOT_BLOCKS for v in vocab[prefix]]


def _known(prefix: str, one_hot: PipelineModel) -> Column:
    return F.col(f"{prefix}_index") < len(vocabulary(one_hot)[prefix])


def active_one_hot(one_hot: PipelineModel) -> Column:
    """Comma-joined names of the one-hot columns equal to 1, in matrix order."""
    return F.concat_ws(",", *[F.when(_known(prefix, one_hot), F.concat(F.lit(f"{prefix}_"), F.col(src)))
                              for src, prefix in ONE_HOT_BLOCKS])


def one_hot_sum(one_hot: PipelineModel) -> Column:
    """How many one-hot columns of a row are 1."""
    return sum((_known(prefix, one_hot).cast("long") for _, prefix in ONE_HOT_BLOCKS), F.lit(0).cast("long"))


#: The matrix in training order: columns for the vector assembler.
MATRIX_INPUTS = (*NUMERIC_FEATURES, *(f"{prefix}_one_hot" for _, prefix in ONE_HOT_BLOCKS))


def feature_matrix(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, then the numeric features as doubles and the one-hot blocks as vectors, in training order."""
    return df.select(*keep, *[F.col(n).cast("double").alias(n) for n in NUMERIC_FEATURES],
                     *[f"{prefix}_one_hot" for _, prefix in ONE_HOT_BLOCKS])


#: The category codes of a row, one for each one-hot block.
CATEGORY_CODES = tuple(f"{prefix}_index" for _, prefix in ONE_HOT_BLOCKS)


def tree_inputs(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """F11 as trees read it: ``keep`` columns, the numeric features as doubles, and each block as one code in place of its columns."""
    return df.select(*keep, *[F.col(n).cast("double").alias(n) for n in (*NUMERIC_FEATURES, *CATEGORY_CODES)])
