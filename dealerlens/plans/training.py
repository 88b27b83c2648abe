"""Training batch (E1): canonical listings -> fitted preprocessors ->
feature matrix -> boosted trees -> metrics.

Fitted tables (encoders) stay DataFrames written under the shared folder; scalars and the one-hot
labels that Spark ML's indexer keeps reach the driver. Bundles are saved and loaded by :mod:`dealerlens.plans.bundle`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.operators import boosting
from dealerlens.operators import catalogue as cat
from dealerlens.operators import encoders as enc
from dealerlens.operators import features as fe
from dealerlens.operators.boosting import BoostedTrees, BoostParams
from dealerlens.session import materialize

TEST_FRACTION = 0.15
SPLIT_SEED = 42


@dataclass
class Preprocessors:
    global_mean: float
    price_cap: float
    top_types: list[str]
    one_hot: PipelineModel
    mfr_enc: DataFrame
    model_enc: DataFrame
    training_year: int = fe.TRAINING_YEAR

    @property
    def feature_names(self) -> list[str]:
        return fe.feature_names(self.one_hot)


def written(canon: DataFrame) -> DataFrame:
    """The canonical listings, written once: the fit runs several aggregates over them and the features are built from them."""
    return materialize(canon, "canonical_listings")


def fit_preprocessors(canon: DataFrame) -> Preprocessors:
    """A9-A11, A8 and the one-hot blocks, fitted on the rows given (see :func:`written`)."""
    stats = materialize(enc.pair_stats(canon), "pair_stats")
    gm = float(enc.global_mean(stats).first()["global_mean"])
    mfr_enc, model_enc = (materialize(e, "encoder") for e in enc.encoders(stats, gm))
    cap = float(enc.price_cap(canon).first()["price_cap"])
    top = [r["type"] for r in cat.top_types(canon).collect()]  # at most TOP_TYPES rows
    return Preprocessors(gm, cap, top, fe.fit_one_hot(fe.bucket_types(canon, top)), mfr_enc, model_enc)


def transform(df: DataFrame, prep: Preprocessors, as_of_year: int | None = None) -> DataFrame:
    """F1-F10 on canonical rows (training or requests).

    A ``clean_title`` column already present (requests resolve it from the
    body) is kept; otherwise it is derived from ``title_status``.
    """
    year = prep.training_year if as_of_year is None else as_of_year
    given = df.withColumnRenamed("clean_title", "_ct_given") if "clean_title" in df.columns else None
    x = fe.add_ordinals(fe.add_age(given if given is not None else df, year))
    if given is not None:
        x = x.withColumn("clean_title", F.col("_ct_given")).drop("_ct_given")
    x = enc.apply_encoders(x, prep.mfr_enc, prep.model_enc, prep.global_mean)
    x = fe.bucket_types(x, prep.top_types)
    return fe.add_one_hot(x, prep.one_hot)


def split_column(key: str = "listing_id", test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED):
    """M1: deterministic hash split (stable under repartitioning and retries): the first 32 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10000))
    return F.when(bucket < int(round(test_fraction * 10000)), F.lit("test")).otherwise(F.lit("train"))


@dataclass
class TrainedModel:
    prep: Preprocessors
    model: BoostedTrees
    params: BoostParams


def train(canon: DataFrame, params: BoostParams = BoostParams(), key: str = "listing_id",
          fit_on: str = "all") -> tuple[TrainedModel, DataFrame]:
    """Fit preprocessors and the regressor; returns the model and the materialised feature table with a ``split`` column.

    ``fit_on="all"`` fits encoders, cap and one-hot blocks on every row, as the original does (hold-out rows take part);
    ``"train"`` fits them on the training rows only.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    canon = written(canon.withColumn("split", split_column(key)))
    prep = fit_preprocessors(canon if fit_on == "all" else canon.where(F.col("split") == "train"))
    feats = materialize(fe.tree_inputs(transform(canon, prep), keep=(key, "price", "split")), "features")
    values = fe.vocabulary(prep.one_hot)
    categories = {f"{prefix}_index": len(values[prefix]) for _, prefix in fe.ONE_HOT_BLOCKS}
    model = boosting.fit(feats, list(fe.NUMERIC_FEATURES), categories, key=key, params=params)
    return TrainedModel(prep, model, params), feats


def validation_curve(trained: TrainedModel, spark: SparkSession) -> DataFrame:
    """M3: (n_trees, rmse) of the ensemble's first n trees on the hold-out rows, kept while the trees grew."""
    return spark.createDataFrame(trained.model.curve, "n_trees int, rmse double")


def regression_metrics(scored: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    """M4/M5: n, MAE and R^2 from one aggregate (no collect of rows)."""
    y, p = F.col(label), F.col(prediction)
    agg = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("var_y"),
    )
    sst = F.col("var_y") * F.col("n")  # var_pop merges partials stably
    return agg.select("n", "mae", (F.lit(1.0) - F.col("sse") / sst).alias("r2"))


def spot_check(scored: DataFrame, key: str = "listing_id", k: int = 10, seed: int = 1) -> DataFrame:
    """M6: k seeded pseudo-random rows (top-k on a hash: TakeOrdered, no full sort)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return (scored.withColumn("_h", digest).orderBy("_h", key).limit(k)
                  .select(key, F.col("price").alias("actual"), "prediction"))
