"""The fitted bundle as versions that are published whole.

A version is a folder of plain files: the trees (``model.packed``, a compressed JSON text, and ``model.json``; the first
is preferred at load), the one-hot values and scalars as JSON (``meta``), and the encoders as Parquet. Its manifest names
every file with its length and SHA-256 and is written last, under a name of its own. Readers take the newest version
whose files are as its manifest says; a version without a manifest, or damaged since, is never read.
"""

from __future__ import annotations

import base64
import json
import time
import zlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.operators import features as fe
from dealerlens.operators.boosting import BoostedTrees, BoostParams
from dealerlens.plans.training import Preprocessors, TrainedModel

#: Model formats in the order in which a reader prefers them.
FORMATS = ("packed", "json")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].rstrip("\n")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, sha256) of each data file under a version's folder; read in parallel."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return found.select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def save(trained: TrainedModel, root: str, formats: tuple[str, ...] = FORMATS) -> str:
    """Write a new version and publish it; returns its name. ``formats`` are the model's, one at least."""
    if not formats or set(formats) - set(FORMATS):
        raise ValueError(f"formats are some of {FORMATS}")
    spark, prep = trained.prep.mfr_enc.sparkSession, trained.prep
    version = f"{time.time_ns():020d}"
    folder = f"{root.rstrip('/')}/versions/{version}"
    text = trained.model.to_json()
    for kind in formats:
        packed = base64.b64encode(zlib.compress(text.encode())).decode()
        _write_text(spark, packed if kind == "packed" else text, f"{folder}/model.{kind}")
    meta = {
        "global_mean": prep.global_mean, "price_cap": prep.price_cap, "top_types": prep.top_types, "training_year": prep.training_year,
        "feature_names": prep.feature_names, "vocabulary": fe.vocabulary(prep.one_hot), "params": vars(trained.params),
    }
    _write_text(spark, json.dumps(meta), f"{folder}/meta")
    prep.mfr_enc.write.parquet(f"{folder}/manufacturer_encoder")
    prep.model_enc.write.parquet(f"{folder}/model_encoder")
    publish(spark, root, version)
    return version


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Write the manifest of a version whose files are all there: one line a file."""
    root = root.rstrip("/")
    lines = _files(spark, f"{root}/versions/{version}").select(F.lit(version).alias("version"), "*")
    lines.coalesce(1).write.json(f"{root}/manifests/{version}")


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, newest first: those with a finished manifest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "*/_SUCCESS"))
    return sorted((f.getPath().getParent().getName() for f in done or []), reverse=True)


def is_whole(spark: SparkSession, root: str, version: str) -> bool:
    """Whether the version's files are those of its manifest, byte by byte."""
    root = root.rstrip("/")
    told = spark.read.schema("name string, length long, sha256 string").json(f"{root}/manifests/{version}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return False
    found = _files(spark, f"{root}/versions/{version}")
    try:
        return told.join(found, ["name", "length", "sha256"], "left_anti").isEmpty()
    except Exception as e:  # some file systems keep checksums of their own
        if "FAILED_READ_FILE" in str(e):
            return False
        raise


def one_hot_of(spark: SparkSession, vocabulary: dict[str, list[str]]) -> PipelineModel:
    """The one-hot blocks of given values (each block's in order of the alphabet)."""
    rows = [tuple(values[k] if k < len(values) else None for values in vocabulary.values())
            for k in range(max((len(v) for v in vocabulary.values()), default=0))]
    sources = [source for source, _ in fe.ONE_HOT_BLOCKS]
    return fe.fit_one_hot(spark.createDataFrame(rows, ", ".join(f"{s} string" for s in sources)))


def load(spark: SparkSession, root: str, version: str | None = None) -> TrainedModel:
    """The newest whole version, or a given one if it is whole."""
    root = root.rstrip("/")
    for name in versions(spark, root) if version is None else [version]:
        if is_whole(spark, root, name):
            break
    else:
        raise FileNotFoundError(f"no whole version under {root}")
    folder = f"{root}/versions/{name}"
    there = {r.name.split("/")[0] for r in spark.read.schema("name string").json(f"{root}/manifests/{name}").collect()}
    kind = next(k for k in FORMATS if f"model.{k}" in there)
    text = _read_text(spark, f"{folder}/model.{kind}")
    text = zlib.decompress(base64.b64decode(text)).decode() if kind == "packed" else text
    meta = json.loads(_read_text(spark, f"{folder}/meta"))
    vocabulary = {prefix: meta["vocabulary"][prefix] for _, prefix in fe.ONE_HOT_BLOCKS}
    prep = Preprocessors(meta["global_mean"], meta["price_cap"], meta["top_types"], one_hot_of(spark, vocabulary),
                         spark.read.parquet(f"{folder}/manufacturer_encoder"), spark.read.parquet(f"{folder}/model_encoder"),
                         meta["training_year"])
    return TrainedModel(prep, BoostedTrees.from_json(text), BoostParams(**meta["params"]))
