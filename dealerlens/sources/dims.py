"""Constant dimension tables shipped with the package (``dealerlens/data``).

The files are read on the driver and turned into small in-plan relations, so
executors never need access to the package folder. Their size is fixed by the
files (a few hundred rows), which is what makes broadcasting them safe.
"""

from __future__ import annotations

import csv
import functools
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DATA_DIR = Path(__file__).resolve().parent.parent / "data"
TRIM_WORDS_FILE = DATA_DIR / "trim_words.txt"
KNOWN_MODELS_FILE = DATA_DIR / "known_models.csv"
MODEL_ALIASES_FILE = DATA_DIR / "model_aliases.csv"


def _csv_rows(path: Path) -> list[list[str]]:
    with open(path, newline="", encoding="utf-8") as f:
        lines = [ln for ln in f if not ln.startswith("#")]
    rows = list(csv.reader(lines))
    return rows[1:]  # drop header


@functools.lru_cache(maxsize=None)
def trim_words() -> tuple[str, ...]:
    with open(TRIM_WORDS_FILE, encoding="utf-8") as f:
        return tuple(ln.rstrip("\n") for ln in f if ln.strip() and not ln.startswith("#"))


@functools.lru_cache(maxsize=None)
def known_models() -> dict[str, tuple[str, ...]]:
    """manufacturer -> known base names, longest first (first prefix hit wins)."""
    out: dict[str, list[str]] = {}
    for mfr, name in _csv_rows(KNOWN_MODELS_FILE):
        out.setdefault(mfr, []).append(name)
    return {m: tuple(sorted(v, key=len, reverse=True)) for m, v in out.items()}


@functools.lru_cache(maxsize=None)
def model_aliases() -> tuple[tuple[str, str, str], ...]:
    return tuple((m, a, c) for m, a, c in _csv_rows(MODEL_ALIASES_FILE))


KNOWN_SCHEMA = T.StructType([
    T.StructField("k_manufacturer", T.StringType(), False),
    T.StructField("known_names", T.ArrayType(T.StringType(), False), False),
])

ALIAS_SCHEMA = T.StructType([
    T.StructField("a_manufacturer", T.StringType(), False),
    T.StructField("a_alias", T.StringType(), False),
    T.StructField("a_canonical", T.StringType(), False),
])


def known_models_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, list(v)) for m, v in known_models().items()], KNOWN_SCHEMA)


def aliases_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(model_aliases()), ALIAS_SCHEMA)
