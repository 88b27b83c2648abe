"""Column and text rules that several operators share."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.session import forget_shuffles, materialize  # noqa: F401 (operators import both from here)

#: The white space the text rules know: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, _UPPER, _UPPER.lower())


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as (id, text) with the text null-free; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: The column by which stages that drop rows tell them apart; ids may be null or repeated.
ROW_KEY = "_row_key"


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row in ROW_KEY, written to the shared folder so that every reader sees the same keys."""
    return materialize(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed_rows")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once an application, unless PYTHONPATH names its folder for them already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="dealerlens-ship-"), "dealerlens")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "dealerlens"))
    _shipped.add(app)


def shipped(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``job`` (whose first argument is the session) with the package shipped before it runs."""

    @functools.wraps(job)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return job(spark, *args)

    return run
