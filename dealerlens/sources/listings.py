"""Listing sources (S1, S2): a CSV file or any table with the listing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealerlens.functions.text import na_to_null
from dealerlens.sources.csv_blocks import quoted_records

# The twelve listing columns the job reads.
LISTING_COLUMNS = (
    "price", "year", "manufacturer", "model", "condition",
    "cylinders", "fuel", "odometer", "title_status",
    "transmission", "drive", "type",
)


def scan_listings(df: DataFrame, key: str | None = "listing_id") -> DataFrame:
    """Column subset + NA tokens. Every column is text; numbers are parsed later."""
    cols = ([F.col(key)] if key and key in df.columns else []) + [
        na_to_null(F.col(c).cast("string")).alias(c) for c in LISTING_COLUMNS
    ]
    return df.select(*cols)


#: ``nullValue`` is one no field holds, so the NA-token rule decides what is missing, including ''.
_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""}


def read_listings_csv(spark: SparkSession, path: str, key: str | None = None, by_file: bool = False) -> DataFrame:
    """CSV files with a header line each, of the same columns; all fields are read as text, only the needed ones are kept.

    Files are read in blocks (see :func:`quoted_records`, whose rules for quotes hold). ``by_file`` reads each file in one task
    with Spark's own multi-line reader, which takes quotes in unquoted fields as they are.
    """
    header = spark.read.option("header", True).options(**_CSV).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
    if by_file:
        raw = spark.read.schema(schema).options(header=True, multiLine=True, **_CSV).csv(path)
    else:
        rows = quoted_records(spark, path).where(~F.col("is_first"))
        raw = rows.select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _CSV)
                          .alias("r")).select("r.*")
    return scan_listings(raw, key)
