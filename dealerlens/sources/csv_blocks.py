"""CSV records with quoted line breaks, read by many tasks a file.

Spark's line reader splits a file at byte blocks; where a line stands inside quotes depends on all quotes before it. Each
block counts its quotes, and a prefix sum over the blocks of a file tells every block whether it begins inside quotes.
With that, each line knows whether it starts a record; lines that go on are put to their record, which may have begun in
an earlier block. Only records of several lines are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealerlens.session import ship

_LINES = "file string, block long, at long, quotes long, odd boolean, evens long, value string"


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a block in order: their number, quotes, whether an odd number of quotes stands before them in the block, and how
    many lines up to each have an even number."""
    now, at, quotes, evens = None, 0, 0, 0
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        cuts = [k for k in range(len(files)) if k == 0 or (files[k], blocks[k]) != (files[k - 1], blocks[k - 1])]
        for a, b in zip(cuts, [*cuts[1:], len(files)], strict=True):
            if (files[a], blocks[a]) != now:
                now, at, quotes, evens = (files[a], blocks[a]), 0, 0, 0
            part = batch.slice(a, b - a)
            own = pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64)
            odd = (quotes + np.cumsum(own) - own) % 2 == 1
            even_so_far = evens + np.cumsum(~odd)
            yield pa.RecordBatch.from_arrays(
                [part.column("file"), part.column("block"), pa.array(np.arange(at, at + b - a)), pa.array(own), pa.array(odd),
                 pa.array(even_so_far), part.column("value")], names=["file", "block", "at", "quotes", "odd", "evens", "value"])
            at, quotes, evens = at + b - a, quotes + int(own.sum()), int(even_so_far[-1])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (text) and ``is_first`` (of its file) of each CSV record under ``path``.

    Quotes follow RFC 4180: a field with quotes in it is quoted, and they are doubled. Line ends are LF or CR LF (kept as they
    are inside quotes); empty lines are no records. A quote that is never closed makes the rest of its file one record.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.mapInArrow(_number_lines, _LINES)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.max("evens").alias("evens"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("q").over(before), F.lit(0)), F.lit(2)) == 1
    blocks = blocks.withColumn("inside", inside).withColumn("starts", F.when(F.col("inside"), F.col("n") - F.col("evens")).otherwise(F.col("evens")))
    open_ = F.last(F.when(F.col("starts") > 0, F.struct("block", "starts")), ignorenulls=True).over(before)
    blocks = blocks.select("file", "block", "inside", open_.alias("open"))
    x = lines.join(blocks, ["file", "block"])
    nth = F.when(F.col("inside"), F.col("at") + 1 - F.col("evens")).otherwise(F.col("evens"))  # records begun in the block so far
    x = x.select("file", "block", "at", "value", (F.col("odd") == F.col("inside")).alias("starts"),
                 (F.pmod(F.col("quotes") + F.col("odd").cast("int") + F.col("inside").cast("int"), F.lit(2)) == 1).alias("goes_on"),
                 F.when(nth > 0, F.struct("block", nth.alias("starts"))).otherwise(F.col("open")).alias("of"))
    whole = x.where(F.col("starts") & ~F.col("goes_on")).select("file", "of", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = (x.where(~F.col("starts") | F.col("goes_on")).groupBy("file", "of").agg(parts.alias("parts"))
              .select("file", "of", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record")))
    return (whole.unionByName(joined)
            .select(F.regexp_replace("record", r"\r\z", "").alias("record"),
                    ((F.col("of.block") == 0) & (F.col("of.starts") == 1)).alias("is_first"))
            .where(F.col("record") != ""))
