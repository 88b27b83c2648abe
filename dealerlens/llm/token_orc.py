"""Token ids in ORC: run-length encoded stripes, row indexes and Bloom filters on document ids.

Documents are range-dealt and sorted by id, encoded, and written as one ORC row
each (``doc_id``, ``ids``). ORC packs the ids with its integer run-length encoding; its
row indexes and the Bloom filter on ``doc_id`` let a reader skip stripes and row
groups, and Spark reads the stripes of a file in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealerlens.llm.common import keyed_text, table
from dealerlens.llm.tokens import word_tokenizer
from dealerlens.session import materialize, scratch_path

END_ID = 2
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 1000
_SCHEMA = "doc_id long, ids array<int>"


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = [x + end for x in tok.encode(part.column("text").to_pylist())]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype("int32")
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], schema=schema)

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (null text: the end id alone) to ORC files in ascending id order.

    Rows with one id (repeats, null) stay in one file, ordered by text; an empty
    table writes a file without rows; other columns are ignored.
    """
    dealt = keyed_text(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    ids = dealt.mapInArrow(_encode(tokenizer_path, end_id), _SCHEMA)
    (ids.write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).option("compression", "zstd")
        .orc(path))


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, ids); with ``doc_ids``, a pushed-down filter that stripe statistics and Bloom filters answer."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
            names=["file", "doc_id", "n_tokens", "ids_crc32"])


def document_offsets(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each row read back.

    The prefix sum has two levels: by a window over each file's rows, and over the
    files by a window with one row for each file. Rows that share an id count in order
    of length and checksum.
    """
    each = rows.select(F.input_file_name().alias("file"), "doc_id", "ids").mapInArrow(
        _digests, "file string, doc_id long, n_tokens long, ids_crc32 long")
    each = materialize(each, "token_digests")
    by_file = W.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = (each.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"))
             .select("file", F.coalesce(F.sum("n").over(by_file), F.lit(0)).alias("base")))
    in_file = W.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0))
    return (each.withColumn("before", before).join(files, "file")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "token_orc")
    write_token_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return document_offsets(read_token_orc(spark, path))
