"""Token counts from flat token files: a block-wise scan for the end-of-document id.

The files hold nothing but little-endian unsigned 16-bit ids, one document after
another, each closed by the end id, without an index. Spark lists the files,
cuts them into blocks of equal size and hands the blocks out; a task reads its block's
byte range, finds the end ids with one vectorised comparison and returns how
many there are and where. A document may start blocks before it ends: a prefix
scan over the blocks of each file (running count of ends, position of the last
end so far) gives every block the ordinal and the start it has to go on from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealerlens.llm.common import keyed_text, partitions, table
from dealerlens.llm.tokens import word_tokenizer
from dealerlens.session import materialize, scratch_path

BLOCK_BYTES = 4 << 20
#: The tokenizer's own end-of-text id; its spelling within a text is read as ordinary text.
END_ID = 49407
#: Bytes of an id in the files: the vocabulary has fewer than 65,536 ids.
_BYTES = 2
_TYPE = "<u2"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))


def _write(tokenizer_path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        tok = word_tokenizer(tokenizer_path, special_as_text=True)
        end = np.array([end_id], dtype=_TYPE).tobytes()
        name = f"tokens-{task.partitionId():06d}.bin"
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        part, n = f"{root}/.{name}.{task.taskAttemptId()}", 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    rows = batch.slice(k, 1000)
                    for ids in tok.encode(rows.column("text").to_pylist()):
                        out.write(np.frombuffer(ids, "<u4").astype(_TYPE).tobytes() + end)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * rows.num_rows), pa.array(range(n, n + rows.num_rows), pa.int64()), rows.column("id")],
                        names=["file", "ordinal", "doc_id"])
                    n += rows.num_rows
        if store.get_file_info(f"{root}/{name}").is_file:  # of an earlier attempt; not every store moves over a file
            store.delete_file(f"{root}/{name}")
        store.move(part, f"{root}/{name}")

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as flat token files, one for each partition; return which document is which
    (file, ordinal, doc_id), written to the shared folder.

    A task writes under a name of its own and moves the file when it is whole, so a
    repeated task leaves one file. Null texts have no ids but the end id.
    """
    rows = keyed_text(docs, id_col, text_col).select("id", "text")
    return materialize(rows.mapInArrow(_write(tokenizer_path, end_id, folder), "file string, ordinal long, doc_id long"),
                       "token_manifest")


def _scan(end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"path": [], "begin": [], "ends": []}
            for path, begin, stop, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "stop", "size")), strict=True):
                store, at = _open(path)
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(stop - begin, begin), dtype=_TYPE)
                ends = np.flatnonzero(ids == end_id) + begin // _BYTES
                if stop == size and len(ids) and ids[-1] != end_id:  # the last document was never closed
                    ends = np.append(ends, stop // _BYTES)
                out["path"].append(path)
                out["begin"].append(begin)
                out["ends"].append(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["path"]), pa.array(out["begin"], pa.int64()), pa.array(out["ends"], pa.list_(pa.int64()))],
                names=["path", "begin", "ends"])

    return run


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal (from 0 within the file), start (position of the first id) and n_tokens (without the
    end id) of every document in the token files of ``folder``.

    Ids after the last end id are a document too. Files of no bytes give no row;
    bytes beyond the last whole id are ignored. A block's memory is ``block_bytes`` and 8 bytes for each document in it.
    """
    if block_bytes % _BYTES:
        raise ValueError(f"block_bytes must be a multiple of {_BYTES}")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
             .select("path", (F.col("length") - F.pmod("length", F.lit(_BYTES))).alias("size")).filter("size > 0"))
    blocks = (files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                                               F.lit(block_bytes).cast("long"))).alias("begin"))
              .withColumn("stop", F.least(F.col("begin") + block_bytes, "size"))
              .repartition(partitions(spark), "path", "begin"))
    found = blocks.mapInArrow(_scan(end_id), "path string, begin long, ends array<long>")
    before = W.partitionBy("path").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    stitched = found.select(
        "path", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0)).alias("carry"))
    starts = F.concat(F.array("carry"), F.transform("ends", lambda e: e + 1))
    docs = stitched.select("path", "base", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("start"))))
    return (docs.filter("col.end is not null")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("base") + F.col("pos")).alias("ordinal"),
                    F.col("col.start").alias("start"), (F.col("col.end") - F.col("col.start")).alias("n_tokens")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, counted in token files written from ``documents``."""
    import public_tokenizers

    folder = scratch_path(spark, "token_files")
    names = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    # both sides have a row a document: shuffled, so that neither is ever sent whole to every task
    return names.join(count_tokens(spark, folder).hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
