"""Line deduplication with a sharded minimal perfect hash over the corpus's line hashes.

1. Every document gives its distinct line hashes (128 bits each): a table of 24 bytes a line.
2. An aggregate with map-side combining finds, for each hash, its smallest and largest document and row count.
3. The hashes are dealt to shards of about ``SHARD_KEYS``. Each shard becomes one row: a minimal
   perfect hash (a cascade of bit arrays) and, by its slots, an array of 32-bit fingerprints, an array
   of counts (1, or 2 for "two or more documents") and the keeping document of each shared line.
4. The documents' hashes are dealt to the same shards and probe the arrays as a stream: a
   task holds one shard's arrays, whatever the number of probes. No line text is joined or shuffled.
5. Documents drop the lines that the answers name.

Skew: a line in more than ``HOT_ROWS`` documents and in more than one of ``HOT_KEYS`` of all
rows sends no probes. There are at most HOT_KEYS such lines (2 MB), so each task knows them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import partitions, table
from dealerlens.session import materialize

MIN_CHARS = 10
SHARD_KEYS = 50_000
HOT_ROWS = 10_000
HOT_KEYS = 65_536

_BLANKS = " \t\n\x0b\x0c\r"
_SEEDS = (42, 1042)
_NO_ID = (1 << 63) - 1
_GAMMA = 1.5
_SHARD = "shard long, level_sizes array<long>, bits binary, prints binary, counts binary, keepers binary"
_SHARD_COLUMNS = [c.split()[0] for c in _SHARD.split(", ")]


def line_key(line: str) -> str:
    """A line without blanks at its ends, A-Z lower-cased."""
    return line.strip(_BLANKS).encode().lower().decode()


def line_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key as two signed longs; None for a short key."""
    bare = line.strip(_BLANKS)
    if len(bare) < min_chars:
        return None
    key = bare.encode().lower()
    a, b = (xxhash.xxh64_intdigest(key, s) for s in _SEEDS)
    return a - ((a >> 63) << 64), b - ((b >> 63) << 64)


# --- the minimal perfect hash ------------------------------------------------------------------

def _positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where a level's bit array holds each key: a 64-bit finaliser over both halves and the level."""
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(2 * level + 1) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_levels(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Bit arrays: keys alone at their position settle there, the others go on to the next level."""
    levels: list[np.ndarray] = []
    while len(h1):
        size = max(8, int(_GAMMA * len(h1)))
        at = _positions(h1, h2, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        left = ~bits[at]
        h1, h2 = h1[left], h2[left]
    return levels


def slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Each key's slot (0 to the number of keys, each once, for the keys built from); -1 if no level holds it."""
    out, todo, base = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1)), 0
    for k, bits in enumerate(levels):
        at = _positions(h1[todo], h2[todo], k, len(bits))
        rank = np.cumsum(bits) - 1 + base
        here = bits[at]
        out[todo[here]] = rank[at[here]]
        todo, base = todo[~here], base + int(bits.sum())
        if not len(todo):
            break
    return out


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    levels = build_levels(h1, h2)
    slot = slots(levels, h1, h2)
    prints, counts, keepers = (np.zeros(len(h1), t) for t in ("<u4", "u1", "<i8"))
    prints[slot] = (h2 >> np.uint64(32)).astype("<u4")
    counts[slot] = np.where(rows["first"] != rows["last"], 2, 1)
    keepers[slot] = rows["first"].to_numpy(np.int64)
    bits = np.packbits(np.concatenate(levels)).tobytes()
    return pd.DataFrame([(key[0], [len(b) for b in levels], bits, prints.tobytes(), counts.tobytes(),
                          keepers[counts > 1].tobytes())], columns=_SHARD_COLUMNS)


class Shard:
    """A shard's arrays, read for probing."""

    def __init__(self, level_sizes: list[int], bits: bytes, prints: bytes, counts: bytes, keepers: bytes):
        flat = np.unpackbits(np.frombuffer(bits, np.uint8))[:sum(level_sizes)].astype(bool)
        self.levels = np.split(flat, np.cumsum(level_sizes)[:-1])
        self.prints, self.counts = np.frombuffer(prints, "<u4"), np.frombuffer(counts, "u1")
        self.keepers = np.zeros(len(self.counts), "<i8")
        self.keepers[self.counts > 1] = np.frombuffer(keepers, "<i8")

    def dropped(self, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether document ids[k] loses its line with hash (h1[k], h2[k])."""
        slot = slots(self.levels, h1, h2)
        known = (slot >= 0) & (self.prints[slot] == (h2 >> np.uint64(32)).astype("<u4"))
        return known & (self.counts[slot] > 1) & (self.keepers[slot] != ids)


# --- the jobs ----------------------------------------------------------------------------------

def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {line_hash(x, min_chars) for x in text.split("\n")}
                own.discard(None)
                ids += [id_] * len(own)
                found += own
            h1, h2 = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, h1, h2)], names=["id", "h1", "h2"])

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, each shard's arrays before its probes."""
    shard = None
    for batch in batches:
        of = batch.column("shard").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if part.num_rows and part.column("bits")[0].is_valid:
                shard = Shard(*(part.column(c)[0].as_py() for c in ("level_sizes", "bits", "prints", "counts", "keepers")))
                part = part.slice(1)
            if not part.num_rows:
                continue
            ids, h1, h2 = (part.column(c).to_numpy() for c in ("id", "h1", "h2"))
            hit = shard.dropped(ids, h1.view(np.uint64), h2.view(np.uint64))
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (ids, h1, h2)], names=["id", "h1", "h2"])


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, h1, h2) for each document and each of its line hashes, once, in the shared folder. A null id reads as the largest."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_line_hashes(min_chars), "id long, h1 long, h2 long"), "line_hashes")


def build_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, dict[tuple[int, int], int]]:
    """The shard rows, their number, and the hot lines with their keeping document (at most ``HOT_KEYS``)."""
    distinct = materialize(lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"),
                                                          F.count("*").alias("n")), "distinct_lines")
    keys, rows = distinct.agg(F.count("*"), F.sum("n")).first()
    shards = max(1, -(-keys // shard_keys))
    hot = distinct.filter((F.col("n") > HOT_ROWS) & (F.col("n") > (rows or 0) // HOT_KEYS) & (F.col("first") != F.col("last")))
    hot = {(r.h1, r.h2): r.first for r in hot.select("h1", "h2", "first").collect()}
    arrays = distinct.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(_build_shard, _SHARD)
    return arrays, shards, hot


def dropped_lines(lines: DataFrame, arrays: DataFrame, shards: int, hot: dict[tuple[int, int], int]) -> DataFrame:
    """(id, h1, h2) of the lines that documents lose, hot lines aside."""
    spark = lines.sparkSession
    hot_of = spark.sparkContext.broadcast(frozenset(hot))

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot_of.value
        for batch in batches:
            keep = [k not in known for k in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    probes = lines.mapInArrow(cold, lines.schema) if hot else lines
    probes = probes.withColumn("shard", F.pmod("h1", F.lit(shards)))
    both = arrays.unionByName(probes, allowMissingColumns=True)
    dealt = both.repartition(max(partitions(spark), 1), "shard").sortWithinPartitions("shard", F.col("bits").isNull())
    return dealt.mapInArrow(_probe, "id long, h1 long, h2 long")


def _rewrite(min_chars: int, hot_of):
    @F.pandas_udf("n_lines long, n_dropped long, text string")
    def rewrite(ids: pd.Series, texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        hot, out = hot_of.value, []
        for id_, text, a, b in zip(ids, texts, h1, h2, strict=True):
            drop = set(zip(a.tolist(), b.tolist(), strict=True)) if a is not None else set()
            lines = text.split("\n")
            kept = [x for x in lines
                    if (h := line_hash(x, min_chars)) is None or not (h in drop or hot.get(h, id_) != id_)]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])

    return rewrite


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with the lines removed that a document of smaller id holds, and with n_lines and n_dropped.

    Lines are what stands between line feeds; two are the same if their keys are
    (blanks at the ends stripped, A-Z lower-cased); keys under ``min_chars`` code points are never dropped. Where
    keys occur in two or more documents, all their lines go but those of the smallest id; repeats within one
    document stay there. A null or empty text is one empty line. Rows that share an id are one document, each
    row losing the same lines; a null id counts as the largest. An empty table gives an empty
    result. Other columns pass through; ones named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    lines = line_hashes(docs, id_col, text_col, min_chars)
    arrays, shards, hot = build_index(lines, shard_keys)
    drops = (dropped_lines(lines, arrays, shards, hot).groupBy("id")
             .agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2")))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"))
    rewrite = _rewrite(min_chars, spark.sparkContext.broadcast(hot))
    new = own.join(drops, "id", "left").withColumn(
        "new", rewrite("id", F.coalesce(F.col("row")[text_col], F.lit("")), "h1", "h2"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return new.select(*others, F.col("new.text").alias(text_col), "new.n_lines", "new.n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING min(doc_id) <> max(doc_id)),
judged AS (
  SELECT k.doc_id, k.line, k.pos, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
