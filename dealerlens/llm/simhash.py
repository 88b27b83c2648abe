"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is read through two blocks of 23 bits. In each block the words of the
perfect binary Golay code (4096 words, covering radius 3) are the anchors: every point lies within 3
bits of exactly one. A pair of words is an anchor point of the fingerprint; it is at home at its
nearest anchor point. If two fingerprints differ in at most t bits, the home of one lies within the covering radius
plus t of the other, the t bits shared out over the blocks. So each fingerprint is replicated to every anchor point
within the radius plus t (about 61 for t = 2), and those that meet at an anchor point, one of
them at home, are compared on all 64 bits. No linked pair is missed.

Only distinct fingerprints are replicated, so copies cost nothing. An anchor point returns a spanning
forest of its links, never all pairs, and above ``DENSE`` fingerprints it looks up each one's possible
neighbours instead of comparing all with all, so its work stays proportional to its size (times the number of
bit patterns of weight t). Components are then joined by :func:`graph.components`.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import ROW_KEY, partitions, table, with_row_key
from dealerlens.llm.graph import components
from dealerlens.session import materialize

SHINGLE = 3
MAX_BITS = 2
SEED = 42
DENSE = 4096

_BITS = 23
_RADIUS = 3
#: Fixed value: a generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
_HASHES = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while part := [digest(g, SEED) for g in itertools.islice(grams, _HASHES)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(prints.view(np.int64))], names=[*kept, "print"])

    return run


# --- anchors -----------------------------------------------------------------------------------

def _syndromes(x: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator polynomial."""
    x = x.astype(np.int64)
    for k in range(_BITS - 1, 10, -1):
        x = np.where(x >> k & 1, x ^ (_GENERATOR << (k - 11)), x)
    return x


@functools.lru_cache(maxsize=4)
def error_patterns(max_bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Every pattern of up to radius + max_bits bits, sorted by syndrome and excess over the radius; its
    excess; and for each excess e, where the patterns of a syndrome with excess <= e end (start: entry of -1, first)."""
    pats = [0]
    weights = [0]
    for w in range(1, _RADIUS + max_bits + 1):
        own = [sum(1 << b for b in c) for c in itertools.combinations(range(_BITS), w)]
        pats += own
        weights += [w] * len(own)
    pats, excess = np.array(pats, dtype=np.int64), np.maximum(np.array(weights) - _RADIUS, 0)
    of = _syndromes(pats)
    order = np.lexsort((excess, of))
    key = (of * (max_bits + 2) + excess)[order]
    bounds = [np.searchsorted(key, np.arange(2048) * (max_bits + 2) + e, side="left") for e in range(max_bits + 2)]
    return pats[order], excess[order], bounds


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that become sizes[k] rows each: the row, and the number within it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def anchors(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor point, at home) of every anchor point within reach of each unsigned fingerprint."""
    pats, excess, bounds = error_patterns(max_bits)
    mask = np.uint64((1 << _BITS) - 1)
    x1 = (prints & mask).astype(np.int64)
    x2 = (prints >> np.uint64(_BITS) & mask).astype(np.int64)
    s1, s2 = _syndromes(x1), _syndromes(x2)
    row, k = _spread(bounds[max_bits + 1][s1] - bounds[0][s1])
    p1 = bounds[0][s1[row]] + k
    left = max_bits - excess[p1]  # bits that the second block may still take
    begin = bounds[0][s2[row]]
    stop = np.stack(bounds)[left + 1, s2[row]]
    row2, k2 = _spread(stop - begin)
    p2 = begin[row2] + k2
    p1, row = p1[row2], row[row2]
    point = (x1[row] ^ pats[p1]) | ((x2[row] ^ pats[p2]) << _BITS)
    return row, point, (excess[p1] == 0) & (excess[p2] == 0)


def _replicate(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy()
            for k in range(0, len(prints), 4096):
                part = prints[k:k + 4096]
                row, point, home = anchors(part.view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(part[row]), pa.array(home)],
                                                 names=["anchor", "print", "home"])

    return run


# --- comparing at the anchors ------------------------------------------------------------------

def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links i[k]-j[k] among n nodes, (node, smallest node of its component) for the nodes that move."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _dense_links(x: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the distinct fingerprints ``x``, by looking up every neighbour of each."""
    order = np.argsort(x)
    s = x[order]
    i_all, j_all = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for w in range(1, max_bits + 1):
        for c in itertools.combinations(range(64), w):
            near = s ^ np.uint64(sum(1 << b for b in c))
            at = np.minimum(np.searchsorted(s, near), len(s) - 1)
            i = np.flatnonzero((s[at] == near) & (near > s))
            if len(i):
                i_all, j_all = np.concatenate([i_all, i]), np.concatenate([j_all, at[i]])
            if len(i_all) > 4 * len(s):
                i_all, j_all = _forest(len(s), i_all, j_all)
    i_all, j_all = _forest(len(s), i_all, j_all)
    return order[i_all], order[j_all]


def links(point: np.ndarray, prints: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows (a forest for each anchor point) of rows sorted by anchor point."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(point)) + 1, [len(point)]])
    size = np.diff(edges)
    dense = np.flatnonzero(size > DENSE)
    found_i, found_j = [], []
    for k in dense:
        a, b = edges[k], edges[k + 1]
        i, j = _dense_links(prints[a:b], max_bits)
        found_i.append(i + a)
        found_j.append(j + a)
    last = np.repeat(edges[1:], size)  # where each row's anchor point ends
    last[np.repeat(size > DENSE, size)] = 0
    rows, step = np.arange(len(point)), 1
    while len(rows := rows[rows + step < last[rows]]):
        other = rows + step
        near = (np.bitwise_count(prints[rows] ^ prints[other]) <= max_bits) & (home[rows] | home[other])
        found_i.append(rows[near])
        found_j.append(other[near])
        if sum(map(len, found_i)) > 4 * len(point):
            i, j = _forest(len(point), np.concatenate(found_i), np.concatenate(found_j))
            found_i, found_j = [i], [j]
        step += 1
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(len(point), np.concatenate(found_i), np.concatenate(found_j))


def _compare(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor point; the last one of a batch waits for the next batch."""
        held: list[pa.RecordBatch] = []

        def compared(rows: pa.Table) -> pa.RecordBatch:
            prints = rows["print"].to_numpy()
            i, j = links(rows["anchor"].to_numpy(), prints.view(np.uint64), rows["home"].to_numpy(), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(prints[i]), pa.array(prints[j])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            point = batch.column("anchor").to_numpy()
            cut = int(np.searchsorted(point, point[-1]))
            if cut:
                held.append(batch.slice(0, cut))
                yield compared(pa.Table.from_batches(held).combine_chunks())
                held = []
            elif held and held[-1].column("anchor")[-1].as_py() != point[-1]:
                yield compared(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compared(pa.Table.from_batches(held).combine_chunks())

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """(id, print) of every row, the fingerprint as a signed long, in the shared folder; with ``row_col`` also that column, as row."""
    row = [F.col(row_col).alias("row")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(rows.mapInArrow(_fingerprints(shingle), "id long, row long, print long" if row else "id long, print long"), "simhash")


def _first_of_component(prints: DataFrame, key: Column, max_bits: int) -> DataFrame:
    """(print, first): of every distinct fingerprint, the least ``key`` of its component's rows."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: the replicas grow steeply beyond")
    distinct = materialize(prints.groupBy("print").agg(F.min(key).alias("first")), "simhash_distinct")
    replicas = distinct.select("print").mapInArrow(_replicate(max_bits), "anchor long, print long, home boolean")
    met = replicas.repartition(partitions(prints.sparkSession), "anchor").sortWithinPartitions("anchor")
    edges = met.mapInArrow(_compare(max_bits), "a long, b long")
    roots = components(edges)
    groups = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "first", F.coalesce("root", "print").alias("root"))
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    return groups.join(least, "root").select("print", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Texts are lower-cased (A-Z), split at blanks and hashed by word shingles (a shorter text whole;
    without words, null included: fingerprint 0). Fingerprints at ``max_bits`` or fewer differing bits are linked;
    component_id is the smallest doc_id reachable, a null id aside (null where a component has only such). Repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    prints = fingerprints(docs, id_col, text_col, shingle)
    of_print = _first_of_component(prints, F.col("id"), max_bits)
    return prints.join(of_print, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; columns as they are. Rows of the component that
    share the kept id all stay; where all its ids are null, one row stays. Rows go one by one, each by its own key: a row with a null
    or repeated id that is linked to nothing stays, whatever happens to the others of its id."""
    keyed = with_row_key(docs)
    prints = fingerprints(keyed, id_col, text_col, shingle, ROW_KEY)
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    of_print = _first_of_component(prints, key, max_bits)
    kept = F.when(F.col("first.no_id"), F.col("row") == F.col("first.row")).otherwise(F.col("id").eqNullSafe(F.col("first.id")))
    gone = materialize(prints.join(of_print, "print").filter(~kept).select(F.col("row").alias(ROW_KEY)), "near_copies")
    return keyed.join(gone, ROW_KEY, "left_anti").drop(ROW_KEY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
