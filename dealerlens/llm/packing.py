"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups.

Documents become ids by the tokenizer, plus an end id. Whole blocks of
``capacity`` ids are sequences of their own; what is left of each document goes
to a random group of about ``GROUP_ROWS`` remainders, and each group is packed on
its own: longest first, each into the first sequence with room, which a
tournament tree over the free room finds in logarithmic time. Then the emptiest
sequences of the group are cut up to fill gaps of more than ``MIN_GAP`` ids, so that
copies of an awkward length (2100 of 4096, say) leave no padding either.

Memory of a task: one group, about GROUP_ROWS x capacity ids at most, whatever the documents' length; full blocks
stream past it. The group of a remainder is a hash of its row, not of its id or text, so copies spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from dealerlens.llm.common import keyed_text, partitions, table
from dealerlens.llm.tokens import word_tokenizer

CAPACITY = 4096
END_ID = 2
GROUP_ROWS = 4096
MIN_GAP = 32
#: A worker tokenises, and hands on, so many rows and bytes of text at once.
PART_ROWS = 1000
PART_BYTES = 8 << 20
#: Full blocks are dealt over so many slots.
FULL_SLOTS = 1 << 20

_BLOCKS = StructType([StructField(c, LongType()) for c in ("row", "id", "start", "length", "doc_tokens")]
                     + [StructField("ids", BinaryType())])
_PIECES = StructType([StructField(c, LongType()) for c in
                      ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                     + [StructField("ids", BinaryType())])


class RoomTree:
    """A tournament tree over bins: each inner node knows the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * self.leaves + [capacity] * bins + [0] * (self.leaves - bins)
        for k in range(self.leaves - 1, 0, -1):
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])

    def place(self, length: int) -> int:
        """The first bin with room for ``length``, which is taken from it."""
        room, k = self.room, 1
        while k < self.leaves:
            k = 2 * k if room[2 * k] >= length else 2 * k + 1
        bin_, room[k] = k - self.leaves, room[k] - length
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each at most ``capacity``) by bin, in order of placing."""
    tree, bins = RoomTree(max(1, len(lengths)), capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = tree.place(lengths[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int, min_gap: int) -> list[list[tuple[int, int, int]]]:
    """Cut up the emptiest bins to fill gaps over ``min_gap``. A piece is (item, start, length)."""
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (used[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        gap = capacity - used[order[high]]
        if gap <= min_gap:
            high -= 1
            continue
        donor, to = bins[order[low]], bins[order[high]]
        item, start, length = donor.pop()
        take = min(gap, length)
        to.append((item, start + length - take, take))
        if take < length:
            donor.append((item, start, length - take))
        used[order[high]] += take
        used[order[low]] -= take
        low += not donor
    return [b for b in bins if b]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to PART_ROWS rows that hold PART_BYTES of text, or a single longer one."""
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    at, held = 0, 0
    for k, size in enumerate(sizes):
        if k > at and (held + size > PART_BYTES or k - at == PART_ROWS):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < len(sizes):
        yield batch.slice(at)


def _blocks(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = to_arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        for batch in batches:
            for part in _parts(batch):
                out: list[list] = [[] for _ in _BLOCKS]
                ids_of = tok.encode(part.column("text").to_pylist())
                for row, id_, ids in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), ids_of, strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        for col, v in zip(out, (row, id_, start, length, n, ids[4 * start:4 * (start + length)]), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _pack_group(group: int, rows: pa.Table, capacity: int, min_gap: int) -> Iterator[pa.RecordBatch]:
    """The pieces of one group of remainders."""
    ids, docs, starts, totals, lengths = (rows[c].to_pylist() for c in ("ids", "id", "start", "doc_tokens", "length"))
    packed = first_fit_decreasing(lengths, capacity)
    bins = fill_gaps([[(k, 0, lengths[k]) for k in b] for b in packed], capacity, min_gap)
    out, schema = [], to_arrow_schema(_PIECES)
    for b, pieces in enumerate(bins):
        offset = 0
        for item, at, n in pieces:
            out.append((docs[item], starts[item] + at, n, totals[item], (group << 32) + b, offset, ids[item][4 * at:4 * (at + n)]))
            offset += n
        if len(out) >= PART_ROWS or b + 1 == len(bins):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []


def _pack(capacity: int, min_gap: int, groups: int):
    schema = to_arrow_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slot: full blocks (below 0) pass one by one, remainders wait for the rest of their group."""
        full = (groups + TaskContext.get().partitionId()) << 32
        group, held = -1, []
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            n = int(np.searchsorted(slot, 0))
            if n:
                b = batch.slice(0, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("start"), b.column("length"), b.column("doc_tokens"), pa.array(np.arange(full, full + n)),
                     pa.array(np.zeros(n, dtype=np.int64)), b.column("ids")], schema=schema)
                full += n
            edges = [n, *(np.flatnonzero(np.diff(slot[n:])) + n + 1).tolist(), len(slot)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                if slot[a] != group and held:
                    yield from _pack_group(group, pa.Table.from_batches(held), capacity, min_gap)
                    held = []
                group = int(slot[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield from _pack_group(group, pa.Table.from_batches(held), capacity, min_gap)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, group_rows: int = GROUP_ROWS, min_gap: int = MIN_GAP) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, doc_tokens, sequence_id, offset and the ids
    (little-endian unsigned 32-bit). A sequence is its pieces in order of offset, padded to ``capacity``.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed
    each for itself; an empty table gives no piece; other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group_rows))
    rows = keyed_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    blocks = rows.select("row", "id", "text").mapInArrow(_blocks(tokenizer_path, capacity, end_id), _BLOCKS)
    # A document has one remainder at most, so that a group holds about group_rows blocks; full blocks go anywhere.
    rest = F.pmod(F.xxhash64("row", "start"), F.lit(groups))
    spread = -1 - F.pmod(F.xxhash64("row", "start"), F.lit(FULL_SLOTS))
    dealt = blocks.withColumn("slot", F.when(F.col("length") < capacity, rest).otherwise(spread))
    sorted_ = dealt.repartition(partitions(docs.sparkSession), "slot").sortWithinPartitions("slot", "row", "start")
    return sorted_.mapInArrow(_pack(capacity, min_gap, groups), _PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """``pack`` with the checksum of each piece's ids in place of the ids."""
    import public_tokenizers

    p = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
