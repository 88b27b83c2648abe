"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

Both tokenizers' tokens cover the same bytes, so a byte offset where a token of each
ends is a cut that no link may cross. An interval is split at a shared end near its
middle: the middle left token's end is bisected into the right ends, and the two
sides leapfrog from there, first to the right, then to the left. Both halves are
treated alike; an interval without an inner shared end is a leaf, one group. All
intervals of a batch of documents are split at once, level by level, in numpy.

Every left token of a group is linked with every right token of it. How many
documents hold a linked id pair is counted over the whole corpus; the pairs held
by at least a ``KNOWN``-th of all rows (so at most KNOWN pairs) are known to every
task, rows of the others meet their counts in a join.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import table
from dealerlens.session import materialize

#: Bound of the id pairs whose counts every task holds (16 MB).
KNOWN = 1 << 20
#: A worker aligns so many rows and bytes of text at once.
PART_ROWS = 2000
PART_BYTES = 1 << 20
#: A search goes so many steps with all others; what is left is searched on its own.
STEPS = 32
#: Links of a group that are listed one by one; larger groups are counted by distinct ids.
GROUP_LINKS = 1 << 18


class Tokenizer:
    """A tokenizer whose tokens' bytes make up the text: ids of a text, and the bytes of each id.

    ``lossless`` says that the bytes of a text's ids always are a space and the text.
    """

    def __init__(self, encode: Callable[[str], Sequence[int]], token_bytes: list[bytes], lossless: bool = False):
        self.encode, self.token_bytes, self.lossless = encode, token_bytes, lossless
        self.lengths = np.array([len(b) for b in token_bytes], dtype=np.int64)

    def whole(self, text: str) -> np.ndarray | None:
        """The ids of ``text``, or None if their bytes are not a space and the text."""
        ids = self.encode(text)
        if self.lossless or b"".join(map(self.token_bytes.__getitem__, ids)) == b" " + text.encode():
            return np.array(ids, dtype=np.int64)
        return None


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE by its ranks file; special tokens are plain text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    ids = functools.partial(coder.encode_to_numpy, disallowed_special=())
    return Tokenizer(lambda text: ids(" " + text), table, lossless=all(bytes([b]) in ranks for b in range(256)))


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, which adds the first space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizer(lambda text: model.encode(text), table)


def _near(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, first_a, first_b, last, way: int):
    """From each (i, j), go ``way`` (1 or -1) to the first equal ends; i is -1 where none lies within the interval."""
    found_i, found_j = np.full(len(i), -1), np.full(len(i), -1)
    live = np.arange(len(i))
    for _ in range(STEPS):
        inside = (i >= first_a) & (j >= first_b) & (i < last)
        if not inside.all():
            live, i, j, first_a, first_b, last = (x[inside] for x in (live, i, j, first_a, first_b, last))
        if not len(live):
            return found_i, found_j
        x, y = a[i], b[j]
        hit = x == y
        found_i[live[hit]], found_j[live[hit]] = i[hit], j[hit]
        miss = ~hit
        step_a = (x < y if way > 0 else x > y)[miss]
        live, i, j, first_a, first_b, last = (x[miss] for x in (live, i, j, first_a, first_b, last))
        i, j = i + way * step_a, j + way * ~step_a
    for k, p, q, lo_a, lo_b, end in zip(live.tolist(), i.tolist(), j.tolist(), first_a.tolist(), first_b.tolist(),
                                        last.tolist(), strict=True):
        if p < lo_a or q < lo_b or p >= end:
            continue
        left, right = (slice(p, end), slice(q, None)) if way > 0 else (slice(lo_a, p + 1), slice(lo_b, q + 1))
        right_ends = b[right]
        if way > 0:
            right_ends = right_ends[:np.searchsorted(right_ends, a[end - 1], "right")]
        if not len(right_ends):
            continue
        at = np.searchsorted(right_ends, a[left])
        same = np.flatnonzero((at < len(right_ends)) & (right_ends[np.minimum(at, len(right_ends) - 1)] == a[left]))
        if len(same):
            pick = same[0] if way > 0 else same[-1]
            found_i[k], found_j[k] = left.start + pick, right.start + at[pick]
    return found_i, found_j


def split_at_cuts(a: np.ndarray, b: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right tokens up to the end of each group.

    ``a`` and ``b`` are the ascending token ends of several texts, one after another on one axis of bytes; ``a_count`` and
    ``b_count`` the tokens of each text (at least one). The last ends of a text are equal.
    """
    hi_a, hi_b = np.cumsum(a_count), np.cumsum(b_count)
    lo_a, lo_b = hi_a - a_count, hi_b - b_count
    done_a, done_b = [], []
    while len(lo_a):
        one = (hi_a - lo_a == 1) | (hi_b - lo_b == 1)
        done_a.append(hi_a[one])
        done_b.append(hi_b[one])
        lo_a, hi_a, lo_b, hi_b = (x[~one] for x in (lo_a, hi_a, lo_b, hi_b))
        last = hi_a - 1  # the interval's end is a cut already
        mid = (lo_a + last) // 2
        at = np.searchsorted(b, a[mid])
        i, j = _near(a, b, mid, at, lo_a, lo_b, last, 1)
        none = np.flatnonzero(i < 0)
        if len(none):
            i[none], j[none] = _near(a, b, mid[none] - 1, at[none] - 1, lo_a[none], lo_b[none], last[none], -1)
        cut = i >= 0
        done_a.append(hi_a[~cut])
        done_b.append(hi_b[~cut])
        i, j = i[cut] + 1, j[cut] + 1
        lo_a, hi_a, lo_b, hi_b = (np.stack(x, 1).ravel() for x in (  # both halves in place, so that searches stay in order
            (lo_a[cut], i), (i, hi_a[cut]), (lo_b[cut], j), (j, hi_b[cut])))
    return np.sort(np.concatenate(done_a or [hi_a])), np.sort(np.concatenate(done_b or [hi_b]))


@dataclass
class Aligned:
    """Texts with tokens, one after another: their places in the batch, ids, and tokens up to the end of each group."""

    rows: np.ndarray
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_count: np.ndarray
    b_count: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @functools.cached_property
    def groups(self) -> np.ndarray:
        """Groups up to the end of each text."""
        return np.searchsorted(self.a_ends, np.cumsum(self.a_count)) + 1


def align_texts(texts: list[str | None], left: Tokenizer, right: Tokenizer) -> Aligned:
    rows, a_ids, b_ids = [], [], []
    for row, text in enumerate(texts):
        if not text:
            continue
        a = left.whole(text)
        b = right.whole(text) if a is not None else None
        if b is not None:
            rows.append(row)
            a_ids.append(a)
            b_ids.append(b)
    a_count, b_count = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
    a, b = (np.concatenate(ids) if ids else np.zeros(0, np.int64) for ids in (a_ids, b_ids))
    a_ends, b_ends = split_at_cuts(np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b]), a_count, b_count)
    return Aligned(np.array(rows, dtype=np.int64), a, b, a_count, b_count, a_ends, b_ends)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and end - at < PART_ROWS and size < PART_BYTES:
                size += len(texts[end] or "")
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def _listed(values: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """``values`` as lists of ``n`` rows: those of ``rows`` end at ``ends``, the others are empty."""
    sizes = np.zeros(n + 1, dtype=np.int64)
    sizes[rows + 1] = np.diff(ends, prepend=0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(values, kind))


def _align(left: Callable[[], Tokenizer], right: Callable[[], Tokenizer]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            got, n = align_texts(texts, left(), right()), len(texts)
            a_base, b_base = (np.repeat(np.cumsum(c) - c, np.diff(got.groups, prepend=0)) for c in (got.a_count, got.b_count))
            lists = [_listed(got.a_ids, np.cumsum(got.a_count), got.rows, n, pa.int32()),
                     _listed(got.b_ids, np.cumsum(got.b_count), got.rows, n, pa.int32()),
                     _listed(got.a_ends - a_base, got.groups, got.rows, n, pa.int32()),
                     _listed(got.b_ends - b_base, got.groups, got.rows, n, pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def align(docs: DataFrame, left: Callable[[], Tokenizer], right: Callable[[], Tokenizer], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """The ids of each row's text by both tokenizers, and the groups: how many ids of each come up to the end of a group.

    Texts that are null, empty, or that the ids' bytes do not give again have empty lists. Ids may be null or repeated,
    other columns are ignored, an empty table gives no row. A text is held whole by one task; its groups are found in one go.
    """
    return _texts(docs, id_col, text_col).mapInArrow(
        _align(left, right), "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


@functools.lru_cache(maxsize=2)
def _spelled(n_left: int, n_right: int) -> list[bytes]:
    """Each id of both vocabularies as decimal digits before a comma, a bar (left) or a semicolon (right)."""
    return [b"%d%c" % (i, c) for n, marks in ((n_left, b",|"), (n_right, b",;")) for i in range(n) for c in marks]


def _spell(got: Aligned, left: Tokenizer, right: Tokenizer) -> list[str]:
    """SHA-256 of each text's groups, written out."""
    a_size, b_size = np.diff(got.a_ends, prepend=0), np.diff(got.b_ends, prepend=0)
    group_a, group_b = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    a, b = got.a_ids * 2, (got.b_ids + len(left.token_bytes)) * 2
    a[got.a_ends - 1] += 1
    b[got.b_ends - 1] += 1
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + (got.b_ends - b_size)[group_a]] = a
    order[np.arange(len(b)) + got.a_ends[group_b]] = b
    spell = _spelled(len(left.token_bytes), len(right.token_bytes)).__getitem__
    out, lo = [], 0
    for hi in np.cumsum(got.a_count + got.b_count).tolist():
        out.append(hashlib.sha256(b"".join(map(spell, order[lo:hi].tolist()))[:-1]).hexdigest())
        lo = hi
    return out


def _linked_pairs(got: Aligned, n_left: int, n_right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of each id pair that a text links, in order; a pair is left id x ``n_right`` + right id."""
    a_size, b_size = np.diff(got.a_ends, prepend=0), np.diff(got.b_ends, prepend=0)
    text = np.repeat(np.arange(len(got.rows)), np.diff(got.groups, prepend=0))
    links = a_size * b_size
    small, at = np.flatnonzero(links <= GROUP_LINKS), 0
    total, held = np.cumsum(links[small]), []  # (text and pair as one number, times)
    span = n_left * n_right
    while at < len(small):  # some groups at a time: no more than a few GROUP_LINKS links are listed at once
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + 4 * GROUP_LINKS, "right"))
        some = small[at:max(end, at + 1)]
        n = links[some]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of_b = np.repeat(b_size[some], n)
        i = np.repeat((got.a_ends - a_size)[some], n) + within // of_b
        j = np.repeat((got.b_ends - b_size)[some], n) + within % of_b
        held.append(np.unique(np.repeat(text[some] * span, n) + got.a_ids[i] * n_right + got.b_ids[j], return_counts=True))
        at += len(some)
    for g in np.flatnonzero(links > GROUP_LINKS).tolist():
        a, na = np.unique(got.a_ids[got.a_ends[g] - a_size[g]:got.a_ends[g]], return_counts=True)
        b, nb = np.unique(got.b_ids[got.b_ends[g] - b_size[g]:got.b_ends[g]], return_counts=True)
        held.append((text[g] * span + (a[:, None] * n_right + b).ravel(), (na[:, None] * nb).ravel()))
    if not held:
        return (np.zeros(0, np.int64),) * 3
    key, times = map(np.concatenate, zip(*held, strict=True))
    if len(held) > 1:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.add.reduceat(times, first)
    return key // span, key % span, times


_LINKED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, "
           "times array<long>")


def _links(left: Callable[[], Tokenizer], right: Callable[[], Tokenizer]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches):
            got, n = align_texts(texts, left(), right()), len(texts)
            text, pair, times = _linked_pairs(got, len(left().token_bytes), len(right().token_bytes))
            links = np.add.reduceat(times, np.searchsorted(text, np.arange(len(got.rows)))) if len(got.rows) else times
            columns = []
            for values in (got.a_count, got.b_count, np.diff(got.groups, prepend=0), links):
                column = np.zeros(n, np.int64)
                column[got.rows] = values
                columns.append(pa.array(column))
            hashes = [""] * n
            for row, digest in zip(got.rows.tolist(), _spell(got, left(), right()), strict=True):
                hashes[row] = digest
            ends = np.searchsorted(text, np.arange(len(got.rows)), "right")
            lists = [_listed(x, ends, got.rows, n, pa.int64()) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns, pa.array(hashes, pa.string()), *lists], names=[
                "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _weigh(known, n_right: int):
    """Sums over a document's pairs that ``known`` (pairs, counts, whether the best of the left id) holds; the others are handed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            for k in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(k, PART_ROWS)
                sizes = part.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
                pair, times = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                at, row, n = at[hit], np.repeat(np.arange(len(sizes)), sizes), len(sizes)
                sums = []
                for weight in (best, counts):
                    total = np.zeros(n, np.int64)
                    np.add.at(total, row[hit], times[hit] * weight[at])
                    sums.append(pa.array(total))
                rest = np.searchsorted(row[~hit], np.arange(n), "right")
                lists = [_listed(x[~hit], rest, np.arange(n), n, pa.int64()) for x in (pair, times)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *sums, *lists], names=[
                    "row", "n_best", "count_sum", "pairs", "times"])

    return run


def link_counts(docs: DataFrame, left: Callable[[], Tokenizer], right: Callable[[], Tokenizer], id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: sizes and digest of its alignment, and what the corpus says of its links.

    n_best counts the links whose id pair is in most documents among the pairs of its left id (ties included), count_sum
    adds up the documents of each link's pair. A row of ``docs`` is a document, whatever its id; texts without tokens
    (see :func:`align`) give zeros and an empty digest.
    """
    spark = docs.sparkSession
    n_right = len(right().token_bytes)
    linked = materialize(_texts(docs, id_col, text_col).mapInArrow(_links(left, right), _LINKED)
                         .withColumn("row", F.monotonically_increasing_id()), "token_links")
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts, "pair_counts")
    a_id = F.expr(f"pair div {n_right}")
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the left vocabulary at most
    counts = counts.withColumn("a", a_id).join(F.broadcast(best), "a").select(
        "pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    least = -(-(counts.agg(F.sum("n")).first()[0] or 1) // KNOWN)
    top = counts.filter(F.col("n") >= least).toArrow()  # KNOWN rows at most, as their counts add up to the sum
    order = np.argsort(top.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    weighed = materialize(linked.select("row", "pairs", "times").mapInArrow(
        _weigh(known, n_right), "row long, n_best long, count_sum long, pairs array<long>, times array<long>"), "weighed_links")
    others = (weighed.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
              .join(counts.filter(F.col("n") < least), "pair")
              .groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"),
                                  F.sum(F.col("times") * F.col("n")).alias("more_count")))
    more = {c: F.coalesce(c, F.lit(0)) for c in ("more_best", "more_count")}
    return (linked.drop("pairs", "times").join(weighed.select("row", "n_best", "count_sum"), "row").join(others, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + more["more_best"]).alias("n_best"),
                    (F.col("count_sum") + more["more_count"]).alias("count_sum"), "groups_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text under byte_bpe_50k (its ranks file, equal to the JSON file's ids) and piece_bpe_32k."""
    import public_tokenizers

    left = functools.partial(byte_level, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    right = functools.partial(pieces, public_tokenizers.path("piece_bpe_32k.model"))
    return link_counts(table(spark, sf_dir, "documents"), left, right)
