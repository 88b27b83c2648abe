"""Removal of repeated passages by suffix automata of reference shards.

A window of ``window`` words goes if its words also start in a document of smaller id.

1. Each window names an anchor, the least hash among its runs of ``ANCHOR`` words, so equal windows name equal anchors.
   Anchors that one row alone names are left out (counted over all rows).
2. Consecutive windows of one shared anchor form a segment; all segments with a window in common lie under one key.
   An anchor of more than ``HOT`` rows gives single windows instead, each under its own hash, so no key grows with the rows.
3. The distinct segments, each with its smallest id, are the reference. Their keys are dealt to shards of about
   ``SHARD_WORDS`` words.
4. A shard's reference goes at the head of each stream of segments dealt to that shard (segments of an anchor's smallest id
   stay out, as none is before them; a shard with many rows has many streams of about ``STREAM_ROWS``). The task builds the
   reference's suffix automaton, which knows the smallest id of every run of words, and the segments run through it for their
   matching statistics: where at least ``window`` words match up to a place and their smallest id is below the document's, the
   window ending there goes.
5. Overlapping windows of a document join to maximal spans, which are cut out.

Only the anchors are hashes taken for the words; every removal is a match of the words themselves.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import forget_shuffles, table
from dealerlens.session import materialize

WINDOW = 13
ANCHOR = 5
HOT = 2000
#: Windows of a segment; a longer run of one anchor is cut.
RUN = 32  # 63 at most, as a bit of a long stands for each
SHARD_WORDS = 200_000
STREAM_ROWS = 500_000
#: Shards with more than one stream; at such sizes streams get longer instead.
SPLIT_SHARDS = 1 << 16
#: Segments that run through an automaton at once, and bytes of text that are split at once.
CHUNK = 20_000
PART_BYTES = 2 << 20
PART_ROWS = 2000
#: Kinds of an anchor within a row: shared, also hot, and whether no row of a smaller id has it.
SHARED, HOT_ANCHOR, FIRST_ROW = 1, 2, 4
#: The id of rows without one: they come last, as one document.
LAST = 2**63 - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    h = hashes[:n].copy()
    for k in range(1, size):
        h = h * _BASE + hashes[k:k + n]
    return _mixed(h)


class Words:
    """The words of several texts, found in their bytes.

    ``first`` and ``last`` are the words before which each text begins and ends.
    """

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        n, space = len(self.data), _SPACE[self.data]
        opens, closes = np.ones(n + 1, bool), np.ones(n + 1, bool)
        opens[1:n], closes[:n - 1 if n else 0] = space[:-1], space[1:]
        opens[offsets[:-1]] = True
        closes[offsets[1:] - 1] = True  # of an empty text at the start: the last place, which is none
        self.start = np.flatnonzero(~space & opens[:n])
        self.end = np.flatnonzero(~space & closes[:n]) + 1
        self.first, self.last = np.searchsorted(self.start, offsets[:-1]), np.searchsorted(self.start, offsets[1:])

    def hashes(self) -> np.ndarray:
        """A hash of each word; equal words have equal hashes."""
        out, at = np.zeros(len(self.start), np.uint64), 0
        while at < len(out):  # a few hundred kilobytes at a time
            to = max(int(np.searchsorted(self.start, self.start[at] + (1 << 18))), at + 1)
            lo, hi = self.start[at], self.end[to - 1]
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[self.data[lo:hi]] * _powers(int(_BASE), hi - lo), out=total[1:])
            a, b = self.start[at:to] - lo, self.end[at:to] - lo
            out[at:to] = (total[b] - total[a]) * _powers(pow(int(_BASE), -1, 2**64), hi - lo)[a]
            at = to
        return _mixed(out + (self.end - self.start).astype(np.uint64) * _BASE)

    def windows(self, hashes: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and anchor (the least hash of its runs of ``size`` words) of each window, in order."""
        sizes = np.maximum(self.last - self.first - window + 1, 0)
        text = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(text)) + np.repeat(self.first - (np.cumsum(sizes) - sizes), sizes)
        if not len(text):
            return text, start, np.zeros(0, np.uint64)
        runs = _runs(hashes, size)
        n = len(runs) - (window - size)
        anchor = runs[:n].copy()
        for k in range(1, window - size + 1):
            np.minimum(anchor, runs[k:k + n], out=anchor)
        return text, start, anchor[start]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all words, each followed by one space, and where each word's space ends."""
        size = self.end - self.start + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start - (ends - size), size)
        out = self.data[np.minimum(at, max(len(self.data) - 1, 0))]
        out[ends - 1] = 32
        return out, ends


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right"))
            to = min(max(to, at + 1), at + PART_ROWS)
            yield batch.slice(at, to - at)
            at = to


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, bool)
    return np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]


def _anchors(window: int, anchor_words: int):
    """The distinct anchors of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = Words(part.column("text"))
            text, _, anchor = words.windows(words.hashes(), window, anchor_words)
            new = _changes(text, anchor)
            text, anchor = text[new], anchor[new]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = _changes(text, anchor)
            rows = pa.array(text[new])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), *(part.column(c).take(rows) for c in ("key", "rank"))],
                                             names=["anchor", "key", "rank"])

    return run


def _segments(window: int, anchor_words: int, run_windows: int):
    """Segments of shared anchors, and single windows of hot ones."""
    names = ["place", "rank", "key", "start", "n_words", "words", "is_first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = Words(part.column("text"))
            hashes = words.hashes()
            text, start, anchor = words.windows(hashes, window, anchor_words)
            state = np.zeros(len(text), np.int8)
            at, to = (np.searchsorted(text, np.arange(part.num_rows), side) for side in ("left", "right"))
            for row, found in enumerate(part.column("shared")):
                if len(found) and to[row] > at[row]:
                    shared, kind = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "kind"))
                    order = np.argsort(shared.view(np.uint64))
                    own, shared = anchor[at[row]:to[row]], shared.view(np.uint64)[order]
                    place = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                    state[at[row]:to[row]] = np.where(shared[place] == own, kind[order][place], 0)
            hot, plain = np.flatnonzero(state & HOT_ANCHOR), np.flatnonzero((state > 0) & (state & HOT_ANCHOR == 0))
            if not len(hot) + len(plain):
                continue
            new = _changes(plain - np.arange(len(plain)), text[plain], anchor[plain])
            first = np.flatnonzero(new)
            within = np.arange(len(plain)) - np.repeat(first, np.diff(np.r_[first, len(plain)]))
            first = np.flatnonzero(within % run_windows == 0)
            rows, begin = np.r_[text[plain][first], text[hot]], np.r_[start[plain][first], start[hot]]
            size = np.r_[np.diff(np.r_[first, len(plain)]), np.ones(len(hot), np.int64)] + window - 1
            place = np.r_[anchor[plain][first], _runs(hashes, window)[start[hot]]]
            data, ends = words.spaced()
            lo, hi, data = np.r_[0, ends][begin], ends[begin + size - 1] - 1, data.tobytes()
            texts = pa.array([data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.view(np.int64)), *(part.column(c).take(pa.array(rows)) for c in ("rank", "key")),
                 pa.array(begin - words.first[rows]), pa.array(size), texts,
                 pa.array(state[np.r_[plain[first], hot]] & FIRST_ROW > 0)], names=names)

    return run


def _split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct words of texts with single spaces, the place there of each word, and the number of words of each text."""
    words = pc.split_pattern(texts, " ")
    coded = words.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), words.value_lengths().to_numpy().astype(np.int64)


class Automaton:
    """Suffix automaton of several runs of words, each with an id: the smallest id of every run of ``window`` words in them."""

    def __init__(self, segments: pa.StringArray, ids: list[int], window: int):
        self.window = window
        self.words, letters, counts = _split(segments)
        collects = gc.isenabled()
        gc.disable()  # a dictionary a state, none of them in a cycle
        try:
            nexts, link, length, least = self._states(letters.tolist(), counts.tolist(), ids)
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, nexts), np.int64, len(nexts))
        total = int(sizes.sum())
        keys = (np.repeat(np.arange(len(nexts)), sizes) << 32) | np.fromiter(chain.from_iterable(nexts), np.int64, total)
        to = np.fromiter(chain.from_iterable(x.values() for x in nexts), np.int64, total)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.link, self.length, self.least = np.array(link), np.array(length), np.array(least, np.int64)
        by_length = np.argsort(self.length, kind="stable")
        levels = np.split(by_length, np.flatnonzero(np.diff(self.length[by_length])) + 1)
        for level in reversed(levels[1:]):  # a run occurs wherever a longer run ends with it
            np.minimum.at(self.least, self.link[level], self.least[level])
        whole = self.length[np.maximum(self.link, 0)] < window
        for level in levels[1:]:  # longer runs answer for their last ``window`` words
            inner = level[~whole[level]]
            self.least[inner] = self.least[self.link[inner]]

    @staticmethod
    def _states(letters: list[int], counts: list[int], ids: list[int]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
        """Edges, suffix link, length and least id (of the runs that end there) of each state."""
        nexts, link, length, least = [{}], [-1], [0], [LAST]

        def split(p: int, c: int, q: int) -> int:
            """The state of the run that ``p`` and ``c`` make, taken out of ``q``, which holds longer ones too."""
            clone = len(nexts)
            nexts.append(nexts[q].copy())
            length.append(length[p] + 1)
            least.append(LAST)
            link.append(link[q])
            while p >= 0 and nexts[p].get(c) == q:
                nexts[p][c] = clone
                p = link[p]
            link[q] = clone
            return clone

        at = 0
        for count, own in zip(counts, ids, strict=True):
            last = 0
            for c in letters[at:at + count]:
                q = nexts[last].get(c)
                if q is None:
                    new, p = len(nexts), last
                    nexts.append({})
                    length.append(length[last] + 1)
                    least.append(own)
                    link.append(0)
                    while p >= 0:
                        edges = nexts[p]
                        q = edges.get(c)
                        if q is not None:
                            link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                            break
                        edges[c] = new
                        p = link[p]
                    last = new
                else:
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                    if own < least[last]:
                        least[last] = own
            at += count
        return nexts, link, length, least

    def matches(self, segments: pa.StringArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place of the segments: the place, and which segments' last ``window`` words match, with their smallest ids."""
        words, letters, sizes = _split(segments)
        codes = pc.index_in(words, self.words).fill_null(len(self.words)).to_numpy().astype(np.int64)[letters]
        begin = np.cumsum(sizes) - sizes
        state, matched = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for at in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > at)
            open_, letter = live, codes[begin[live] + at]
            while len(open_):
                key = (state[open_] << 32) | letter
                edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[edge] == key
                state[open_[hit]] = self.to[edge[hit]]
                matched[open_[hit]] += 1
                open_, letter = open_[~hit], letter[~hit]
                at_root = state[open_] == 0
                matched[open_[at_root]] = 0
                open_, letter = open_[~at_root], letter[~at_root]
                state[open_] = self.link[state[open_]]
                matched[open_] = self.length[state[open_]]
            found = live[matched[live] >= self.window]
            yield at, found, self.least[state[found]]


def _stream(window: int, chunk: int):
    """Starts (bits of ``goes``) of the windows that go, of streams that begin with their shard's reference."""
    schema = pa.schema([("rank", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("goes", pa.int64())])

    def matched(automaton: Automaton, rows: pa.RecordBatch) -> pa.RecordBatch:
        goes, rank = np.zeros(rows.num_rows, np.int64), rows.column("rank").to_numpy()
        for at, found, least in automaton.matches(rows.column("words")):
            found = found[least < rank[found]]
            goes[found] |= np.int64(1) << np.int64(max(at - window + 1, 0))
        some = pa.array(np.flatnonzero(goes))
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(some) for c in ("rank", "key", "start")), pa.array(goes).take(some)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reference, automaton = None, [], None
        for batch in batches:
            shard, stream = (batch.column(c).to_numpy() for c in ("shard", "stream"))
            is_reference = batch.column("start").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(_changes(shard, stream, is_reference)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if (shard[a], stream[a]) != now:
                    now, reference, automaton = (shard[a], stream[a]), [], None
                if is_reference[a]:
                    reference.append(batch.select(["words", "rank"]).slice(a, b - a))
                    continue
                if automaton is None:
                    whole = pa.Table.from_batches(reference).combine_chunks()
                    automaton = Automaton(whole.column("words").chunk(0), whole.column("rank").to_pylist(), window)
                    reference = []
                for k in range(a, b, chunk):
                    yield matched(automaton, batch.slice(k, min(chunk, b - k)))

    return run


def _cut(window: int):
    """Texts without the words of their windows that go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words = Words(part.column("text"))
            edge = np.zeros(len(words.start) + 1, np.int64)
            spans = part.column("spans")
            row = np.repeat(np.arange(part.num_rows), spans.value_lengths().fill_null(0).to_numpy())
            start, goes = (spans.flatten().field(c).to_numpy() for c in ("start", "goes"))
            for bit in range(int(np.bitwise_or.reduce(goes, initial=0)).bit_length()):
                some = (goes >> bit) & 1 == 1
                at = words.first[row[some]] + start[some] + bit
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            stays = np.cumsum(edge[:-1]) == 0
            data, ends = words.spaced()
            kept = data[np.repeat(stays, np.diff(ends, prepend=0))].tobytes()
            to = np.r_[0, np.cumsum(np.diff(ends, prepend=0) * stays)]
            texts = [kept[a:max(a, b - 1)] for a, b in zip(to[words.first].tolist(), to[words.last].tolist(), strict=True)]
            n, left = words.last - words.first, np.r_[0, np.cumsum(stays)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n),
                                              pa.array(n - (left[words.last] - left[words.first]))],
                                             names=["doc_id", "kept", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, the words kept (joined by one space), n_words and n_removed of each row of ``docs``.

    Words are runs of other characters than space, tab, LF, VT, FF and CR, unchanged. A word goes if a window of
    ``window`` words around it also starts in a row of smaller id; windows are judged on the input. Rows of one id
    never remove each other's words, nor do rows without an id, which come after all others. Null texts read as empty;
    other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    anchor_words = min(ANCHOR, window)
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), rank.alias("rank"), F.xxhash64(rank, text).alias("key"), text.alias("text"))
    anchors = rows.select("key", "rank", "text").mapInArrow(_anchors(window, anchor_words), "anchor long, key long, rank long")
    shared = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("rank").alias("least")).filter("n > 1"),
                         "shared_anchors")
    forget_shuffles(spark)
    kind = SHARED + F.when(F.col("n") > HOT, HOT_ANCHOR).otherwise(0) + F.when(F.col("rank") == F.col("least"), FIRST_ROW).otherwise(0)
    of_rows = anchors.join(shared, "anchor").groupBy("rank", "key").agg(
        F.collect_list(F.struct("anchor", kind.cast("byte").alias("kind"))).alias("shared"))
    segments = materialize(rows.select("rank", "key", "text").join(of_rows, ["rank", "key"]).mapInArrow(
        _segments(window, anchor_words, RUN), "place long, rank long, key long, start long, n_words long, words string, is_first boolean"), "segments")
    forget_shuffles(spark)
    reference = materialize(segments.groupBy("place", "words", "n_words").agg(F.min("rank").alias("rank")), "reference")
    forget_shuffles(spark)
    shards = -(-(reference.agg(F.sum("n_words")).first()[0] or 1) // SHARD_WORDS)
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard")
    moving = segments.filter("not is_first")  # nothing smaller can hold the others' windows
    per_stream = max(STREAM_ROWS, -(-moving.count() // SPLIT_SHARDS))
    streams = moving.groupBy(shard).agg(F.count("*").alias("n")).filter(F.col("n") > per_stream)  # SPLIT_SHARDS rows at most
    streams = F.broadcast(streams.select("shard", F.ceil(F.col("n") / per_stream).alias("streams")))
    of_shard = F.coalesce("streams", F.lit(1))
    heads = (reference.select(shard, "words", "rank").join(streams, "shard", "left")
             .withColumn("stream", F.explode(F.sequence(F.lit(0).cast("long"), of_shard - 1))).drop("streams"))
    dealt = (moving.select(shard, "words", "rank", "key", "start").join(streams, "shard", "left")
             .withColumn("stream", F.pmod(F.xxhash64("key", "start"), of_shard)).drop("streams"))
    stream = heads.unionByName(dealt, allowMissingColumns=True).repartition("shard", "stream").sortWithinPartitions(
        "shard", "stream", F.col("start").isNotNull())
    goes = materialize(stream.mapInArrow(_stream(window, CHUNK), "rank long, key long, start long, goes long"), "windows_that_go")
    forget_shuffles(spark)
    spans = goes.groupBy("rank", "key").agg(F.collect_list(F.struct("start", "goes")).alias("spans"))
    return rows.join(spans, ["rank", "key"], "left").select("id", "text", "spans").mapInArrow(
        _cut(window), "doc_id long, kept string, n_words long, n_removed long")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words and more that a document of smaller id holds."""
    return dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
