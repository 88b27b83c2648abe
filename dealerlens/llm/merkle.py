"""Document fingerprints: a Merkle tree over sections, paragraphs, sentences and phrases.

A text is cut without loss: into sections at blank lines, paragraphs at line
feeds, sentences after closing marks, and phrases of a few words. A sentence's digest is that of its characters,
any higher node's that of its children's digests; a phrase is short enough to stand for itself. Roots are equal if and only if texts
are (but for collisions of 128-bit digests). Two trees are compared from the top: equal branches count
whole, only differing ones are opened, which locates an edit and weighs what is left alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dealerlens.llm.common import partitions, table

_CUTS = (
    re.compile(r"\n[ \t\r\x0b\x0c]*\n\s*"),  # sections
    re.compile(r"\n"),  # paragraphs
    re.compile(r"[.!?…。！？]+\s+"),  # sentences
)
PHRASE = 3
#: Sentences of fewer words have one word to a phrase; texts of fewer words, RUN code points.
SHORT = 6
RUN = 2
_PHRASE = re.compile(r"\s*(?:\S+\s*){1,%d}" % PHRASE)
_WORD = re.compile(r"\s*\S+\s*")
_RUN = re.compile(r"(?s).{1,%d}" % RUN)

#: Digest (a phrase: itself), code points, and the children, or a sentence's text and how it is cut.
Node = tuple


def _pieces(text: str, cut: re.Pattern) -> list[str]:
    ends = [m.end() for m in cut.finditer(text)]
    if not ends:
        return [text]
    if ends[-1] < len(text):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def tree(text: str) -> Node:
    """The Merkle tree of a text; an empty text has one empty branch on every level."""
    return _branch(text, 0, len(text.split(None, SHORT)) < SHORT)


def _branch(text: str, level: int, short: bool) -> Node:
    if level == len(_CUTS):
        return blake2b(text.encode(), digest_size=16).digest(), len(text), (text, short)
    kids = [_branch(p, level + 1, short) for p in _pieces(text, _CUTS[level])]
    return blake2b(b"%d" % level + b"".join([k[0] for k in kids]), digest_size=16).digest(), len(text), kids


def children(node: Node) -> list[Node]:
    """A node's branches; a sentence is cut into phrases when it is opened."""
    kids = node[2]
    if isinstance(kids, list):
        return kids
    text, short = kids
    cut = _RUN if short else _PHRASE if len(text.split(None, SHORT)) >= SHORT else _WORD
    return [(p, len(p), []) for p in cut.findall(text)]


def likeness(a: Node, b: Node) -> float:
    """Twice the code points in branches both trees hold over the code points of both: 1 for equal trees, 0 for strangers.

    On each level equal branches are paired, as often as both hold them; only the others are opened."""
    if a[0] == b[0]:
        return 1.0
    alike, left, right = 0, children(a), children(b)
    while left and right:
        mine, theirs = [n[0] for n in left], [n[0] for n in right]
        common = set(mine) & set(theirs)
        if common:
            both = Counter(x for x in mine if x in common) & Counter(x for x in theirs if x in common)
            free_a, free_b = dict(both), dict(both)
            left, alike = _unpaired(left, free_a, alike)
            right, _ = _unpaired(right, free_b, 0)
        left, right = [c for n in left for c in children(n)], [c for n in right for c in children(n)]
    return 2 * alike / (a[1] + b[1]) if a[1] + b[1] else 0.0


def _unpaired(nodes: list[Node], free: dict, alike: int) -> tuple[list[Node], int]:
    """The nodes beyond the number of each digest in ``free``, and ``alike`` plus the code points of the others."""
    rest = []
    for n in nodes:
        if free.get(n[0], 0) > 0:
            free[n[0]] -= 1
            alike += n[1]
        else:
            rest.append(n)
    return rest, alike


def edit_range(a: Node, b: Node) -> tuple[int, int] | None:
    """The code points of ``a`` within which it differs from ``b``, down to phrases; None for equal trees."""
    if a[0] == b[0]:
        return None
    start, end = 0, a[1]
    while True:
        left, right = children(a), children(b)
        k = 0
        while k < min(len(left), len(right)) and left[k][0] == right[k][0]:
            start += left[k][1]
            k += 1
        left, right = left[k:], right[k:]
        while left and right and left[-1][0] == right[-1][0]:
            end -= left[-1][1]
            left, right = left[:-1], right[:-1]
        if len(left) != 1 or len(right) != 1 or isinstance(left[0][0], str):
            return start, end
        a, b = left[0], right[0]


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many of the first code points of ``other``, or all."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, edit_start long, edit_end long, n_sections long, n_paragraphs long")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, text, other in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "next")), strict=True):
            new = edited(text, other)
            own, changed, after = tree(text), tree(new), tree(other)
            start, end = edit_range(own, changed) or (None, None)
            out.append((id_, len(text), sha256(new.encode()).hexdigest(), own[0].hex(), changed[0].hex(), likeness(own, changed),
                        likeness(own, after), start, end, len(own[2]), sum(len(s[2]) for s in own[2])))
        cols = zip(*out, strict=True) if out else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if n.endswith(("sha256", "fingerprint")) else pa.float64() if n.startswith("near") else pa.int64())
             for n, c in zip(_NAMES, cols, strict=True)], names=_NAMES)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each row with the text of the row after it in descending order of id, the first after the last.

    The rows are dealt to ranges of ids, whose largest ids (a bounded list) are quantiles of the ids. The row that opens a range is
    copied to the range before it, so a window within each range finds every successor; no range holds more than its share. Null ids come
    last, rows of one id in order of text.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 8 * partitions(docs.sparkSession)
    found = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n + 1)], 20 * n).alias("q"), F.max("key").alias("m")).first()
    tops = np.unique(np.array([*(found.q or []), *([found.m] if found.m is not None else [])], dtype=np.int64))

    @F.pandas_udf("long")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(tops, keys.to_numpy(np.int64)))

    @F.pandas_udf("boolean")
    def opens(keys: pd.Series) -> pd.Series:
        return pd.Series(np.isin(keys.to_numpy(np.int64), tops))

    here = F.struct(F.col("range"), F.lit(False).alias("copy"))
    ahead = F.struct(F.pmod(F.col("range") + 1, F.lit(max(1, len(tops)))).alias("range"), F.lit(True).alias("copy"))
    dealt = (rows.withColumn("range", range_of("key")).withColumn("opens", opens("key"))
             .select("id", "key", "text", F.explode(F.when(F.col("opens"), F.array(here, ahead)).otherwise(F.array(here))).alias("at")))
    order = W.partitionBy("at.range").orderBy("at.copy", F.col("key").desc(), "text")
    return (dealt.withColumn("next", F.lead("text").over(order)).filter("not at.copy").select("id", "text", "next"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, n_chars, the root of its tree, the SHA-256 and root of its edited text, likeness of its tree
    to the edited text's and to the next document's, where text and edited text differ (null if they don't), and how many sections and
    paragraphs it has.

    A null text is empty; a single document is its own successor; repeated rows and null ids stay (see :func:`with_next`);
    an empty table gives an empty result; other columns are ignored.
    """
    return with_next(docs, id_col, text_col).mapInArrow(_compare, _OUT)


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
