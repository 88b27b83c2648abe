"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Fitting (on a bounded sample of the labelled rows outside the held-out fold):
1. Word and word-prefix features are counted in toxic and clean documents; those that toxic documents hold far more
   often are the lexicon.
2. Tokens are labelled: in a toxic document, those with a feature of high odds; no token of a clean one.
3. A two-state chain (clean, toxic) is fitted to windows of labelled tokens by gradient ascent on its likelihood, the
   gradient from forward-backward marginals.
4. A logistic curve from a document's marginals to its label is fitted on the same rows.

Scoring reads every whole text: forward-backward over all its tokens. Runs of tokens without a lexicon feature share
one transfer matrix, whose powers are tabulated, so messages are worked out at the other tokens only, and exactly.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import keyed_text, table
from dealerlens.session import materialize

FOLDS = 5
HELD_OUT_FOLD = 0
#: Bounds of the fit: labelled documents of each class, feature candidates, windows and their tokens.
FIT_TOXIC = 4000
FIT_CLEAN = 8000
CANDIDATES = 20_000
WINDOWS = 3000
WINDOW = 64
#: One in so many windows without any lexicon feature is a candidate too.
EMPTY_EVERY = 200

PREFIXES = (3, 4, 5, 6, 7)
MIN_DOCS = 5
MIN_ODDS = 3.0
#: Least likelihood-ratio statistic of a lexicon feature: about one chance find in ten million features.
MIN_RATIO = 28.0
LABEL_ODDS = 5.0
_STEPS = 150
_POWERS = 2048


def held_out(id_col) -> F.Column:
    """Whether a document is never fitted on: crc32 of its id as text, modulo FOLDS."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD


def word_of(token: str) -> str:
    """A token in lower case without what is no letter or digit at its ends."""
    word = token.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def features(word: str) -> list[str]:
    """The word itself and its proper prefixes."""
    return ["=" + word] + [word[:k] for k in PREFIXES if len(word) > k] if word else []


@dataclass
class Chain:
    """A fitted two-state chain over a lexicon, and the curve from marginals to a document's score."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    start: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0]))

    def __post_init__(self):
        self._known: dict[str, float | None] = {}
        self._powers: np.ndarray | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def evidence(self, token: str) -> float | None:
        """The summed weight of a token's lexicon features; None if it has none."""
        if token not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            own = [self.index[f] for f in features(word_of(token)) if f in self.index]
            self._known[token] = float(self.weights[own].sum()) if own else None
        return self._known[token]

    def _run(self, k: int) -> np.ndarray:
        """The transfer matrix of k tokens without evidence, up to a factor. Beyond the table it has converged."""
        if self._powers is None:
            step = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])
            powers = [np.eye(2)]
            for _ in range(_POWERS):
                m = powers[-1] @ step
                powers.append(m / m.max())
            self._powers = np.array(powers)
        return self._powers[min(k, _POWERS)]

    def marginals(self, n: int, at: list[int], weight: list[float]) -> np.ndarray:
        """P(toxic) of the tokens ``at`` (ascending) in a text of n tokens, given their evidence."""
        a = np.exp(self.trans)
        emit = [np.array([1.0, np.exp(min(self.bias + w, 500.0))]) for w in weight]
        fwd, v, prev = [], np.array([1.0, np.exp(self.start)]), -1
        for t, e in zip(at, emit, strict=True):
            v = v @ self._run(t - prev - 1) @ a * e
            v /= v.sum()
            fwd.append(v)
            prev = t
        out, v, nxt = np.zeros(len(at)), np.ones(2), n
        for k in range(len(at) - 1, -1, -1):
            v = self._run(nxt - at[k] - 1) @ v
            p = fwd[k] * v
            out[k] = p[1] / p.sum()
            v = a @ (emit[k] * v)
            v /= v.sum()
            nxt = at[k]
        return out

    def tag(self, text: str) -> tuple[int, list[int], np.ndarray]:
        """The number of tokens, those with evidence, and their marginals."""
        tokens = text.split()
        found = [(k, w) for k, w in enumerate(map(self.evidence, tokens)) if w is not None]
        at, weight = [k for k, _ in found], [w for _, w in found]
        return len(tokens), at, self.marginals(len(tokens), at, weight)

    def score(self, p: np.ndarray) -> float:
        """A document's score from its marginals: logistic in their largest log-odds and in the log of one plus their sum."""
        return float(1 / (1 + np.exp(-np.clip(self.curve @ summary(p), -500, 500))))


def summary(p: np.ndarray) -> np.ndarray:
    top = np.clip(p.max() if len(p) else 0.0, 0.02, 0.98)
    return np.array([1.0, np.log(top / (1 - top)), np.log1p(p.sum())])


# --- fitting -----------------------------------------------------------------------------------

def fit_chain(feats: np.ndarray, labels: np.ndarray, n_features: int) -> tuple[np.ndarray, float, float, np.ndarray]:
    """Weights, bias, start and transitions by gradient ascent. feats: (windows, tokens, features of a token), padded
    with n_features; labels: (windows, tokens), -1 beyond a window's end."""
    real, y = labels >= 0, np.maximum(labels, 0)
    n, length = labels.shape
    theta = np.concatenate([np.zeros(n_features + 1), [-4.0, -2.0], [1.0, -1.0, 0.0, 0.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, _STEPS + 1):
        w, (bias, start), trans = theta[:n_features + 1], theta[n_features + 1:n_features + 3], theta[-4:].reshape(2, 2)
        a = np.exp(trans)
        emit = np.ones((n, length, 2))
        emit[..., 1] = np.exp(np.clip(w[feats].sum(axis=2) + bias, -30, 30))
        fwd, bwd = np.zeros((n, length + 1, 2)), np.ones((n, length + 1, 2))
        fwd[:, 0] = np.array([1.0, np.exp(start)]) / (1 + np.exp(start))
        for t in range(length):
            f = fwd[:, t] @ a * emit[:, t]
            fwd[:, t + 1] = np.where(real[:, t, None], f / f.sum(axis=1, keepdims=True), fwd[:, t])
        for t in range(length - 1, -1, -1):
            b = (emit[:, t] * bwd[:, t + 1]) @ a.T
            bwd[:, t] = np.where(real[:, t, None], b / b.sum(axis=1, keepdims=True), bwd[:, t + 1])
        pair = fwd[:, :-1, :, None] * a * (emit * bwd[:, 1:])[:, :, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        pair *= real[..., None, None]
        p = pair[..., 1].sum(axis=2)
        first = a[:, y[:, 0]].T * np.array([1.0, np.exp(start)])  # the state before the first token is never seen
        first /= first.sum(axis=1, keepdims=True)
        before = np.concatenate([first[:, None], np.eye(2)[y[:, :-1]]], axis=1)
        seen = before[..., :, None] * np.eye(2)[y][..., None, :] * real[..., None, None]
        diff = (y - p) * real
        grad = np.zeros_like(theta)
        grad[:n_features + 1] = np.bincount(feats.ravel(), np.repeat(diff.ravel(), feats.shape[2]), n_features + 1)
        grad[n_features + 1] = diff.sum()
        grad[n_features + 2] = ((first[:, 1] - pair[:, 0, 1].sum(axis=1)) * real[:, 0]).sum()
        grad[-4:] = (seen - pair).sum(axis=(0, 1)).ravel()
        grad = grad / max(1, real.sum()) * 50 - 3e-4 * theta
        grad[n_features] = 0.0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        theta = theta + 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        theta[n_features] = 0.0
    return theta[:n_features], float(theta[n_features + 1]), float(theta[n_features + 2]), theta[-4:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge @ beta)
    return beta


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """How much likelier a toxic document holds a feature than a clean one, as a smoothed logarithm."""
    return float(np.log((toxic + .1) / (n_toxic + .2)) - np.log((clean + .1) / (n_clean + .2)))


def likelihood_ratio(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log-likelihood that the documents with a feature gain by a toxic share of their own."""
    n, share = toxic + clean, n_toxic / (n_toxic + n_clean)
    return 2 * sum(k * np.log(k / (n * s)) for k, s in ((toxic, share), (clean, 1 - share)) if k)


def _count(toxic: int, wanted: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows, count = batch.slice(k, 500), Counter()
                for text, y in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
                    if y == toxic:
                        own = {f for t in set(text.split()) for f in features(word_of(t))}
                        count.update(own if wanted is None else own & wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                                 names=["feature", "n"])

    return run


def _windows(odds: dict[str, float], index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, feats, labels = [], [], []
            for id_, text, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "toxic")), strict=True):
                tokens = text.split()
                for k in range(0, len(tokens), WINDOW):
                    own = [[f for f in features(word_of(t)) if f in index] for t in tokens[k:k + WINDOW]]
                    at = zlib.crc32(f"{id_} {k}".encode())
                    if not any(own) and at % EMPTY_EVERY:
                        continue
                    width = len(PREFIXES) + 1
                    x = np.full((WINDOW, width), len(index), dtype="<i4")
                    z = np.full(WINDOW, -1, dtype="i1")
                    for t, fs in enumerate(own):
                        x[t, :len(fs)] = [index[f] for f in fs]
                        z[t] = bool(y and fs and max(odds[f] for f in fs) >= LABEL_ODDS)
                    key.append(at)
                    feats.append(x.tobytes())
                    labels.append(z.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(feats, pa.binary()),
                                              pa.array(labels, pa.binary())], names=["key", "feats", "labels"])

    return run


def _summaries(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [summary(model.tag(t)[2]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[1] for v in x], pa.float64()), pa.array([v[2] for v in x], pa.float64()),
                                              batch.column("toxic")], names=["top", "total", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit on at most FIT_TOXIC and FIT_CLEAN labelled documents outside the held-out fold, taken in order of a hash of the id.

    Copies of a text count once. A document labelled more than once is toxic if any label says so; null ids, null labels and labels without a document
    are left out. Without a toxic or a clean row the model has no lexicon and scores every text alike, below one half.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .filter("id is not null and toxic is not null").filter(~held_out("id"))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("id"), F.col("id")]
    picked = (known.filter("toxic = 1").orderBy(*order).limit(FIT_TOXIC)
              .unionByName(known.filter("toxic <> 1").orderBy(*order).limit(FIT_CLEAN)))
    rows = materialize(keyed_text(docs, id_col, text_col).join(F.broadcast(picked), "id")
                       .dropDuplicates(["text", "toxic"]).repartition(32, "id"), "toxicity_fit")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not n_toxic or not n_clean:
        return Chain()

    def counts(toxic: int, wanted: frozenset[str] | None) -> DataFrame:
        return rows.mapInArrow(_count(toxic, wanted), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    hits = {r.feature: r.n for r in counts(1, None).filter(F.col("n") >= MIN_DOCS)
            .orderBy(F.col("n").desc(), "feature").limit(CANDIDATES).collect()}
    clean = {r.feature: r.n for r in counts(0, frozenset(hits)).collect()}
    odds = {f: log_odds(c, clean.get(f, 0), n_toxic, n_clean) for f, c in sorted(hits.items())
            if likelihood_ratio(c, clean.get(f, 0), n_toxic, n_clean) >= MIN_RATIO}
    odds = {f: v for f, v in odds.items() if v >= MIN_ODDS}
    index = {f: k for k, f in enumerate(odds)}
    windows = (rows.mapInArrow(_windows(odds, index), "key long, feats binary, labels binary")
               .orderBy("key", "feats", "labels").limit(WINDOWS).collect())
    feats = np.stack([np.frombuffer(r.feats, "<i4").reshape(WINDOW, -1) for r in windows]).astype(np.int64)
    z = np.stack([np.frombuffer(r.labels, "i1") for r in windows]).astype(np.int64)
    model = Chain(index, *fit_chain(feats, z, len(index)))
    xs = rows.mapInArrow(_summaries(model), "top double, total double, toxic int").collect()
    model.curve = fit_curve(np.array([[1.0, r.top, r.total] for r in xs]), np.array([float(r.toxic == 1) for r in xs]))
    return model


# --- scoring -----------------------------------------------------------------------------------

def _scores(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            score, begin, end, prob = [], [], [], []
            for text in batch.column("text").to_pylist():
                _, at, p = model.tag(text)
                score.append(model.score(p))
                hot = {k: float(v) for k, v in zip(at, p, strict=True) if v >= 0.5}
                spans = token_offsets(text, hot) if hot else []
                begin.append([a for a, _ in spans])
                end.append([b for _, b in spans])
                prob.append(list(hot.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score, pa.float64()), pa.array(begin, pa.list_(pa.int64())),
                 pa.array(end, pa.list_(pa.int64())), pa.array(prob, pa.list_(pa.float64()))],
                names=["id", "score", "span_start", "span_end", "span_p"])

    return run


def token_offsets(text: str, wanted: dict[int, float]) -> list[tuple[int, int]]:
    """Where the wanted tokens begin and end, in code points."""
    out, at = [], 0
    for k, token in enumerate(text.split()):
        at = text.index(token, at)
        if k in wanted:
            out.append((at, at + len(token)))
        at += len(token)
    return out


def score_documents(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) and the toxic spans (span_start, span_end in code points,
    span_p) of every row. A null or empty text has no token and gets the score of a text without evidence. Rows are
    scored one by one: repeated and null ids stay, an empty table stays empty, other columns are ignored.
    """
    rows = keyed_text(docs, id_col, text_col)
    found = rows.mapInArrow(_scores(rows.sparkSession.sparkContext.broadcast(model)),
                            "id long, score double, span_start array<long>, span_end array<long>, span_p array<double>")
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_start", "span_end", "span_p")


def reject_toxic(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under one half, columns as they are."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model_of.value.score(model_of.value.tag(t)[2]) for t in texts], dtype="float64")

    return docs.filter(score(F.coalesce(F.col(text_col), F.lit(""))) < 0.5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model)
