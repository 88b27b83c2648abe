import itertools
import zlib

import numpy as np
import pandas as pd

from cases import SF, edge_docs, edge_rows
from dealerlens.llm import toxicity as op


def test_marginals_match_enumeration():
    chain = op.Chain({"=bad": 0}, np.array([3.0]), -2.0, -1.0, np.array([[.5, -1.], [.2, .8]]))
    tokens = "a bad b c bad d e f bad! g".split()
    n, at, p = chain.tag(" ".join(tokens))
    total, on = 0.0, np.zeros(len(tokens))
    for y0, *ys in itertools.product((0, 1), repeat=len(tokens) + 1):
        s, prev = y0 * chain.start, y0
        for t, y in zip(tokens, ys, strict=True):
            s += chain.trans[prev, y] + y * (chain.bias + 3.0 * t.startswith("bad"))
            prev = y
        total, on = total + np.exp(s), on + np.exp(s) * np.array(ys)
    assert n == 10 and at == [1, 4, 8]
    assert np.allclose(p, (on / total)[at])


def test_fitted_chain_tags_the_labelled_tokens():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (200, 20, 1))  # feature 0: toxic, 1: not, 2: none
    z = (x[..., 0] == 0).astype(int)
    w, bias, _, _ = op.fit_chain(x, z, 2)
    assert w[0] + bias > 1 and w[1] + bias < -1 and bias < 0


def test_offsets_are_code_points():
    text = "  été  bad\nword bad!"
    assert [text[a:b] for a, b in op.token_offsets(text, {1: 1.0, 3: 1.0})] == ["bad", "bad!"]


def labelled(spark, n=400):
    rows = [(k, ("you vile crook " if k % 4 == 0 else "you kind friend ") + " ".join(f"w{(k * 7 + j) % 50}" for j in range(30))) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(n)] + [(None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_fit_and_edge_cases(spark):
    docs, labels = labelled(spark)
    model = op.fit(docs, labels)
    assert {"=vile", "=crook"} <= set(model.index)
    rows = [*edge_rows(), (20, "such a vile crook"), (21, "VILE!")]
    got = op.score_documents(edge_docs(spark, rows), model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert set(got[got.predicted == 1].doc_id) == {20, 21}
    spans = got[got.doc_id == 20].iloc[0]
    assert ["such a vile crook"[a:b] for a, b in zip(spans.span_start, spans.span_end, strict=True)] == ["vile", "crook"]
    assert op.score_documents(edge_docs(spark, []), model).collect() == []
    kept = op.reject_toxic(edge_docs(spark, rows), model)
    assert kept.count() == len(rows) - 2 and kept.columns == edge_docs(spark, []).columns


def test_without_labels_every_text_is_clean(spark):
    docs, labels = labelled(spark, 20)
    model = op.fit(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in op.score_documents(docs, model).collect()} == {0}


def test_held_out_rows_are_told_apart(spark):
    sf = SF.replace("0.001", "0.01")
    got = op.op6_toxicity(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.toxic).mean() > 0.93
    assert out[out.toxic == 1].score.mean() > out[out.toxic == 0].score.mean() + 0.4
