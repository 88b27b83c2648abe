import re

import numpy as np
import pytest
import xxhash

from cases import SF, documents, edge_docs, edge_rows, rows_of
from dealerlens.llm import simhash as op
from dealerlens.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def linked(prints, bits=2):
    x = np.array(prints, dtype=np.uint64)
    return list(zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits, 1)), strict=True))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), linked(prints))
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [r[0] for r, q in zip(rows, root, strict=True) if q == root[k] and r[0] is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_home_anchor_is_among_every_neighbours_anchors(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    row, point, home = op.anchors(x, bits)
    assert (np.bincount(row[home], minlength=300) == 1).all()
    for k in range(300):
        flip = rng.choice(64, bits, replace=False)
        y = np.array([x[k] ^ np.uint64(sum(1 << int(b) for b in flip))])
        assert point[home & (row == k)][0] in op.anchors(y, bits)[1]


def test_dense_anchor_finds_the_same_components():
    rng = np.random.default_rng(5)
    x = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(600)], dtype=np.uint64))
    want = roots(len(x), linked(x))
    assert roots(len(x), zip(*op._dense_links(x, 2), strict=True)) == want
    one = np.zeros(len(x), np.int64), x, np.ones(len(x), bool)
    assert roots(len(x), zip(*op.links(*one, 2), strict=True)) == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(3, 3), (8, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(7, 30)}}


def test_edge_cases(spark):
    got = op.near_duplicates(edge_docs(spark))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute(edge_rows())
    gone = {i for i, _, c in brute(edge_rows()) if i != c}
    assert rows_of(op.keep_one(edge_docs(spark)), "doc_id") == sorted(((i,) for i, _ in edge_rows() if i not in gone), key=repr)


def test_empty_table(spark):
    assert op.near_duplicates(edge_docs(spark, [])).collect() == []


def test_query_matches_brute_force(spark):
    d = documents()
    got = rows_of(op.op2_simhash(spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == brute(list(zip(d.doc_id.tolist(), d.text, strict=True)))
