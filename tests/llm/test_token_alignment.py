import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from cases import documents, edge_docs, edge_rows, rows_of
from dealerlens.llm import token_alignment as op

LEFT = functools.partial(op.byte_level, P.path("byte_bpe_50k.tiktoken"))
RIGHT = functools.partial(op.pieces, P.path("piece_bpe_32k.model"))
COLS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [(20, "a<|endoftext|>b <s> </s> <unk> <0x41> [x]"), (21, "▁ literal ▁"), (22, "日本語のテキスト、🙂🙃 é İ. ‍"), (23, " \t\n  two  spaces\r\n"),
       (24, "\x00\x01 nul"), (25, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (26, "<0x0A>\n")]


def units(hf, sp):
    """Bytes of each id by the files themselves: the JSON's byte-level letters, the model's pieces."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    return (lambda i: bytes(letters[c] for c in hf.id_to_token(i))), (
        lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_bytes, b_bytes = units(hf, sp)
    docs, held = [], Counter()
    for i, text in rows:
        a = hf.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        groups, x, y, p, q = [([], [])], 0, 0, 0, 0
        while p < len(a) or q < len(b):  # the token that ends first goes to the open group
            if x <= y and p < len(a):
                groups[-1][0].append(a[p])
                x += len(a_bytes(a[p]))
                p += 1
            else:
                groups[-1][1].append(b[q])
                y += len(b_bytes(b[q]))
                q += 1
            if x == y and p + q < len(a) + len(b):
                groups.append(([], []))
        groups = groups if a else []
        links = Counter((m, n) for g in groups for m in g[0] for n in g[1])
        held.update(links.keys())
        docs.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (m, _), n in held.items():
        most[m] = max(most[m], n)
    return [(i, len(a), len(b), len(g), sum(k.values()), sum(t for p, t in k.items() if held[p] == most[p[0]]),
             sum(t * held[p] for p, t in k.items()),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "")
            for i, a, b, g, k in docs]


def test_odd_texts_and_edge_rows_equal_brute_force(spark):
    rows = edge_rows() + ODD
    got = rows_of(op.link_counts(edge_docs(spark, rows), LEFT, RIGHT), *COLS)
    assert got == sorted(brute(rows), key=repr)
    assert {r[0]: r[-1] for r in got}[21] == ""  # its marks come back as spaces
    assert rows_of(op.link_counts(edge_docs(spark, [(1, None)]), LEFT, RIGHT), *COLS) == [(1, *[0] * 6, "")]
    assert op.link_counts(edge_docs(spark, [(1, "x")]).limit(0), LEFT, RIGHT).count() == 0


def test_documents_equal_brute_force_whatever_the_bounds(spark, monkeypatch):
    docs = documents()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))[:120]
    want = sorted(brute(rows), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(op.link_counts(df, LEFT, RIGHT), *COLS) == want
    monkeypatch.setattr(op, "KNOWN", 40)  # most pairs meet their counts in the join
    assert rows_of(op.link_counts(df, LEFT, RIGHT), *COLS) == want


def test_aligned_lists_are_the_groups(spark):
    text = "Tokenisation unterscheidet sich: naïveté, 123456."
    r = op.align(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), LEFT, RIGHT).orderBy("doc_id").collect()
    a = LEFT().token_bytes
    b = RIGHT().token_bytes
    x = y = 0
    for p, q in zip(r[0].a_ends, r[0].b_ends, strict=True):
        assert b"".join(a[i] for i in r[0].a_ids[x:p]) == b"".join(b[i] for i in r[0].b_ids[y:q])
        x, y = p, q
    assert (x, y) == (len(r[0].a_ids), len(r[0].b_ids)) and list(r[1][1:]) == [[], [], [], []]


@pytest.mark.parametrize("share", [0.01, 0.3, 0.9])
def test_splitting_finds_every_shared_end(share, monkeypatch):
    rng = random.Random(share)
    for steps in (2, 32):
        monkeypatch.setattr(op, "STEPS", steps)
        a, b, na, nb, want_a, want_b, base = [], [], [], [], [], [], 0
        for _ in range(30):
            n = rng.choice([1, 2, 10, 300, 3000])
            ends = [sorted({n} | {k for k in range(1, n) if rng.random() < share}) for _ in range(2)]
            both = sorted(set(ends[0]) & set(ends[1]))
            want_a += [len(a) + ends[0].index(c) + 1 for c in both]
            want_b += [len(b) + ends[1].index(c) + 1 for c in both]
            a += [base + e for e in ends[0]]
            b += [base + e for e in ends[1]]
            na.append(len(ends[0]))
            nb.append(len(ends[1]))
            base += n
        got = op.split_at_cuts(*(np.array(x, dtype=np.int64) for x in (a, b, na, nb)))
        assert (got[0].tolist(), got[1].tolist()) == (want_a, want_b)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    one = np.array([1], dtype=np.int64)
    got = op.Aligned(one * 0, np.array([5, 5, 6]), np.array([7, 8, 8, 8]), one * 3, one * 4, one * 3, one * 4)
    want = [x.tolist() for x in op._linked_pairs(got, 10, 10)]
    monkeypatch.setattr(op, "GROUP_LINKS", 1)
    assert [x.tolist() for x in op._linked_pairs(got, 10, 10)] == want == [[0] * 4, [57, 58, 67, 68], [2, 6, 1, 3]]
