import hashlib

from cases import SF, documents, edge_docs, edge_rows, rows_of
from dealerlens.llm import merkle as op


def ordered(rows):
    return sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -2**63), r[1] or ""))


def brute(rows):
    rows = ordered(rows)
    out = []
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[:len(t) - len(t) // 2] + other[:len(t) // 2]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trees_are_equal_only_for_equal_texts():
    texts = ["", "\n", "\n\n", "a", "a b", "a  b", "a\nb", "a\n\nb", "a\n \nb", "a. b", "a.b", "One two three four five six seven. Eight.", "b a"]
    assert len({op.tree(t)[0] for t in texts}) == len(texts)
    assert op.tree("A b.\n\nC")[0] == op.tree("A b.\n\nC")[0]


def test_likeness_and_edit_range():
    a = "First sentence here is long enough. Second one follows it.\n\nAnother section with its own words. And more."
    b = a.replace("Second one", "Second two")
    x, y = op.tree(a), op.tree(b)
    assert op.likeness(x, x) == 1 and 0.6 < op.likeness(x, y) < 1
    assert op.likeness(x, op.tree("nothing of it")) == 0
    start, end = op.edit_range(x, y)
    assert start <= a.index("one") < end <= a.index("Another")
    assert op.edit_range(x, x) is None


def test_edge_cases(spark):
    got = op.fingerprint_documents(edge_docs(spark))
    assert rows_of(got, "doc_id", "n_chars", "edited_sha256") == brute(edge_rows())
    prints = {r.n_chars: r.fingerprint for r in got.filter("doc_id in (7, 9)").collect()}
    assert len(prints) == 1


def test_single_and_no_document(spark):
    one = op.fingerprint_documents(edge_docs(spark, [(3, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert op.fingerprint_documents(edge_docs(spark, [])).collect() == []


def test_query_matches_brute_force_and_tells_edits_from_strangers(spark):
    d = documents()
    got = op.op3_merkle(spark, SF).toPandas()
    want = brute(list(zip(d.doc_id.tolist(), d.text, strict=True)))
    assert sorted(zip(got.doc_id.tolist(), got.n_chars.tolist(), got.edited_sha256, strict=True), key=repr) == want
    assert (got.near_edited > got.near_next).mean() > 0.97
