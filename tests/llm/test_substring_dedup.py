import hashlib
import random

import pyarrow as pa
import pytest

from cases import documents, edge_docs, edge_rows, rows_of
from dealerlens.llm import substring_dedup as op

BLANKS = b" \t\n\x0b\x0c\r"


def brute(rows, window=13):
    last = 2**63 - 1
    split = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (i, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            least[w] = min(least.get(w, last), last if i is None else i)
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k:k + window])] < (last if i is None else i):
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    from pyspark.sql import functions as F

    return rows_of(df.withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha")


def passages():
    rng = random.Random(4)
    word = lambda n=50: f"w{rng.randrange(n)}"
    shared = [[word(400) for _ in range(n)] for n in (12, 13, 14, 60, 200)]
    rows = []
    for i in range(150):
        parts = [[word(3 if i % 7 == 0 else 4000) for _ in range(rng.randrange(40))] for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        rows.append((rng.choice([i, i, i, None]), " \t".join(w for p in parts for w in p)))
    rows += [(500, "x " * 400), (501, "y x x " * 200), (502, "x " * 12), (503, "x " * 13), (rows[3][0], rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_edge_rows_equal_brute_force(spark):
    assert got(op.dedup_substrings(edge_docs(spark))) == brute(edge_rows())
    assert op.dedup_substrings(edge_docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"HOT": 3, "SHARD_WORDS": 300, "STREAM_ROWS": 20, "CHUNK": 7}, {"HOT": 20, "RUN": 2, "ANCHOR": 13},
                                    {"ANCHOR": 1}])
def test_passages_equal_brute_force_whatever_the_bounds(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(op, name, value)
    rows = passages()
    assert got(op.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_automaton_knows_the_smallest_id_of_every_run():
    rng = random.Random(9)
    runs = [[b"%d" % rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    ids = [rng.randrange(1000) for _ in runs]
    for window in (1, 4):
        as_text = lambda x: pa.array([b" ".join(r).decode() for r in x], pa.string())
        made = op.Automaton(as_text(runs), ids, window)
        queries = runs[:20] + [[b"%d" % rng.randrange(4) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
        want = {}
        for q, run in enumerate(queries):
            for end in range(window, len(run) + 1):
                part = run[end - window:end]
                holds = [i for r, i in zip(runs, ids, strict=True) if any(r[k:k + window] == part for k in range(len(r)))]
                if holds:
                    want[q, end - 1] = min(holds)
        assert {(q, at): i for at, found, least in made.matches(as_text(queries))
                for q, i in zip(found.tolist(), least.tolist(), strict=True)} == want


def test_query_equals_brute_force_over_the_table(spark, sf):
    docs = documents()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))
    assert rows_of(op.op13_substring_dedup(spark, sf), "doc_id", "n_words", "n_removed", "kept_sha256") == brute(rows)
