import duckdb
import numpy as np
import pytest

from cases import SF, edge_docs, edge_rows, rows_of
from dealerlens.llm import line_dedup as op

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=10):
    rank = {None: float("inf")}
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(op.line_key(line), set()).add(rank.get(i, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k = op.line_key(x)
            own = holders[k]
            if len(k) < min_chars or len(own) < 2 or min(own) == rank.get(i, i):
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_minimal_perfect_hash_gives_each_key_a_slot_of_its_own():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    h1[:50] = h1[0]  # keys that share one half
    levels = op.build_levels(h1, h2)
    assert sorted(op.slots(levels, h1, h2)) == list(range(5000))


def test_edge_cases(spark):
    got = op.dedup_lines(edge_docs(spark))
    assert got.columns.count("n_lines") == 1 and "range" in got.columns
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == brute(edge_rows())


@pytest.mark.parametrize("hot", [10_000, 0])
def test_hot_lines_and_many_shards_change_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT_ROWS", hot)
    got = op.dedup_lines(edge_docs(spark), shard_keys=2)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == brute(edge_rows())


def test_empty_table(spark):
    assert op.dedup_lines(edge_docs(spark, [])).collect() == []


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = rows_of(op.op1_line_dedup(spark, SF), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(con.execute(op.OP1_SQL).fetchall(), key=repr)
