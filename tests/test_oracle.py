"""Spark queries against their DuckDB oracle at sf0.001 (the driver uses sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as entry

#: No SQL counterpart: values of the fitted ensemble, which test_boosting.py holds against plain loops.
ROWS_ONLY = {"train_and_score", "model_metrics", "validation_curve", "spot_check", "score_requests"}


def _own(names):
    return {n for n in names if not n.startswith("op") and n != "pipeline"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_rows_only():
    assert _own(entry.queries()) - set(entry.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(_own(entry.oracle_sql())))
def test_matches_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())


def test_entry_smoke(spark):
    assert entry.entry(spark).count() >= 0
