"""Inputs that several operator tests share."""

import pandas as pd

SF = "/root/testdata/sf0.001"

CLASH = "id long, row string, range int, copy boolean, n_lines int, n_dropped string, print long, anchor int, hash long, file string, `group` int, size int, ids string"


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows and a null id."""
    long_text = " ".join(f"word{k % 977}" for k in range(60_000)) + "\n" + "a line that others hold too"
    return [(1, "A line that others hold too\nshort\n  a LINE that others hold too\t\nown line of document one"), (2, None), (3, ""),
            (4, long_text), (5, "a line that others hold too"), (5, "a line that others hold too"), (6, "\n\n"),
            (7, "été à la  plage\n\nLicensed under the Apache License, Version 2.0."), (None, "a line that others hold too\nnobody"),
            (8, "x"), (9, "été à la  plage\n\nLicensed under the Apache License, Version 2.0.")]


def edge_docs(spark, rows=None):
    """The edge rows as a table whose other columns have the names that operators use within."""
    rows = edge_rows() if rows is None else rows
    names = [c.strip().split()[0].strip("`") for c in CLASH.split(",")]
    return spark.createDataFrame([(*r, *([None] * len(names))) for r in rows], f"doc_id long, text string, {CLASH}")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
