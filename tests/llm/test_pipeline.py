import __spark_entry__
import corpus_pipeline as pipeline
from cases import SF, documents, edge_docs, rows_of
from dealerlens.llm import simhash
from test_decontaminate import ITEM
from test_line_dedup import brute as kept_lines
from test_simhash import brute as near_copies


def test_stages_in_order_and_registered():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "packing"]
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_line_and_near_copy_stages_match_brute_force(spark):
    d = documents()
    rows = list(zip(d.doc_id.tolist(), d.text, strict=True))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = pipeline.line_dedup_stage(spark, docs, SF)
    assert lines.columns == docs.columns
    want = [(i, t, len(t)) for i, t, _, _ in kept_lines(rows)]
    assert rows_of(lines, "doc_id", "text", "n_chars") == sorted(want, key=repr)
    near = pipeline.near_dedup_stage(spark, docs, SF)
    assert rows_of(near, "doc_id") == sorted(((i,) for i, _, c in near_copies(rows) if i == c), key=repr)
    assert simhash.MAX_BITS == 2 and simhash.SHINGLE == 3


def test_whole_run(spark):
    pieces = pipeline.run(spark, SF).toPandas()
    assert 0 < pieces.doc_id.nunique() <= 200
    assert (pieces.groupby("sequence_id").length.sum() <= 4096).all()
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_empty_documents_pass_every_stage(spark):
    docs = edge_docs(spark, [])
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_contaminated_documents_go(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = edge_docs(spark, [(1, f"Some words of its own. {items} And more."), (2, "A clean text."), (3, ITEM)])
    assert rows_of(pipeline.decontaminate_stage(spark, docs, SF), "doc_id") == [(2,), (3,)]


def test_rows_of_null_and_repeated_ids_go_one_by_one(spark):
    copy, other, third = (" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "blue", "green"))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = edge_docs(spark, [(1, copy), (None, copy), (None, other), (2, third), (2, copy), (3, third), (None, "lone"), (None, "lone")])
    near = pipeline.near_dedup_stage(spark, docs, SF)
    assert near.columns == docs.columns
    assert rows_of(near, "doc_id", "text") == sorted([(1, copy), (None, other), (2, third), (None, "lone")], key=repr)
    docs = edge_docs(spark, [(None, item), (None, "A clean text."), (4, item), (4, "Another clean text.")])
    clean = pipeline.decontaminate_stage(spark, docs, SF)
    assert clean.columns == docs.columns
    assert rows_of(clean, "doc_id", "text") == sorted([(None, "A clean text."), (4, "Another clean text.")], key=repr)
