import re

import pandas as pd

from cases import SF, documents, edge_docs, rows_of
from dealerlens.llm import decontaminate as op

ITEM = "Tom has 12 apples and gives 5 apples to Anna, then Tom walks 3 km home."


def bench(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)) or [], "item_id long, text string")


def found(spark, items, docs):
    return {(r.doc_id, r.item_id): r for r in op.find_contamination(edge_docs(spark, docs), bench(spark, *items)).collect()}


def test_reparameterised_questions_are_found_and_inconsistent_ones_not(spark):
    item = "A shop sells 12 pens at 3 dollars each and 12 pads at 5 dollars each, how much for all of them"
    docs = [(1, f"before. {item}. after"), (2, item.replace("12", "40").replace("3 d", "7 d")), (3, item.replace("12", "40", 1)),
            (4, item.upper()), (5, "A shop sells 12 pens at 3 dollars each"), (6, None), (7, "")]
    got = found(spark, [item], docs)
    assert set(got) == {(1, 0), (2, 0), (4, 0)}
    assert got[2, 0].reparameterised and not got[1, 0].reparameterised


def test_tokens_types(spark):
    row = spark.createDataFrame([("Tom has 12 apples, then Anna walks 3km or 4 Miles. The end",)], "t string").select(op.tokens(op.F.col("t")).alias("x")).first()
    names = {"n": op._NAME, "u": op._UNIT}
    assert row.x == ["tom", "has", "12", "apples", "then", names["n"] + "anna", "walks", "3", names["u"] + "km", "or", "4", names["u"] + "miles", "the", "end"]


def test_edge_items_and_documents(spark):
    got = found(spark, [None, "", "1 2 3 4 5 6 7", "two words", ITEM], [(1, "these two words"), (1, "these two words"), (2, "9 8 7 6 5 4 3"), (None, "x " + ITEM)])
    assert set(got) == {(1, 3), (None, 4)}
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [ITEM], []) == {}


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs = edge_docs(spark, [(1, ITEM), (2, "clean"), (None, "clean too"), (3, None), (1, ITEM)])
    kept = op.decontaminate(docs, bench(spark, ITEM))
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == sorted([(2,), (3,), (None,)], key=repr)


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, [ITEM], [(1, "so " + ITEM), (2, "no")])) == {(1, 0)}


def test_query_matches_brute_force(spark):
    def norm(t):
        return " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "

    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    d = documents()
    texts = list(zip(d.doc_id, map(norm, d.text), strict=True))
    want = {(i, k) for k, t in zip(items.item_id, items.text, strict=True) for i, x in texts if norm(t) in x}
    got = set(rows_of(op.op5_decontamination(spark, SF), "doc_id", "item_id"))
    assert want and got == want


def test_one_edited_slot_or_a_value_of_two_roles_does_not_hide_an_item(spark):
    item = ("A shop sells 12 pens at 3 dollars each and then 12 pads at 5 dollars each, while a second shop down the road sells "
            "all of those 12 pencils together for a price that nobody in town would ever pay for them")
    roles = "If someone buys 2 pens at 2 dollars each, how much money does this person pay for all of the pens"
    docs = [(1, item.replace("12 pads", "40 pads")), (2, roles.replace("2 pens", "3 pens").replace("at 2", "at 5")), (3, roles.replace("2 pens", "3 pens", 1))]
    got = found(spark, [item, roles], docs)
    assert {(1, 0), (2, 1)} <= set(got) and not got[1, 0].reparameterised and got[2, 1].reparameterised
    assert got[1, 0].coverage < 1


def test_names_match_in_any_case(spark):
    item = "On the way Anna met Peter Brown and then Maria saw Paul near the old house where Julia and Simon Miller once lived"
    docs = [(1, "before " + item.lower() + " after"), (2, item.upper()), (3, item), (4, item.replace("Anna", "Berta").replace("Paul", "Carl")), (5, item.title())]
    assert set(found(spark, [item], docs)) == {(k, 0) for k in range(1, 6)}
    assert set(found(spark, [item.lower()], docs)) >= {(1, 0), (2, 0), (3, 0), (5, 0)}


def test_items_of_many_numbers_count_whole_and_match_literally(spark):
    items = ["12 15 18 21 24 27 30 33 what comes next", "1 2 3 4 5 6 7"]
    docs = [(1, "we had 3 4 5 what comes next is open"), (2, "so " + items[0] + "?"), (3, "count 1 2 3 4 5 6 7 on"), (4, "7 6 5 4 3 2 1"), (5, "8 9 3 4 5 1 2")]
    got = found(spark, items, docs)
    assert set(got) == {(2, 0), (3, 1)} and got[2, 0].coverage == got[3, 1].coverage == 1
