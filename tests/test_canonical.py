from pyspark.sql import functions as F

from canonical_cases import CASES
from dealerlens.functions.text import strip_lower
from dealerlens.operators.canonicalize import canonicalize, with_steps


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "i int, manufacturer string, model string")
    return df.withColumn("manufacturer", strip_lower("manufacturer")).withColumn("model_raw", strip_lower("model"))


def test_hand_traced_cases_row_path(spark):
    df = _frame(spark, [(i, m, r) for i, (m, r, _, _) in enumerate(CASES)])
    got = {r.i: (r.model_walk, r.model) for r in with_steps(df).collect()}
    for i, (_, _, walk, alias) in enumerate(CASES):
        assert got[i] == (walk, alias), CASES[i]


def test_plan_is_lazy_and_does_not_shuffle(spark):
    df = canonicalize(_frame(spark, [(i, m, r) for i, (m, r, _, _) in enumerate(CASES)]))
    plan = df._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unicode_whitespace_and_digits(spark):
    rows = [
        (0, "toyota", "Camry LE"),       # NBSP separates tokens, as in Python
        (1, "honda", "\tcivic  ex "),     # tab and em space are stripped
        (2, "honda", "٢٠١٤ accord"),  # Arabic-Indic year digits
        (3, "ford", "f150\x1clariat"),         # 0x1C is whitespace for Python
    ]
    got = {r.i: r.model for r in with_steps(_frame(spark, rows)).collect()}
    assert got == {0: "camry", 1: "civic", 2: "accord", 3: "f-150"}


def test_canonicalize_keeps_other_columns(spark):
    df = _frame(spark, [(1, "bmw", "328i xdrive")]).withColumn("price", F.lit(1.0))
    out = canonicalize(df).collect()[0]
    assert out.model == "3 series" and out.price == 1.0 and out.i == 1


def test_output_is_short_unless_known_or_aliased(spark):
    from dealerlens.sources.dims import known_models, model_aliases

    df = _frame(spark, [(i, m, r) for i, (m, r, _, _) in enumerate(CASES)])
    long_ok = {n for v in known_models().values() for n in v} | {c for _, _, c in model_aliases()}
    for r in with_steps(df).collect():
        assert len(r.model.split()) <= 3 or r.model in long_ok


def test_groups_of_listings_have_the_counts_and_sums_of_listings(spark):
    from dealerlens.operators import catalogue as cat
    from dealerlens.operators import clean, encoders
    from dealerlens.sources.listings import LISTING_COLUMNS

    rows = [(str(1000 + 7 * i), "2010", m, t, None, None, ("gas", " GAS ", "diesel")[i % 3], "5", None, None, None, ("suv", "van")[i % 2])
            for i, (m, t) in enumerate([("toyota", "4 runner sr5"), (" Toyota", "4runner"), ("toyota", "Camry LE"), ("ford", "f150"),
                                        ("ford", "***"), ("ford", None), ("kia", "lifted sportage lx")] * 8)]
    listings = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in LISTING_COLUMNS))
    each, groups = clean.canonical_listings(listings), clean.canonical_groups(listings, ("fuel", "transmission", "drive", "type"))
    assert 0 < groups.count() < each.count()
    for of in (cat.model_counts, encoders.pair_stats, cat.top_types, lambda c: cat.category_values(c, cat.top_types(c))):
        assert sorted(map(tuple, of(groups).collect())) == sorted(map(tuple, of(each).collect()))


def test_long_listing_rules_are_not_left_to_the_interpreter(spark):
    from dealerlens.session import HUGE_METHOD, keep_compiled

    before = spark.conf.get(HUGE_METHOD)
    try:
        for given, kept in (("65535", "8000"), ("12000", "12000")):
            spark.conf.set(HUGE_METHOD, given)
            keep_compiled(spark)
            assert spark.conf.get(HUGE_METHOD) == kept
    finally:
        spark.conf.set(HUGE_METHOD, before)
