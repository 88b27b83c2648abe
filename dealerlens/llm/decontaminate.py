"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become tokens: words, numbers, names (capitalised words within a sentence) and units (after a number). A template
has a typed placeholder for each number, name and unit and the lower-cased word otherwise, so a question with other
numbers or names has the same template; names are read as plain words too, so that a passage in another case has it as well. Windows of ``WINDOW`` template tokens are hashed, and the documents' windows are
hash-joined to the benchmark's. Matches are gathered by document, item and alignment, and each value of the item is judged
within its alignment. One that is replaced at every place may become several values (it plays several roles). One that is
kept at some places and replaced at others stands for the value it has at most of them; windows with another one (all of
them, if no value has the majority) are dropped. A document is contaminated by an item if the remaining windows cover ``MIN_COVER`` of the
item's tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerlens.llm.common import ROW_KEY, table, with_row_key
from dealerlens.session import materialize

WINDOW = 5
MIN_COVER = 0.8
#: Words that a benchmark window needs beside its slots, so that rows of numbers do not match each other; others match literally.
MIN_WORDS = 2
#: Benchmark windows are broadcast up to this many (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_WINDOWS = 500_000

# Names of units that may follow a number.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "h", "hr", "hrs", "hour", "hours", "min",
         "minute", "minutes", "s", "sec", "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "mile", "miles", "feet", "foot", "ft", "inch", "inches", "meter", "meters", "metre", "metres", "kilometer", "kilometers",
         "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "percent", "degrees", "mph")

#: Placeholders, from the private use area: they sort after all letters, and mark names and units in the tokens.
_NUMBER, _NAME, _UNIT, _AFTER = "\ue000", "\ue001", "\ue002", "\ue003"
_UNIT_RULE = r"([0-9]) ?\b((?i:" + "|".join(UNITS) + r"))\b"
_GLUED_UNIT_RULE = r"([0-9])((?i:" + "|".join(UNITS) + r"))\b"
_NAME_RULE = r"(?<=[\p{L}0-9,;]\x20)(\p{Lu}\p{Ll}+)(?![\p{L}0-9])"
_TOKEN = rf"[{_NAME}{_UNIT}]?[\p{{L}}\p{{M}}]+|[0-9]+(?:[.,:/][0-9]+)*"


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text; names and units carry their placeholder in front."""
    units = F.regexp_replace(F.regexp_replace(text, _UNIT_RULE, f"$1 {_UNIT}$2"), _GLUED_UNIT_RULE, f"$1 {_UNIT}$2")
    marked = F.when(text.rlike("[0-9]"), units).otherwise(text)
    return F.regexp_extract_all(F.lower(F.regexp_replace(marked, _NAME_RULE, _NAME + "$1")), F.lit(_TOKEN), F.lit(0))


def _is_slot(token: Column) -> Column:
    return (token >= _NUMBER) & (token < _AFTER) | (token >= "0") & (token < ":")


def _placeholder(token: Column) -> Column:
    return (F.when((token >= _NUMBER) & (token < _AFTER), F.substring(token, 1, 1))
            .when((token >= "0") & (token < ":"), F.lit(_NUMBER)).otherwise(token))


def _is_name(token: Column) -> Column:
    return (token >= _NAME) & (token < _UNIT)


def _is_quantity(token: Column) -> Column:
    return _is_slot(token) & ~_is_name(token)


def windows(rows: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """``rows`` without its text, with n_tokens, size, pos, hash and slots (the value at each token, empty where it is no slot) of every
    template window of each of ``sizes``. A window with names comes under a second reading too, its names as plain words,
    and one of fewer than MIN_WORDS words besides numbers and units under a third, all its tokens literal."""
    keep = [c for c in rows.columns if c != text_col]
    raw = rows.select(*keep, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"))
    named = F.exists("raw", _is_name)
    plain = F.transform("raw", lambda t: F.when(_is_name(t), F.substr(t, F.lit(2))).otherwise(t))
    numbered = F.exists("raw", _is_quantity)
    both = raw.select(*keep, "raw", F.size("raw").alias("n_tokens"), F.when(named, plain).alias("plain"),
                      F.when(named, F.transform("raw", _is_name)).alias("names"), F.when(numbered, F.transform("raw", _is_quantity)).alias("quantities"))

    def ids(tokens_col: str) -> Column:
        return F.transform(tokens_col, lambda t: F.xxhash64(_placeholder(t)))

    def vals(tokens_col: str) -> Column:
        return F.when(F.exists(tokens_col, _is_slot), F.transform(tokens_col, lambda t: F.when(_is_slot(t), t)))

    literal = F.transform("raw", lambda t: F.xxhash64(F.when((t >= _NUMBER) & (t < _AFTER), F.substr(t, F.lit(2))).otherwise(t)))
    ready = both.select(*keep, "n_tokens", "names", "quantities", F.when(F.col("quantities").isNotNull(), literal).alias("literal_ids"),
                        F.lit(None).cast("array<string>").alias("no_vals"), ids("raw").alias("ids"), vals("raw").alias("vals"),
                        ids("plain").alias("plain_ids"), vals("plain").alias("plain_vals"))

    def of_size(size: int) -> Column:
        def cut(i: Column, ids: str, vals: str) -> Column:
            return F.struct(F.lit(size).alias("size"), i.alias("pos"),
                            F.xxhash64(*(F.get(ids, i + k) for k in range(size))).alias("hash"),
                            F.array_join(F.slice(vals, i + 1, size), " ", "").alias("slots"))

        starts = F.sequence(F.lit(0), F.col("n_tokens") - size)
        every = F.transform(starts, lambda i: cut(i, "ids", "vals"))
        with_names = F.filter(starts, lambda i: F.array_contains(F.slice("names", i + 1, size), True))
        again = F.transform(with_names, lambda i: cut(i, "plain_ids", "plain_vals"))
        few_words = F.filter(starts, lambda i: F.size(F.filter(F.slice("quantities", i + 1, size), lambda q: ~q)) < min(MIN_WORDS, size))
        exact = F.transform(few_words, lambda i: cut(i, "literal_ids", "no_vals"))
        more = (F.when(F.col("names").isNull() & F.col("quantities").isNull(), every).when(F.col("names").isNull(), F.concat(every, exact))
                .when(F.col("quantities").isNull(), F.concat(every, again)).otherwise(F.concat(every, again, exact)))
        return F.when(F.col("n_tokens") >= size, more)

    # Outer explodes: for an inner one the optimizer tests the array's size below, where it builds the windows once more.
    each = ready.select(*keep, "n_tokens", F.explode_outer(F.array(*map(of_size, sizes))).alias("cuts")) if len(sizes) > 1 else \
        ready.select(*keep, "n_tokens", of_size(sizes[0]).alias("cuts"))
    return (each.select(*keep, "n_tokens", F.explode_outer("cuts").alias("w")).filter("w is not null")
            .select(*keep, "n_tokens", "w.size", "w.pos", "w.hash", F.coalesce("w.slots", F.lit("")).alias("slots")))


def _values(slots: Column) -> Column:
    return F.when(slots == "", F.array().cast("array<string>")).otherwise(F.split(slots, " "))


def _conflicting(pairs: Column) -> Column:
    """Of an alignment's pairs (at, item, doc), those that its windows must not hold."""
    def items(of: Column) -> Column:
        return F.array_distinct(F.transform(of, lambda p: p["item"]))

    mixed = F.array_intersect(items(F.filter(pairs, lambda p: p["item"] == p["doc"])), items(F.filter(pairs, lambda p: p["item"] != p["doc"])))

    def loses(p: Column) -> Column:
        own = F.filter(pairs, lambda q: q["item"] == p["item"])
        return F.array_contains(mixed, p["item"]) & (2 * F.size(F.filter(own, lambda q: q["doc"] == p["doc"])) <= F.size(own))

    return F.when(F.size(mixed) > 0, F.filter(pairs, loses)).otherwise(F.slice(pairs, 1, 0))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, ipos, hash, islots, n_cover) of the benchmark's windows: of WINDOW tokens, or a shorter item whole.
    Typed windows with fewer than MIN_WORDS words (or no other token at all) are left out: such windows match by their plain or literal
    reading only. n_cover is the number of all tokens of an item (of the longest, where items share an id)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    cuts = windows(items, "text", list(range(1, WINDOW + 1))).filter(F.col("size") == F.least(F.lit(WINDOW), "n_tokens"))
    words = F.col("size") - F.size(F.filter(_values(F.col("slots")), lambda v: v != ""))
    cuts = cuts.filter(words >= F.least(F.lit(MIN_WORDS), "size")).dropDuplicates(["item_id", "size", "pos", "hash", "slots"])
    cover = cuts.groupBy(F.col("item_id").alias("of")).agg(F.max("n_tokens").alias("n_cover"))
    return cuts.join(cover, F.col("item_id").eqNullSafe(F.col("of"))).select(
        "item_id", "size", F.col("pos").alias("ipos"), "hash", F.col("slots").alias("islots"), "n_cover")


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, coverage, n_alignments, first_token and reparameterised (some slot has another value) of every
    contaminated document and item.

    A null or empty text is clean; a null or empty item matches nothing, one of numbers alone only its like; rows that share an id (or
    a null id) are one document, items likewise; with an empty table nothing is found; other columns are ignored.
    """
    bench = materialize(benchmark_windows(benchmark), "benchmark_windows")
    sizes = sorted(r.size for r in bench.select("size").distinct().collect()) or [WINDOW]  # WINDOW numbers at most
    small = bench.count() <= BROADCAST_WINDOWS
    own = windows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", sizes)
    met = own.drop("n_tokens").join(F.broadcast(bench) if small else bench, ["size", "hash"])
    item_values, values = _values(F.col("islots")), _values(F.col("slots"))
    pairs = F.filter(F.transform(item_values, lambda v, k: F.struct((F.col("ipos") + k).alias("at"), v.alias("item"), F.get(values, k).alias("doc"))),
                     lambda p: p["item"] != "")
    aligned = (met.select("doc_id", "item_id", "n_cover", "size", (F.col("pos") - F.col("ipos")).alias("shift"), F.struct("ipos", pairs.alias("pairs")).alias("w"))
               .groupBy("doc_id", "item_id", "n_cover", "size", "shift").agg(F.collect_set("w").alias("ws")))
    all_pairs = aligned.withColumn("pairs", F.array_distinct(F.flatten(F.transform("ws", lambda w: w["pairs"]))))
    judged = all_pairs.select("doc_id", "item_id", "n_cover", "size", "shift", "ws", _conflicting(F.col("pairs")).alias("bad"))
    held = judged.withColumn("ws", F.filter("ws", lambda w: ~F.arrays_overlap(w["pairs"], F.col("bad")))).filter(F.size("ws") > 0)
    ipos = F.transform("ws", lambda w: w["ipos"])
    tokens_of = F.array_distinct(F.flatten(F.transform(ipos, lambda p: F.sequence(p, p + F.col("size") - 1))))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("covered"))))
    found = (held
             .select("doc_id", "item_id", "n_cover", (F.col("shift") + F.array_min(ipos)).alias("at"), tokens_of.alias("covered"),
                     F.exists("ws", lambda w: F.exists(w["pairs"], lambda p: p["item"] != p["doc"])).alias("other"))
             .groupBy("doc_id", "item_id", "n_cover")
             .agg(covered.alias("covered"), F.count("*").alias("n_alignments"), F.min("at").alias("first_token"),
                  F.max("other").alias("reparameterised")))
    return (found.withColumn("coverage", F.col("covered") / F.col("n_cover")).filter(F.col("coverage") >= MIN_COVER)
            .select("doc_id", "item_id", "coverage", "n_alignments", "first_token", "reparameterised"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its contaminated rows, each judged for itself whatever its id (``id_col`` is not read); columns as they are."""
    keyed = with_row_key(docs)
    bad = materialize(find_contamination(keyed, benchmark, ROW_KEY, text_col).select(F.col("doc_id").alias(ROW_KEY)).distinct(), "contaminated")
    return keyed.join(bad, ROW_KEY, "left_anti").drop(ROW_KEY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
