"""Model counts, the popular-model catalogue and category lists.

Every aggregate is a hash aggregate with map-side partial aggregation, so a
(manufacturer, model) pair holding a third of all rows is reduced inside each
map task before the shuffle. Per-group lists (models of one brand) only hold
popular models, each backed by at least ``min_listings`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LISTINGS = 15
TOP_TYPES = 12

# The condition list offered to users, in display order.
CONDITIONS = ("new", "like new", "excellent", "good", "fair", "salvage")
# Manufacturers whose first models the training report prints.
SAMPLE_MAKERS = ("toyota", "honda", "lexus", "ford", "bmw")


def _listings(canon: DataFrame) -> Column:
    """Number of listings: rows, or the sum of ``n`` where a row already stands for ``n`` of them."""
    return (F.sum("n") if "n" in canon.columns else F.count(F.lit(1))).alias("n")


def model_counts(canon: DataFrame) -> DataFrame:
    """A1: listings per (manufacturer, model); ``canon`` has a row a listing, or rows that count ``n`` listings."""
    return canon.groupBy("manufacturer", "model").agg(_listings(canon))


def popular_models(canon: DataFrame, min_listings: int = MIN_LISTINGS) -> DataFrame:
    """A2: pairs with at least ``min_listings`` rows (HAVING)."""
    return model_counts(canon).where(F.col("n") >= min_listings)


def popular_summary(popular: DataFrame) -> DataFrame:
    """A3: number of popular pairs and of distinct model names among them."""
    return popular.agg(
        F.count(F.lit(1)).alias("popular_pairs"),
        F.count_distinct("model").alias("popular_model_names"),
    )


def sorted_models(popular: DataFrame, makers: tuple[str, ...] | None = None, k: int | None = None) -> DataFrame:
    """(manufacturer, position, model), models sorted per maker; first ``k`` if given.

    A window partitioned by manufacturer over the popular pairs (one row per
    pair), so each task sorts one brand's popular models only.
    """
    df = popular.select("manufacturer", "model")
    if makers is not None:
        df = df.where(F.col("manufacturer").isin(*makers))
    w = Window.partitionBy("manufacturer").orderBy("model")
    df = df.withColumn("position", F.row_number().over(w))
    if k is not None:
        df = df.where(F.col("position") <= k)
    return df.select("manufacturer", "position", "model")


def brands_models(popular: DataFrame) -> DataFrame:
    """A5: manufacturer -> sorted popular model list (and its JSON text)."""
    return popular.groupBy("manufacturer").agg(
        F.count(F.lit(1)).alias("n_models"),
        F.sort_array(F.collect_set("model")).alias("models"),
    ).withColumn("models_json", F.to_json("models"))


def top_types(canon: DataFrame, k: int = TOP_TYPES) -> DataFrame:
    """The ``k`` most frequent types; ties broken by name. TakeOrdered, no full sort."""
    counts = canon.groupBy("type").agg(_listings(canon))
    top = counts.orderBy(F.desc("n"), F.asc("type")).limit(k)
    # k rows only: numbering them in one partition is free.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("type"))))


def category_values(canon: DataFrame, top: DataFrame) -> DataFrame:
    """(category, position, value) for the sorted distinct category lists."""
    spark = canon.sparkSession
    combined = canon.select("manufacturer", "fuel", "transmission", "drive").distinct()  # few rows, before each becomes four
    distinct_vals = (
        combined.select(F.explode(F.array(
            F.struct(F.lit("manufacturers").alias("category"), F.col("manufacturer").alias("value")),
            F.struct(F.lit("fuel_types").alias("category"), F.col("fuel").alias("value")),
            F.struct(F.lit("transmissions").alias("category"), F.col("transmission").alias("value")),
            F.struct(F.lit("drive_types").alias("category"), F.col("drive").alias("value")),
        )).alias("cv"))
        .select("cv.category", "cv.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    vtypes = top.select(F.lit("vehicle_types").alias("category"), F.col("type").alias("value"))
    conds = spark.createDataFrame([("conditions", i + 1, c) for i, c in enumerate(CONDITIONS)],
                                  "category string, position int, value string")
    w = Window.partitionBy("category").orderBy("value")
    sorted_vals = distinct_vals.unionByName(vtypes).withColumn("position", F.row_number().over(w))
    return sorted_vals.select("category", "position", "value").unionByName(conds)


def car_options(popular: DataFrame, canon: DataFrame, top: DataFrame) -> DataFrame:
    """The catalogue document (keys sorted) as one JSON text column.

    The document is the product's output: it holds only popular models and
    short category lists, so one row is its natural size.
    """
    bm = brands_models(popular).select(F.struct("manufacturer", "models").alias("e"))
    bm_doc = bm.agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("brands_models"))
    cats = category_values(canon, top).where(F.col("category") != "manufacturers")

    def lst(name: str):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("category") == name, F.struct("position", "value")))),
            lambda s: s["value"],
        ).alias(name)

    lists = cats.agg(*[lst(n) for n in ("conditions", "drive_types", "fuel_types", "transmissions", "vehicle_types")])
    both = lists.withColumn("brands_models", bm_doc.scalar())
    return both.select(
        F.to_json(F.struct("brands_models", "conditions", "drive_types", "fuel_types",
                           "transmissions", "vehicle_types")).alias("options")
    )


def write_car_options(document: DataFrame, path: str) -> None:
    """The catalogue document as one text file of JSON."""
    document.coalesce(1).write.mode("overwrite").text(path)
