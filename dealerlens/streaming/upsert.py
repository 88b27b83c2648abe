"""Micro-batches of favourite changes applied to a table of id-bucketed deltas, merged when read.

``base/version=<batch>`` holds whole rows by bucket of the id; ``delta/batch=<batch>`` the rows a batch made, changed or deleted
(as marks of their ids), so a batch writes what it touches and reads the buckets it names. Every ``compact_every`` batches
the table is written anew as a base. ``marks/batch=<batch>`` is written last, with the largest id ever given and the base in
force: readers take the newest mark, a batch that broke off has none, and a replayed batch starts from the mark before its
own and overwrites its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dealerlens.operators import favorites as fav

BUCKETS = 64
COMPACT_EVERY = 20

_BUCKET = F.pmod(F.col("id"), F.lit(BUCKETS)).cast("int").alias("bucket")
_MARK = "batch_id long, high_water long, base long"


def _path(root: str, kind: str, name: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{kind}/{name}={batch_id:010d}"


def base_path(root: str, batch_id: int) -> str:
    return _path(root, "base", "version", batch_id)


def delta_path(root: str, batch_id: int) -> str:
    return _path(root, "delta", "batch", batch_id)


def rejected_path(root: str, batch_id: int) -> str:
    return _path(root, "rejected", "batch", batch_id)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _set_mark(spark: SparkSession, root: str, batch_id: int, high_water: int, base: int) -> None:
    mark = spark.createDataFrame([(batch_id, high_water, base)], _MARK)
    mark.coalesce(1).write.mode("overwrite").json(_path(root, "marks", "batch", batch_id))


def mark(spark: SparkSession, root: str, before: int | None = None) -> Row:
    """The newest mark, or the newest one before a batch. Batch 0 of the table is what it was created with."""
    marks = spark.read.schema(_MARK).json(f"{root.rstrip('/')}/marks")
    marks = marks if before is None else marks.where(F.col("batch_id") < before)
    return marks.orderBy(F.desc("batch_id")).select("batch_id", "high_water", "base").first()


def create(snapshot: DataFrame, root: str) -> None:
    """Write ``snapshot`` as the first base, unless the table exists."""
    spark = snapshot.sparkSession
    if _exists(spark, _path(root, "marks", "batch", 0)):
        return
    rows = snapshot.select(*fav.SNAPSHOT_COLUMNS, F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("written_by"), _BUCKET)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(base_path(root, 0))
    high_water = snapshot.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    _set_mark(spark, root, 0, high_water, 0)


def read(spark: SparkSession, root: str, at: Row | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The table as of a mark (the newest): of each id the row written last, if that is no deletion. ``buckets`` prunes the files."""
    at = at or mark(spark, root)
    base = spark.read.parquet(base_path(root, at.base))
    rows = base
    for batch_id in range(at.base + 1, at.batch_id + 1):  # fewer than COMPACT_EVERY
        rows = rows.unionByName(spark.read.schema(base.schema).parquet(delta_path(root, batch_id)))
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    if at.batch_id > at.base:
        rest = F.struct(*fav.SNAPSHOT_COLUMNS[1:], "deleted")
        rows = rows.groupBy("id").agg(F.max_by(rest, "written_by").alias("r")).select("id", "r.*")
    return rows.where(~F.col("deleted")).select(*fav.SNAPSHOT_COLUMNS)


def apply_batch(batch: DataFrame, batch_id: int, users: DataFrame, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """Apply one batch (numbers from 1 on, without gaps)."""
    spark = batch.sparkSession
    before = mark(spark, root, batch_id)
    named = batch.where(F.col("favorite_id").isNotNull()).select(F.pmod("favorite_id", F.lit(BUCKETS)).cast("int").alias("b"))
    buckets = [r.b for r in named.distinct().collect()]  # BUCKETS at most
    out = fav.apply_changes(read(spark, root, before, buckets), batch, users, above=before.high_water)
    gone = out["deleted"].select("id").distinct().withColumn("deleted", F.lit(True))
    rows = out["written"].withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True)
    rows = rows.withColumn("written_by", F.lit(batch_id).cast("long")).withColumn("bucket", _BUCKET)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(delta_path(root, batch_id))
    out["outcomes"].where(F.col("message").isNotNull()).write.mode("overwrite").parquet(rejected_path(root, batch_id))
    given = out["created"].agg(F.max("id")).first()[0] or 0
    now = Row(batch_id=batch_id, high_water=max(before.high_water, given), base=before.base)
    if batch_id - before.base >= compact_every:
        whole = read(spark, root, now).withColumn("deleted", F.lit(False)).withColumn("written_by", F.lit(batch_id).cast("long"))
        whole.withColumn("bucket", _BUCKET).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            base_path(root, batch_id))
        now = Row(batch_id=batch_id, high_water=now.high_water, base=batch_id)
    _set_mark(spark, root, batch_id, now.high_water, now.base)


def start(changes: DataFrame, initial_snapshot: DataFrame, users: DataFrame, root: str, checkpoint: str,
          compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Stream changes into the table under ``root``, which is created from ``initial_snapshot`` if it is not there."""
    create(initial_snapshot, root)
    return (changes.writeStream.foreachBatch(lambda batch, n: apply_batch(batch, n + 1, users, root, compact_every))
            .option("checkpointLocation", checkpoint).start())
