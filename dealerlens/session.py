"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings that hold unless the launcher or the caller set them.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT methods over 8000 bytecode bytes; past that size
    # whole-stage codegen is slower than per-operator code (Spark docs).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

#: Further settings for a session that this process starts on one machine.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}
LOCAL_SQL = {"spark.sql.shuffle.partitions": "8"}

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Folders written by :func:`materialize` in this process.
_written: list[str] = []


def get_spark(master: str | None = None, app: str = "dealerlens", **conf: str) -> SparkSession:
    """Return a session. Settings of the launcher (``--conf``, defaults file) and ``conf`` win.

    With ``master`` (a session on one machine: tests, bench) a few local settings
    are added; without it only :data:`SQL_DEFAULTS` fill what nobody set.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        for k, v in LOCAL_CONF.items():
            builder = builder.config(k, v)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    launched = spark.sparkContext.getConf()
    for k, v in {**SQL_DEFAULTS, **(LOCAL_SQL if master else {})}.items():
        if k not in conf and not launched.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def keep_compiled(spark: SparkSession) -> None:
    """Set the limit above which long generated methods are split, unless the launcher or the user set it: the listing
    rules are long expressions, and a method over 8000 bytes of bytecode is interpreted."""
    if spark.conf.get(HUGE_METHOD) == "65535" and not spark.sparkContext.getConf().contains(HUGE_METHOD):
        spark.conf.set(HUGE_METHOD, SQL_DEFAULTS[HUGE_METHOD])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, unless PYTHONPATH names its folder for them already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="dealerlens-ship-"), "dealerlens")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "dealerlens"))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share.

    Where it is unset, a session on one machine (``local[...]``) gets a private
    folder; on a cluster that would lose files, so it is an error there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"{CHECKPOINT_DIR} is not set: name a folder that the driver and all executors share")
    named = tempfile.mkdtemp(prefix="dealerlens-ckpt-")
    spark.conf.set(CHECKPOINT_DIR, named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; :func:`drop_materialized` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def slots(spark: SparkSession) -> int:
    """How many tasks run at once, which a barrier stage may not exceed. Spark's default parallelism is the number of cores
    unless the launcher set it; then the executors are counted."""
    sc = spark.sparkContext
    conf, cores = sc.getConf(), sc.defaultParallelism
    if conf.contains("spark.default.parallelism"):
        local = re.match(r"local(?:\[(\d+|\*))?", sc.master) if not sc.master.startswith("local-") else None
        if local:
            own = os.cpu_count() or 1 if local[1] == "*" else int(local[1] or 1)
        else:
            own = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - 1) * int(conf.get("spark.executor.cores", "1"))
        cores = min(cores, own)
    return max(1, cores // int(conf.get("spark.task.cpus", "1")))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as processes that do not know Spark's default file system need it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts lineage so a lost executor recomputes from the written files, and
    stops Catalyst from re-inlining expensive expressions into every consumer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of written tables now: it does so once the driver's JVM has collected their plans.

    The session holds its last plan, so that a small one goes before.
    """
    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()


def drop_materialized(spark: SparkSession) -> int:
    """Delete every table :func:`materialize` wrote; results built on them end. Returns their number."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _written and spark is not None and spark.sparkContext._jsc is not None:
        drop_materialized(spark)
