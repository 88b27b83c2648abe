import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from dealerlens.session import get_spark, shared_dir
spark = get_spark({master})
{check}
"""


def _run(check, master="None", **conf):
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = " ".join(f"--conf {k}={v}" for k, v in conf.items())
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--master local[1] --conf spark.ui.enabled=false {args} pyspark-shell"}
    code = CODE.format(root=root, master=master, check=check)
    return subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)


def test_launcher_settings_win_and_shared_folder_is_read():
    out = _run("print(spark.conf.get('spark.sql.shuffle.partitions'), shared_dir(spark))",
               **{"spark.sql.shuffle.partitions": 400, "spark.checkpoint.dir": "/tmp/named-by-launcher"})
    assert out.stdout.split()[-2:] == ["400", "/tmp/named-by-launcher"], out.stderr[-800:]


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from dealerlens.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None),
                              sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_materialized_tables_can_be_dropped(spark):
    from dealerlens import session

    before = list(session._written)
    session._written.clear()
    session.materialize(spark.range(3), "kept_shortly")
    assert session.drop_materialized(spark) == 1
    session._written.extend(before)
