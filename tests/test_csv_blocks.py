import csv
import random

from pyspark.sql import functions as F

from dealerlens.sources.csv_blocks import quoted_records
from dealerlens.sources.listings import LISTING_COLUMNS, read_listings_csv


def _write(path, rng, n, end):
    fields = ["a", "", "two words", "x,y", 'say ""no""', "line\none", "a\n\nb\n", '"', "NA", "é", "q\"\n\"q,"]
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["id", *LISTING_COLUMNS, "description"])
        for k in range(n):
            out.writerow([k, *(rng.choice(fields) for _ in LISTING_COLUMNS), rng.choice(fields) * rng.choice([1, 1, 40])])


def test_one_file_is_read_by_many_tasks_like_the_whole_file_reader(spark, tmp_path):
    rng = random.Random(6)
    for name, n, end in (("a.csv", 900, "\n"), ("b.csv", 300, "\r\n"), ("c.csv", 0, "\n")):
        _write(tmp_path / name, rng, n, end)
    whole = read_listings_csv(spark, str(tmp_path), "id", by_file=True)
    want = sorted(map(tuple, whole.collect()), key=repr)
    assert len(want) == 1200
    for size in ("2048", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            blocks = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.csv")).rdd.getNumPartitions()
            got = sorted(map(tuple, read_listings_csv(spark, str(tmp_path), "id").collect()), key=repr)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert (blocks > 20) == (size == "2048") and got == want


def test_blocks_inside_one_long_field_and_open_quotes(spark, tmp_path):
    text = 'h,i\n1,"' + "line\n" * 3000 + '"\n\n2,x\n3,"never closed\n4,y\n'
    (tmp_path / "f.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r.record, r.is_first) for r in quoted_records(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([("h,i", True), ('1,"' + "line\n" * 3000 + '"', False), ("2,x", False), ('3,"never closed\n4,y', False)])


def test_empty_folder_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("")
    assert quoted_records(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
