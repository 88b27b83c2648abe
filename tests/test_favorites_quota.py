import datetime as dt

from pyspark.sql import functions as F

from dealerlens.operators import favorites as fav
from dealerlens.operators import quota

T0 = dt.datetime(2024, 1, 1)


def _snapshot(spark):
    return spark.createDataFrame(
        [(1, 10, "toyota", "camry", 2019, 1000.0, 0.0, "gas", "automatic", True, False, 100.0, None, T0),
         (2, 20, "honda", "civic", 2018, 2000.0, 0.0, "", "manual", False, False, 200.0, None, T0)],
        "id long, user_id long, brand string, model string, model_year int, mileage double, engine double, "
        "fuel_type string, transmission string, clean_title boolean, has_accident boolean, "
        "predicted_price double, prediction_data string, created_at timestamp")


def _users(spark):
    return spark.createDataFrame([(10, "a@x", True), (20, "b@x", True)], "id long, email string, enabled boolean")


def _changes(spark, rows):
    return spark.createDataFrame(
        [(cid, T0 + dt.timedelta(minutes=cid), op, email, fid, brand, model, price, None, 2021, 60000.0, 2.5, "diesel", "manual", False, True)
         for cid, op, email, fid, brand, model, price in rows],
        "change_id long, changed_at timestamp, op string, user_email string, favorite_id long, brand string, "
        "model string, predicted_price double, prediction_data string, model_year int, mileage double, engine double, "
        "fuel_type string, transmission string, clean_title boolean, has_accident boolean")


def test_change_log_order_and_messages(spark):
    ch = _changes(spark, [
        (1, "update", "a@x", 1, "toyota", "corolla", 150.0),   # applied
        (2, "delete", "b@x", 1, None, None, None),              # not the owner
        (3, "delete", "a@x", 1, None, None, None),              # applied
        (4, "update", "a@x", 1, "toyota", "rav4", 1.0),         # deleted before -> not found
        (5, "update", "nobody@x", 2, "x", "y", 1.0),            # user not found
        (6, "create", "b@x", None, " ", "civic", 5.0),          # blank brand
        (7, "create", "b@x", None, "kia", "soul", 7.0),         # created
        (8, "update", "b@x", 9, "kia", "rio", 8.0),             # update of the created row (2 + 7)
        (9, "create", "nobody@x", None, "kia", "soul", 1.0),    # user not found
        (10, "create", "a@x", None, "kia", "soul", None),       # price missing
    ])
    out = fav.apply_changes(_snapshot(spark), ch, _users(spark))
    msgs = {r.change_id: (r.message, r.code) for r in out["outcomes"].collect()}
    assert msgs[1] == (None, None) and msgs[3] == (None, None) and msgs[7] == (None, None) and msgs[8] == (None, None)
    assert msgs[2] == (fav.MSG_NO_PERMISSION, 400)
    assert msgs[4] == (fav.MSG_FAV_NOT_FOUND, 404)
    assert msgs[5] == (fav.MSG_USER_NOT_FOUND, 404)
    assert msgs[6] == (fav.MSG_BRAND, 400)
    assert msgs[9] == (fav.MSG_USER_NOT_FOUND, 400)  # create failures are always 400
    assert msgs[10] == (fav.MSG_PRICE, 400)
    snap = {r.id: r for r in out["snapshot"].collect()}
    assert set(snap) == {2, 9}
    assert snap[9].model == "rio" and snap[9].user_id == 20
    assert (snap[9].model_year, snap[9].mileage, snap[9].engine, snap[9].fuel_type) == (2021, 60000.0, 2.5, "diesel")
    assert (snap[9].clean_title, snap[9].has_accident) == (False, True)
    assert snap[2].model == "civic"
    # every change is accounted for exactly once
    assert out["outcomes"].count() == ch.count()


def _brute_rejected(rows, limit, trunc):
    groups = {}
    for rid, ip, ts in rows:
        groups.setdefault((ip, trunc(ts)), []).append((ts, rid))
    out = set()
    for g in groups.values():
        for _, rid in sorted(g)[limit:]:
            out.add(rid)
    return out


def test_quota_rejected_with_one_hot_client(spark):
    rows = [(i, "10.0.0.1" if i % 3 else f"10.0.1.{i % 7}", T0 + dt.timedelta(seconds=37 * i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "request_id long, client_ip string, requested_at timestamp")
    got = {r.request_id for r in quota.rejected(df, (("hour", 3600, 5),)).collect()}
    want = _brute_rejected(rows, 5, lambda ts: ts.replace(minute=0, second=0, microsecond=0))
    assert got == want
    use = quota.usage(df, (("hour", 3600, 5),))
    assert use.agg(F.sum("n")).first()[0] == 3000


def test_ids_never_meet_and_outcomes_are_one_a_change(spark):
    snap = _snapshot(spark).withColumn("id", F.when(F.col("id") == 1, F.lit(1_000_000_005)).otherwise(F.col("id")).cast("long"))
    ch = _changes(spark, [(5, "create", "b@x", None, "kia", "soul", 7.0), (6, "update", "a@x", 1_000_000_005, "kia", "rio", 8.0)])
    out = fav.apply_changes(snap, ch, _users(spark))
    rows = {r.id: r for r in out["snapshot"].collect()}
    assert sorted(rows) == [2, 1_000_000_005, 1_000_000_010] and rows[1_000_000_005].user_id == 10 and rows[1_000_000_010].user_id == 20
    assert sorted(r.change_id for r in out["outcomes"].collect()) == [5, 6]


def test_numbers_and_absent_fields(spark):
    ch = _changes(spark, [(1, "create", "a@x", None, "kia", "soul", 7.0), (2, "update", "b@x", 2, "kia", "rio", 8.0)])
    bad = fav.apply_changes(_snapshot(spark), ch.withColumn("mileage", F.lit("many")), _users(spark))
    assert {r.change_id: r.message for r in bad["outcomes"].collect()} == {1: "Mileage must be a number", 2: None}
    lean = ch.drop("has_accident", "clean_title", "fuel_type").withColumn("mileage", F.lit("12.5"))
    rows = {r.id: r for r in fav.apply_changes(_snapshot(spark), lean, _users(spark))["snapshot"].collect()}
    assert (rows[2].mileage, rows[2].clean_title, rows[2].has_accident, rows[2].fuel_type) == (12.5, True, False, None)
    assert rows[3].brand == "kia" and rows[3].user_id == 10


def test_rejected_scans_once_a_side_and_limits_ranks(spark, sf):
    from dealerlens.sources.fixtures import fixture

    plan = quota.rejected(fixture(spark, sf, "requests"), (("hour", 3600, 2), ("day", 86400, 15)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("FileScan") <= 2 * 1


def test_one_odd_year_rejects_one_change(spark):
    years = ["NaN", "1e20", "-1e20", "2021.9", "late", None, "Infinity"]
    ch = _changes(spark, [(i, "create", "a@x", None, "kia", "soul", 7.0) for i in range(1, 8)])
    ch = ch.withColumn("model_year", F.element_at(F.array(*map(F.lit, years)), F.col("change_id").cast("int")))
    out = fav.apply_changes(_snapshot(spark), ch, _users(spark))
    bad = {r.change_id: r.message for r in out["outcomes"].collect()}
    assert bad == {1: "Model year must be a number", 2: None, 3: None, 4: None, 5: "Model year must be a number",
                   6: "Model year must be a number", 7: "Model year must be a number"}
    assert sorted(r.model_year for r in out["created"].collect()) == [-2**31, 2021, 2**31 - 1]
    miles = fav.apply_changes(_snapshot(spark), _changes(spark, [(1, "create", "a@x", None, "kia", "soul", 7.0)]).withColumn(
        "mileage", F.lit("NaN")), _users(spark))
    assert [r.message for r in miles["outcomes"].collect()] == ["Mileage must be a number"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*fav.SNAPSHOT_COLUMNS).collect())


def test_stream_upsert_replays_and_carries_on(spark, tmp_path):
    from dealerlens.streaming import upsert

    src, root = str(tmp_path / "changes"), str(tmp_path / "out")
    first = _changes(spark, [(1, "create", "a@x", None, "kia", "soul", 7.0), (2, "update", "b@x", 2, "kia", "rio", 8.0)])
    second = _changes(spark, [(3, "delete", "a@x", 1, None, None, None), (4, "update", "a@x", 3, "kia", "ev6", 9.0), (5, "update", "a@x", 99, "x", "y", 1.0)])
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = upsert.start(stream, _snapshot(spark), _users(spark), root, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    want = fav.apply_changes(fav.apply_changes(_snapshot(spark), first, _users(spark))["snapshot"], second, _users(spark))
    got = _rows(upsert.read(spark, root))
    assert got == _rows(want["snapshot"]) and {r[0]: r[3] for r in got} == {2: "rio", 3: "ev6"}
    assert [r.change_id for r in spark.read.parquet(upsert.rejected_path(root, 2)).collect()] == [5]
    upsert.apply_batch(second, 2, _users(spark), root)  # a replay
    assert _rows(upsert.read(spark, root)) == got


def test_upsert_compacts_and_never_gives_an_id_twice(spark, tmp_path):
    from dealerlens.streaming import upsert

    root, users, snap = str(tmp_path / "t"), _users(spark), _snapshot(spark)
    upsert.create(snap, root)
    batches = [[(5, "create", "a@x", None, "kia", "soul", 7.0)], [(6, "delete", "a@x", 7, None, None, None), (7, "delete", "b@x", 2, None, None, None)],
               [(11, "create", "b@x", None, "kia", "rio", 1.0)], [(12, "update", "a@x", 1, "vw", "golf", 2.0)]]
    for n, rows in enumerate(batches, 1):
        upsert.apply_batch(_changes(spark, rows), n, users, root, compact_every=2)
        assert upsert.mark(spark, root).base == n - n % 2
    assert {r[0]: r[3] for r in _rows(upsert.read(spark, root))} == {1: "golf", 18: "rio"}  # 7 was the largest ever given


def test_a_batch_writes_as_much_as_it_touches(spark, tmp_path):
    from dealerlens.streaming import upsert

    def size(path):
        return sum(p.stat().st_size for p in path.rglob("*.parquet"))

    many = spark.range(1, 20001).select("id", F.lit(10).cast("long").alias("user_id"), *[
        F.lit(v).cast(t).alias(c) for c, t, v in (
            ("brand", "string", "kia"), ("model", "string", "soul"), ("model_year", "int", 2020), ("mileage", "double", 1.0), ("engine", "double", 1.0),
            ("fuel_type", "string", "gas"), ("transmission", "string", "manual"), ("clean_title", "boolean", True), ("has_accident", "boolean", False),
            ("predicted_price", "double", 5.0))], F.uuid().alias("prediction_data"), F.lit(T0).alias("created_at"))
    upsert.create(many, str(tmp_path / "t"))
    upsert.apply_batch(_changes(spark, [(1, "update", "a@x", 77, "vw", "golf", 2.0)]), 1, _users(spark), str(tmp_path / "t"))
    assert size(tmp_path / "t" / "delta") < size(tmp_path / "t" / "base") / 20
    got = upsert.read(spark, str(tmp_path / "t"))
    assert got.count() == 20000 and got.where("model = 'golf'").count() == 1
