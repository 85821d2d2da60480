import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from vitrine.sources import files
from vitrine.sources.files import upsert_store
from vitrine.streaming import streams


@pytest.fixture(scope="module")
def folder(data, tmp_path_factory):
    to = tmp_path_factory.mktemp("events")
    shutil.copy(f"{data}/events.parquet", to / "part-0.parquet")
    return str(to)


def source(spark, folder):
    return streams.read_events(spark, folder, folder)


def test_windows_equal_batch(spark, data, folder):
    got = streams.run_once(streams.windowed(source(spark, folder), "ts", "event_type", "value", "7 days"), "weeks", "complete")
    batch = spark.read.parquet(f"{data}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "7 days"), "event_type").count()
    assert sorted((r["start"], r["event_type"], r["n"]) for r in got.collect()) == sorted((r["window"]["start"], r["event_type"], r["count"]) for r in batch.collect())


def test_sliding_sessions_and_duplicates(spark, data, folder):
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert streams.run_once(streams.windowed(source(spark, folder), "ts", "event_type", "value", "7 days", "1 day"), "slide", "complete").agg(F.sum("n")).first()[0] == 7 * n
    assert streams.run_once(streams.sessions(source(spark, folder), "ts", "user_id", "6 hours"), "sess", "complete").agg(F.sum("n")).first()[0] == n
    assert streams.run_once(streams.deduplicated(source(spark, folder), "ts", ["event_id"]), "dedup").count() == n


def test_transitions_equal_batch(spark, data, folder):
    got = streams.run_once(streams.transitions(source(spark, folder), "user_id", "ts", "event_type"), "moves")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("b", F.lag("event_type").over(w)).filter("b <> event_type")
    assert got.count() == batch.count()


def test_upsert_sink(spark, data, folder, tmp_path):
    s = source(spark, folder).withColumn("day", F.to_date("ts")).select("user_id", "day", "event_id")
    streams.upsert_sink(s, str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id", "day"], "day", ["event_id"]).awaitTermination()
    want = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.to_date("ts").alias("day")).distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_upsert_keeps_stored_rows_without_a_date(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k long, day date, n long").withColumn("day", F.to_date("day"))
    a, b, none = datetime.date(2025, 3, 1), datetime.date(2025, 3, 2), None
    for batch in (rows((1, none, 1), (2, none, 1), (3, a, 1), (4, a, 1), (5, b, 1)), rows((1, none, 2), (3, a, 2)), rows((6, none, 3))):
        upsert_store(spark, str(tmp_path / "out"), batch, ["k", "day"], "day", ["n"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "day", "n").collect()} == {(1, none, 2), (2, none, 1), (3, a, 2), (4, a, 1), (5, b, 1), (6, none, 3)}


KEEP = (["k"], "day", ["n"])


def test_upsert_keeps_columns_that_only_one_side_has(spark, tmp_path):
    store, a = str(tmp_path / "out"), datetime.date(2025, 3, 1)
    upsert_store(spark, store, spark.createDataFrame([(1, a, 1), (2, a, 1)], "k long, day date, n long"), *KEEP)
    upsert_store(spark, store, spark.createDataFrame([(3, a, 1, "x")], "k long, day date, n long, extra string"), *KEEP)
    upsert_store(spark, store, spark.createDataFrame([(1, a, 2)], "k long, day date, n long"), *KEEP)
    got = files.read_store(spark, store, "day")
    assert {tuple(r) for r in got.select("k", "n", "extra").collect()} == {(1, 2, None), (2, 1, None), (3, 1, "x")}


def test_upsert_of_many_dates_keeps_them_all(spark, tmp_path):
    store = str(tmp_path / "out")
    many = lambda n, v: spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 1201).cast("int").alias("day"), F.lit(v).alias("n"))
    upsert_store(spark, store, many(2402, 1), *KEEP)
    upsert_store(spark, store, many(1201, 2), *KEEP)
    assert [tuple(r) for r in files.read_store(spark, store, "day").groupBy("n").count().orderBy("n").collect()] == [(1, 1201), (2, 1201)]


def test_interrupted_merges(spark, tmp_path):
    store, a = str(tmp_path / "out"), datetime.date(2025, 3, 1)
    rows = lambda *x: spark.createDataFrame(x, "k long, day date, n long")
    read = lambda: {tuple(r) for r in files.read_store(spark, store, "day").select("k", "n").collect()}
    upsert_store(spark, store, rows((1, a, 1)), *KEEP)
    files.stage_upsert(spark, store, rows((2, a, 1)), *KEEP)  # lost before the swap: the next reader completes it
    assert read() == {(1, 1), (2, 1)}
    files.stage_upsert(spark, store, rows((3, a, 1)), *KEEP)
    files._delete(spark, store + ".pending/_SUCCESS")  # lost while it was written: thrown away
    assert read() == {(1, 1), (2, 1)}
    upsert_store(spark, store, rows((3, a, 1)), *KEEP)
    assert read() == {(1, 1), (2, 1), (3, 1)}


def test_bounded_log(spark, tmp_path):
    log = str(tmp_path / "log")
    for day in range(6):
        files.append_log(spark, log, spark.createDataFrame([(day, "first"), (day, "second")], "day int, run string").limit(1), ["day"], 4)
    files.append_log(spark, log, spark.createDataFrame([(5, "again")], "day int, run string"), ["day"], 4, ["day"])
    assert sorted(tuple(r) for r in spark.read.parquet(log).collect()) == [(2, "first"), (3, "first"), (4, "first"), (5, "again")]
