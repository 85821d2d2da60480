from pyspark.sql import functions as F

from vitrine.operators import profile
from vitrine.plans.general import declared, every_column, p4_control

ROW = "capture_id long, feed_id long, load_id long, max_discount_pct int, headline_offer string, status string"


def test_domains(spark):
    rows = [
        (1, 1, 1, None, None, "success"), (2, 1, 1, 90, "x" * 80, "failed"), (3, 1, 1, 91, "", "Success"), (4, 1, 1, -1, "x" * 81, None), (5, 1, 1, 0, " a", "ok"),
        (6, 1, 1, 5, "a\tb", "success"), (7, 1, 1, 5, "40%", "success"), (8, 1, 1, 5, "<b>a</b>", "success"), (9, 1, 1, 5, "a ", "success"), (10, 1, 1, 5, "très chic", "success"),
    ]
    got = {tuple(r) for r in profile.row_violations(spark.createDataFrame(rows, ROW), "capture_id", declared()).collect()}
    assert got == {(3, "max_discount_pct"), (3, "headline_offer"), (3, "status"), (4, "max_discount_pct"), (4, "headline_offer"), (4, "status"), (5, "headline_offer"), (5, "status"), (6, "headline_offer"), (7, "headline_offer"), (8, "headline_offer"), (9, "headline_offer")}


def test_states_merge(spark):
    rows = [(i, 1, i % 3, i % 7 if i % 5 else None, "a" * (i % 4) or None, "success") for i in range(200)]
    df = spark.createDataFrame(rows, ROW).withColumn("part", F.col("capture_id") % 4).withColumn("rows", F.lit("clash"))
    whole = profile.metrics(profile.states(df, ["load_id"], declared(), sketches=True))
    merged = profile.metrics(profile.merge_states(profile.states(df, ["load_id", "part"], declared(), sketches=True), ["load_id"]))
    assert sorted(map(str, whole.select(*sorted(whole.columns)).collect())) == sorted(map(str, merged.select(*sorted(whole.columns)).collect()))


def test_shifts_and_limits(spark):
    rows = [(1, n, "c", float(v)) for n, v in enumerate([0.1, 0.12, 0.1, 0.11, 0.6])] + [(2, 9, "c", None)]
    m = spark.createDataFrame(rows, "feed_id long, load_id long, column_name string, null_share double")
    assert [tuple(r)[:2] for r in profile.shifts(m, ["feed_id"], "load_id", {"null_share": 0.287}).collect()] == [(1, 4)]
    assert [tuple(r)[:2] for r in profile.control_limits(m, ["feed_id"], "load_id", ["null_share"]).collect()] == [(1, 4)]


def test_empty(spark):
    df = spark.createDataFrame([], ROW)
    assert profile.row_violations(df, "capture_id", declared()).count() == 0
    assert profile.states(df, ["load_id"], declared(), sketches=True).count() == 0


def test_control_sees_means_ranges_and_distinct_counts(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/captures.parquet")
    last = df.filter("feed_id = 1").agg(F.max("load_id")).first()[0]
    hit = lambda c, changed: F.when(F.col("load_id") == last, changed).otherwise(c)
    price, rating, words = F.col("prices.price_median"), F.col("reputation.rating"), F.col("seo.word_count")
    out = df.withColumns({
        "prices": F.col("prices").withField("price_median", hit(price, price * 10)),
        "reputation": F.col("reputation").withField("rating", hit(rating, rating * 10)),
        "seo": F.col("seo").withField("word_count", hit(words, F.when(words.isNotNull(), F.lit(900)))),
    })
    out.write.parquet(str(tmp_path / "captures.parquet"))
    key = lambda folder: {tuple(r)[1:4] for r in p4_control(spark, folder).collect()}
    new = key(str(tmp_path)) - key(data)
    assert {(last, "prices.price_median", "mean"), (last, "prices.price_median", "high"), (last, "reputation.rating", "mean"), (last, "seo.word_count", "distinct_estimate")} <= new
    assert {r[:2] for r in new} == {(last, c) for c in ("prices.price_median", "reputation.rating", "seo.word_count")}


def test_ranges_of_dates_flags_and_texts(spark):
    rows = [(7, 1, 3, "2025-03-01", "2025-03-01 10:00:00", True, "ab"), (9, 1, 3, "1970-01-02", "2025-03-02 00:00:30", False, "abcde"), (8, 1, 3, None, None, None, None)]
    df = spark.createDataFrame(rows, "capture_id long, feed_id long, load_id long, d string, t string, flag boolean, url string")
    df = df.withColumns({"d": F.col("d").cast("date"), "t": F.col("t").cast("timestamp"), "local": F.col("t").cast("timestamp_ntz"), "max_discount_pct": F.lit(5), "headline_offer": F.lit("x"), "status": F.lit("success")})
    for by in (["load_id"], ["load_id", "day"]):
        s = profile.states(df.withColumn("day", F.col("capture_id") % 2), by, every_column(df), sketches=True)
        got = {r["column_name"]: r for r in profile.metrics(profile.merge_states(s, ["load_id"])).collect()}
        assert {"capture_id", "feed_id", "load_id"} <= set(got)
        assert (got["d"]["low"], got["d"]["high"], got["d"]["length_low"]) == (86400.0, 1740787200.0, None)
        assert (got["t"]["low"], got["t"]["high"]) == (got["local"]["low"], got["local"]["high"]) == (1740823200.0, 1740873630.0)
        assert (got["flag"]["low"], got["flag"]["high"], got["flag"]["mean"]) == (0.0, 1.0, 0.5)
        assert (got["url"]["low"], got["url"]["length_low"], got["url"]["length_high"], got["url"]["length_mean"]) == (None, 2.0, 5.0, 3.5)
        assert (got["capture_id"]["low"], got["capture_id"]["high"], got["capture_id"]["distinct_estimate"]) == (7.0, 9.0, 3)


def test_states_are_kept_and_only_new_loads_profiled(spark, tmp_path):
    rows = [(i, 1, i % 3 if i % 4 else None, i % 7, "abc", "success") for i in range(60)]
    first, later = spark.createDataFrame(rows, ROW), spark.createDataFrame(rows + [(100, 1, 2, 5, "x", "failed"), (101, 1, 9, 5, "x", "failed"), (102, 1, None, 5, "x", "failed")], ROW)
    path, by = str(tmp_path / "states"), ["feed_id", "load_id"]
    show = lambda s: sorted(map(str, profile.metrics(s).select(*sorted(c for c in profile.metrics(s).columns)).collect()))
    assert show(profile.update_states(spark, path, first, by, declared())) == show(profile.states(first, by, declared(), sketches=True))
    # a stored state of an unchanged load is read, not made again: a marked one survives
    from vitrine.sources.files import read_generation, write_generation

    marked = read_generation(spark, path).withColumn("violations", F.when(F.col("load_id") == 1, F.lit(777)).otherwise(F.col("violations")))
    write_generation(marked, path)
    got = profile.update_states(spark, path, later, by, declared())
    assert {r["violations"] for r in got.filter("load_id = 1").collect()} == {777}
    assert show(got.filter("load_id IS NULL OR load_id <> 1")) == show(profile.states(later, by, declared(), sketches=True).filter("load_id IS NULL OR load_id <> 1"))


def test_domains_of_further_columns(spark):
    df = spark.createDataFrame([(1, 1, 3, 101, "ftp://x", 5), (2, 1, 3, 50, "https://x.example/a", -1), (3, 1, 3, None, None, None)], "capture_id long, feed_id long, load_id long, accessibility_score int, url string, price_count int")
    df = df.withColumns({"max_discount_pct": F.lit(5), "headline_offer": F.lit("x"), "status": F.lit("success")})
    got = {r["column_name"]: r["violations"] for r in profile.states(df, ["load_id"], every_column(df)).collect()}
    assert (got["accessibility_score"], got["url"], got["price_count"], got["capture_id"]) == (1, 1, 1, 0)
