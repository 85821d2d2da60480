import datetime as dt

from pyspark.sql import functions as F

from vitrine.operators import catalogue, digest, gaps, history, views
from vitrine.plans.ask import Ask, closest_brand, date_range, match_brand, roster
from vitrine.sources import files

D = lambda n: dt.date(2025, 3, n)
REC = (
    "slug string, brand string, is_self boolean, capture_date date, captured_at int, capture_id int, status string, headline_offer string, max_discount_pct int, hero_message string, discount_codes array<string>, "
    "trading struct<finance:array<string>,email_capture_offer:string,free_delivery_threshold:int>, reputation struct<rating:double,platforms:array<string>>, "
    "listing struct<prices:struct<price_median:double>>, prices struct<price_median:double>, accessibility_score int"
)


def rec(slug, day, status="success", offer=None, pct=None, hero=None, codes=None, finance=None, signup=None, free=None, rating=None, platforms=None, median=None, access=None, own=False, n=0):
    return (slug, slug.title(), own, D(day), n, n, status, offer, pct, hero, codes, (finance, signup, free), (rating, platforms), ((median,),), (None,), access)


def df_of(spark, rows):
    return spark.createDataFrame(rows, REC)


def test_upsert_is_idempotent(spark):
    df = df_of(spark, [rec("a", 1, n=1), rec("a", 1, n=2, offer="x"), rec("b", 1, n=3)])
    once = history.upsert(df, None, ["slug", "capture_date"], ["captured_at"])
    again = history.upsert(once, df, ["slug", "capture_date"], ["captured_at"])
    assert sorted(r["capture_id"] for r in once.collect()) == sorted(r["capture_id"] for r in again.collect()) == [2, 3]


def test_timeline_rules(spark):
    rows = [
        rec("a", 1, rating=4.0, median=100.0, finance=["Klarna"], codes=["A"]), rec("a", 2, status="failed"),
        rec("a", 3, offer="up to 20% off", pct=20, hero="Hi", rating=4.2, median=115.0, finance=["Clearpay", "PayPal"], codes=["C", "B", "A"], platforms=["Yotpo"]),
        rec("a", 4, offer="30% off", pct=30, hero="Hi", rating=4.3, median=116.0, finance=["Clearpay"], codes=["A"]), rec("a", 5, pct=0),
    ]
    got = [(r["capture_date"].day, r["event"], r["detail"]) for r in history.timeline(df_of(spark, rows), ["slug"], "capture_date").orderBy("capture_date", "seq").collect()]
    assert got[:8] == [(3, "sale_started", "up to 20% off"), (3, "hero_changed", "Hi"), (3, "code_added", "B"), (3, "code_added", "C"), (3, "bnpl_added", "Clearpay"), (3, "bnpl_removed", "Klarna"), (3, "rating_changed", "up"), (3, "reviews_added", "Yotpo")]
    assert (3, "price_shift", "up") in got and (4, "discount_deepened", "20 to 30") in got and (5, "sale_ended", "") in got
    same = df_of(spark, [rec("a", d, offer="x", pct=10, hero="h", rating=4.0, median=5.0) for d in range(1, 5)])
    assert history.timeline(same, ["slug"], "capture_date").count() == 0


def test_catalogue_baseline_skips_failures(spark):
    rows = [("a", D(1), True, ["x", "y"]), ("a", D(2), False, None), ("a", D(3), True, ["y", "z", "w"])]
    got = [tuple(r)[2:7] for r in catalogue.runs(spark.createDataFrame(rows, "slug string, d date, ok boolean, handles array<string>"), ["slug"], "d").orderBy("d").collect()]
    assert got == [(True, True, 2, 0, 0), (False, False, None, 0, 0), (True, False, 3, 2, 1)]


def test_gap_rules(spark):
    pack = [rec(s, 1, offer="x", pct=40, finance=["Klarna"], free=0, signup="10% off", rating=4.6, access=90) for s in "bcd"]
    df = df_of(spark, [rec("a", 1, own=True, rating=4.0, access=70), *pack])
    sizes = spark.createDataFrame([("a", 10), ("b", 50), ("c", 60), ("d", 70)], "slug string, product_count long")
    shares = spark.createDataFrame([("b", "bags", 0.4), ("c", "bags", 0.5), ("a", "home", 1.0)], "slug string, category string, share double")
    kinds = [r["kind"] for r in gaps.by_priority(gaps.opportunities(df, sizes, shares)).collect()]
    assert kinds == ["promo_absent", "bnpl_gap", "free_delivery_gap", "signup_gap", "rating_behind", "mix_gap:bags", "accessibility_gap", "range_short"]
    assert gaps.opportunities(df_of(spark, pack)).count() == 0 and gaps.opportunities(df_of(spark, [])).count() == 0


def test_upper_median(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 1.0), (2, 2.0), (2, 3.0), (3, None)], "g int, v double")
    assert {r["g"]: r["m"] for r in df.groupBy("g").agg(gaps.upper_median(F.col("v")).alias("m")).collect()} == {1: 2.0, 2: 2.0, 3: None}


def test_digest(spark):
    df = df_of(spark, [rec("a", 1), rec("a", 9, offer="20% off", pct=20), rec("b", 9, offer="x", pct=10), rec("b", 10, status="failed")])
    assert tuple(digest.anchors(df, "capture_date").first()) == (D(10), D(1))
    assert [(r["slug"], r["event"]) for r in digest.changes(df, ["slug"], ["capture_date", "captured_at"]).collect()] == [("a", "sale_started")]
    text, page = digest.render({"n_on_offer": 1, "n_brands": 2, "mean_discount": 15.0}, [("A&B", "sale_started", "<20%>")])
    assert text.startswith("1 of 2 brands on offer") and "A&amp;B" in page and "&lt;20%&gt;" in page


def test_periods_and_formats(spark):
    df = spark.createDataFrame([(dt.date(2027, 1, 1),)], "d date").select(*[views.period(F.col("d"), g).alias(g) for g in ("week", "month", "quarter")], views.compact_count(F.lit(12345)).alias("k"), views.js_round(F.lit(-0.5)).alias("r"))
    assert tuple(df.first()) == ("2026-W53", "2027-01", "2027-Q1", "12k", 0)


def test_seo_health_counts_structured_data(spark):
    df = spark.createDataFrame([(("t" * 55, "d" * 130, 1), ["Product"]), (("t", None, 0), [])], "seo struct<title:string,meta_description:string,h1_count:int>, types array<string>")
    assert [r["v"] for r in df.select(views.seo_health(F.col("types")).alias("v")).collect()] == [100, 15] and [r["v"] for r in df.select(views.seo_health().alias("v")).collect()] == [80, 15]


def test_ask(spark):
    rows = [rec("ana", 1), rec("ana", 3, offer="up to 30% off", pct=30, hero="Sun", median=20.0), rec("bo", 3, offer="10% off", pct=10), rec("bo", 4), rec("zoe & co", 4, offer="sale", pct=50)]
    brands = spark.createDataFrame([("ana", "Ana"), ("bo", "Bo"), ("zoe & co", "Zoe & Co")], "slug string, brand string")
    a = Ask(df_of(spark, rows), brands, tie=["captured_at"])
    first = lambda q: a.ask(q).first()
    assert first("Is Ana on sale?")["value"] == "up to 30% off"
    assert first("who has the deepest discount")["brand"] == "Zoe & Co"
    assert {r["brand"] for r in a.ask("who is on sale?").collect()} == {"Ana", "Zoe & Co"}
    assert first("When did Ana start its sale?")["value"].startswith("started")
    assert first("price at ana")["value"] == "20.0" and first("Is Nobody Special on sale?")["topic"] == "unknown"
    # a market-wide question without "who", the wording of a timeline, and evidence over a span
    assert {r["brand"] for r in a.ask("Which offers are on sale?").collect()} == {"Ana", "Zoe & Co"}
    assert first("What is the biggest bag at Ana?")["topic"] == "snapshot" and first("When did the Ana banner change?")["topic"] == "hero_change"
    assert first("Is Bo on sale between 2025-03-01 and 2025-03-09?")["value"] == "1 of 2; 10% off; 2025-03-03 to 2025-03-03"
    names = roster(brands)
    assert match_brand("zoe and co please", names)[0].slug == "zoe & co" and match_brand("zoee?", names)[0].slug == "zoe & co"
    assert closest_brand("Anna", names).slug == "ana"


def test_dates():
    new = dt.date(2025, 3, 12)
    assert date_range("2025-03-01 to 2025-03-05", new) == (D(1), D(5))
    assert date_range("yesterday", new) == (D(11), D(11)) and date_range("this week", new) == (D(10), D(12)) and date_range("last week", new) == (D(3), D(9))
    assert date_range("in late february", new) == (dt.date(2025, 2, 19), dt.date(2025, 2, 28)) and date_range("in december", new)[0].year == 2024
    assert date_range("may I ask", new) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "bad.json").write_text("{oops")
    read = lambda n: [r["x"] for r in files.read_json(spark, str(tmp_path / n), "x long").collect()]
    assert sorted(read("a.json")) == [1, 2] and read("bad.json") == [] and read("none.json") == []
    h = files.seed_history(spark)
    assert h.count() == 49
    store = str(tmp_path / "store")
    small = h.select("slug", "capture_date", "status").withColumn("n", F.lit(1))
    for _ in range(2):
        files.upsert_store(spark, store, small, ["slug", "capture_date"], "capture_date", ["n"])
    assert spark.read.parquet(store).count() == 49


def test_broadcasts_are_bounded_in_bytes_and_salted_joins_agree(spark):
    from vitrine import session

    long = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k int, v string")
    assert session.fits_broadcast(long) and not session.fits_broadcast(long, max_bytes=10_000) and not session.fits_broadcast(long, max_rows=49)
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(77, 0)], "k int, n int")
    for how in ("inner", "left", "left_anti", "left_semi"):
        rows = lambda most: sorted(map(tuple, session.lookup_join(left, long, ["k"], how, max_rows=most).collect()), key=str)  # noqa: B023, E731
        assert rows(1) == rows(1000)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from vitrine import session

    class Conf:
        def get(self, name, default=None):
            return default

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=Conf)
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=Conf()))
