import datetime as dt
import random

from pyspark.sql import functions as F

from vitrine.operators import snapshots
from vitrine.plans.general import handle_key
from vitrine.sources.files import read_generation

D = [dt.date(2025, 1, d) for d in range(1, 29)]


def changes(spark, rows, schema="g string, d date, items array<string>", **k):
    df = spark.createDataFrame(rows, schema)
    return {tuple(r) for r in snapshots.set_changes(df, ["g"], "d", "items", **k).collect()}


def brute(rows):
    out, last = set(), {}
    for g, d, items in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        now = {i for i in items or [] if i is not None and i.strip()}
        if g in last:
            out |= {(g, d, "added", i) for i in now - last[g]} | {(g, d, "removed", i) for i in last[g] - now}
        last[g] = now
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(g, d, [f"h{rng.randrange(400)}" for _ in range(rng.randrange(0, 200))]) for g in ("a", "b", None) for d in rng.sample(D, 6)]
    assert changes(spark, rows) == brute(rows)


def test_first_empty_null_and_blank_items(spark):
    rows = [("a", D[0], ["x", "x", None, " "]), ("a", D[1], []), ("a", D[2], ["y"]), ("b", D[0], ["z"])]
    assert changes(spark, rows) == {("a", D[1], "removed", "x"), ("a", D[2], "added", "y")}
    assert changes(spark, []) == set()


def test_ordinals_persist(spark):
    first = spark.createDataFrame([("g", "a"), ("g", "b")], "g string, item string")
    known = snapshots.assign_ordinals(first, ["g"], "item")
    both = snapshots.assign_ordinals(spark.createDataFrame([("g", x) for x in "abcdefgh"], "g string, item string"), ["g"], "item", known)
    old = {(r["item"], r["_shard"]): r["_ord"] for r in known.collect()}
    new = {(r["item"], r["_shard"]): r["_ord"] for r in both.collect()}
    assert all(new[k] == v for k, v in old.items()) and len({(s, o) for (_, s), o in new.items()}) == 8
    rows = [(g, D[i], x) for g in ("g", None) for i, x in enumerate((["a", "b"], ["b", "c"]))]
    assert changes(spark, rows, existing=known) == {(g, D[1], k, x) for g in ("g", None) for k, x in (("removed", "a"), ("added", "c"))}


def test_dictionary_is_kept_between_runs(spark, tmp_path):
    """Two runs over growing snapshots: ordinals of the first stay, null groups and long calendars included, and both give the brute-force rows."""
    rng = random.Random(9)
    days = [D[0] + dt.timedelta(i) for i in range(90)]
    rows = [(g, d, [f"h{rng.randrange(50)}" for _ in range(20)]) for g in ("a", None) for d in days]
    kept = lambda some: {tuple(r) for r in snapshots.set_changes_kept(spark.createDataFrame(some, "g string, d date, items array<string>"), ["g"], "d", "items", str(tmp_path / "dict")).collect()}
    read = lambda: {(r["g"], r["_shard"], r["item"]): r["_ord"] for r in read_generation(spark, str(tmp_path / "dict")).collect()}
    early = [(g, d, [i for i in items if i < "h3"]) for g, d, items in rows if d < days[40]]
    assert kept(early) == brute(early)
    first = read()
    assert kept(rows) == brute(rows)
    second = read()
    assert {k: second[k] for k in first} == first and len(second) > len(first) and len({(g, s, o) for (g, s, _), o in second.items()}) == len(second)


def test_latest_delivery_and_fields(spark):
    rows = [("k", D[0], 1, "a", 5), ("k", D[0], 2, "b", None), ("k", D[1], 1, "b", 0), ("k", D[2], 1, "c", 7)]
    df = spark.createDataFrame(rows, "k string, d date, o int, v string, n int").withColumn("item", F.lit("a clashing name"))
    best = snapshots.latest_delivery(df, {"k": F.col("k"), "d": F.col("d")}, [F.col("o")], {"v": F.col("v"), "n": F.coalesce("n", F.lit(0))})
    got = {tuple(r) for r in snapshots.field_changes(best, ["k"], "d", {"v": F.col("v"), "n": F.col("n")}).collect()}
    assert got == {("k", D[2], "v"), ("k", D[2], "n")}


def test_handle_key(spark):
    cases = {"/products/Plum-Tote/": "plum-tote", "x?ref=/map": "x", " a-b ": "a-b", "": "", "FOOU": "foou", "a/b/ ": "b"}
    df = spark.createDataFrame([(k,) for k in cases], "h string").select("h", handle_key(F.col("h")).alias("k"))
    assert {r["h"]: r["k"] for r in df.collect()} == cases
