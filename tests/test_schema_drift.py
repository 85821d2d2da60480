import json

from vitrine.operators import schema_drift as sd

RAW = "raw_id long, feed_id long, file_no int, slug string, storefront string, listing string, extra string"


def found(spark, rows):
    df = spark.createDataFrame(rows, RAW)
    v = sd.path_values(df, ["raw_id", "feed_id", "file_no", "slug", "storefront"], ["listing"])
    out = sd.drift(v, df, "feed_id", "file_no", ["slug", "storefront"], "raw_id")
    return {tuple(r) for r in out.collect()}, v


def rows_of(files):
    n, out = 0, []
    for no, make in enumerate(files, 1):
        for sf in range(4):
            n += 1
            x = make(sf)
            out.append((n, 1, no, "s", f"f{sf}", x if x is None or isinstance(x, str) else json.dumps(x), "path"))
    return out


def test_changes(spark):
    got, v = found(spark, rows_of([
        lambda i: {"url": f"u{i}", "seen": 40 + i, "p": {"max": 10.5 + i}, "gone": "x"},
        lambda i: {"url": f"u{i}", "items_seen": 41 + i, "p": {"max": str(10.5 + i)}, "fresh": [i]},
        lambda i: "{broken" if i == 0 else None if i == 1 else {"url": f"u{i}", "items_seen": 41 + i, "p": {"max": None}, "fresh": [i]},
    ]))
    assert got == {
        (1, "listing", 2, "renamed", "seen", "items_seen"), (1, "listing", 2, "type_changed", "p.max", "p.max"), (1, "listing", 2, "removed", "gone", ""), (1, "listing", 2, "added", "", "fresh"),
        (1, "listing", 3, "removed", "p.max", ""),
    }
    kinds = {r["kind"] for r in v.collect()}
    assert {"!unreadable", "!absent", "number", "text", "list"} <= kinds


IDS = ["raw_id", "feed_id", "file_no", "slug", "storefront"]


def typed(spark, rows):
    df = spark.createDataFrame(rows, RAW)
    v = sd.path_values(df, IDS, ["listing"])
    changes = sd.drift(v, df, "feed_id", "file_no", ["slug", "storefront"], "raw_id")
    names = sd.canonical_names(changes, sd.fields_by_file(v, "feed_id", "file_no"), "feed_id")
    return sd.typed_values(v, names, "feed_id", IDS)


def test_wide_table_and_failed_casts(spark):
    t = typed(spark, rows_of([lambda i: {"n": 7 + i, "on": True, "l": ["a", "b"]}, lambda i: {"n": "many" if i == 0 else "1,234" if i == 1 else 7 + i, "on": "perhaps" if i == 0 else "yes" if i == 1 else True, "l": "a, b" if i < 2 else ["c"]}]))
    w = sd.wide_table(t, ["raw_id"])
    assert {f.name: f.dataType.simpleString() for f in w.schema.fields} == {"raw_id": "bigint", "listing.l": "array<string>", "listing.n": "double", "listing.on": "boolean", "failed_casts": "array<string>"}
    got = {r["raw_id"]: r.asDict() for r in w.collect()}
    assert got[1] == {"raw_id": 1, "listing.n": 7.0, "listing.on": True, "listing.l": ["a", "b"], "failed_casts": []}
    assert got[5] == {"raw_id": 5, "listing.n": None, "listing.on": None, "listing.l": ["a", "b"], "failed_casts": ["listing.n", "listing.on"]} and got[6]["listing.n"] == 1234.0
    assert {(r["field"], r["kind"]): (r["n_values"], r["n_failed"]) for r in sd.cast_report(t).collect()}["n", "text"] == (2, 1)
    assert sd.wide_table(t.limit(0), ["raw_id"]).count() == 0


def test_a_rename_in_one_feed_leaves_others_alone(spark):
    rows = rows_of([lambda i: {"x": 50 + 10 * i}, lambda i: {"y": 50 + 10 * i}])
    rows += [(100 + n, 2, no, "s", f"f{i}", json.dumps({"x": 7 * i + 1, "y": 300 + i}), "path") for n, (no, i) in enumerate((no, i) for no in (1, 2) for i in range(4))]
    got = {(r["feed_id"], r["text"]): r["field"] for r in typed(spark, rows).collect()}
    assert len({f for (feed, _), f in got.items() if feed == 1}) == 1 and {got[2, "1"], got[2, "300"]} == {"x", "y"}


def test_odd_records(spark):
    deep = "[" * 2000 + "]" * 2000
    got, _ = found(spark, rows_of([lambda i: ["[]", "3", deep, "{}"][i], lambda i: {"a": {"b": {"c": True}}} if i else ""]))
    assert got == {(1, "listing", 2, "added", "", "a.b.c")}
    assert found(spark, [])[0] == set()


def test_renames_across_notations(spark):
    counts, texts = [3260, 1359, 80214, 2982], ["3,262", "1,362", "80,219", "2,982"]
    got, _ = found(spark, rows_of([
        lambda i: {"review_count": counts[i], "has": i % 2 == 0, "rating": 3.62 + 0.41 * i, "new_in": 3 + 4 * i, "off": i % 2 == 0},
        lambda i: {"reviewCount": texts[i], "has_any": "yes" if i % 2 == 0 else "no", "avg": 3.64 + 0.41 * i, "newIn": 4 + 4 * i, "on": i % 2},
    ]))
    assert got == {(1, "listing", 2, "renamed", a, b) for a, b in [("review_count", "reviewCount"), ("has", "has_any"), ("rating", "avg"), ("new_in", "newIn")]} | {(1, "listing", 2, "removed", "off", ""), (1, "listing", 2, "added", "", "on")}


def test_small_values_that_only_lie_near(spark):
    got, _ = found(spark, rows_of([
        lambda i: {"rating": 3.7 + 0.3 * i, "pages": [0, 9, 5, 2][i], "flag": False},
        lambda i: {"best": 5, "fresh": [1, 2, 0, 5][i], "list": [1, 359]},
    ]))
    assert {r[3] for r in got} == {"removed", "added"}


def test_chain_of_overlapping_renames(spark):
    """Equal values, so names decide: the third pair is the best of both its fields only when two others are settled one after the other."""
    old, new = ["bbacbbaa", "caaccbcc", "abcaabcc"], ["caacbbaa", "caabaacb", "cacabaaa"]
    got, _ = found(spark, rows_of([lambda i: dict.fromkeys(old, 100 + i), lambda i: dict.fromkeys(new, 100 + i)]))
    assert got == {(1, "listing", 2, "renamed", a, b) for a, b in zip(old, new, strict=True)}


def test_no_value_is_broadcast_by_an_estimate(spark, monkeypatch, tmp_path):
    """Values from a compressed file look small to the planner: past the measured bound, none of their joins may be a broadcast."""
    seen = []
    monkeypatch.setattr("vitrine.session.fits_broadcast", lambda *a: False)
    keep = sd.checkpointed
    monkeypatch.setattr(sd, "checkpointed", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    spark.createDataFrame(rows_of([lambda i: {"seen": 40 + i}, lambda i: {"items_seen": 41 + i}]), RAW).coalesce(1).write.parquet(str(tmp_path / "raw"))
    df = spark.read.parquet(str(tmp_path / "raw"))
    v = sd.path_values(df, IDS, ["listing"])
    changes = keep(sd.presence_changes(sd.fields_by_file(v, "feed_id", "file_no"), df, "feed_id", "file_no"))
    seen.clear()
    got = sd.renames(v, changes, "feed_id", "file_no", ["slug", "storefront"], "raw_id")
    assert [(r["old_field"], r["new_field"]) for r in got.collect()] == [("seen", "items_seen")]
    assert any("SortMergeJoin" in plan for plan in seen) and not any("Broadcast" in plan for plan in seen)
