"""Queries of the general problems over the test tables: snapshot changes, column profiles, drifting schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import profile, schema_drift, snapshots
from vitrine.session import blank_free, checkpointed
from vitrine.sources.tables import table

PLACE = ["slug", "storefront"]


def handle_key(c: Column) -> Column:
    """The last non-empty path segment before any '?', trimmed, lower case."""
    path = F.regexp_replace(F.regexp_replace(c, r"(?s)\?.*$", ""), r"(?U)[/\s]+$", "")
    return F.lower(F.trim(F.regexp_extract(path, r"([^/]*)$", 1)))


def catalogue_changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "catalogue_snapshot").filter("ok AND handles IS NOT NULL")
    keyed = F.array_distinct(F.transform(F.array_compact("handles"), handle_key))
    latest = snapshots.latest_delivery(rows, {c: F.col(c) for c in (*PLACE, "snap_date")}, [F.col("captured_at"), F.col("snapshot_id")], {"items": keyed})
    return snapshots.set_changes(latest, PLACE, "snap_date", "items")


def codes_set(c: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.array_compact(c), F.lower))), F.array().cast("array<string>"))


def capture_changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "captures").filter(F.lower(blank_free(F.col("status"))) == "success")
    fields = {
        "hero_message": F.coalesce(blank_free(F.col("hero_message")), F.lit("")),
        "max_discount_pct": F.coalesce("max_discount_pct", F.lit(0)),
        "discount_codes": codes_set(F.col("discount_codes")),
    }
    latest = snapshots.latest_delivery(rows, {c: F.col(c) for c in (*PLACE, "capture_date")}, [F.col("captured_at"), F.col("capture_id")], fields)
    return snapshots.field_changes(latest, PLACE, "capture_date", {f: F.col(f) for f in fields})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    sets = catalogue_changes(spark, folder).select(F.lit("catalogue_snapshot").alias("src"), *PLACE, F.date_format("snap_date", "yyyy-MM-dd").alias("on_date"), "change_kind", "item")
    fields = capture_changes(spark, folder).select(F.lit("captures").alias("src"), *PLACE, F.date_format("capture_date", "yyyy-MM-dd").alias("on_date"), F.lit("changed").alias("change_kind"), "item")
    return sets.unionByName(fields)


def p2_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Changes counted by storefront and date."""
    return p2_found(spark, folder).groupBy("src", *PLACE, "on_date").agg(
        F.count_if(F.col("change_kind") == "added").alias("n_added"), F.count_if(F.col("change_kind") == "removed").alias("n_removed"), F.count_if(F.col("change_kind") == "changed").alias("n_changed")
    )


P2_SQL = r"""
WITH snap AS (
  SELECT slug, storefront, snap_date, arg_max(handles, (captured_at, snapshot_id)) AS handles
  FROM catalogue_snapshot WHERE ok AND handles IS NOT NULL GROUP BY 1, 2, 3),
dated AS (SELECT *, lead(snap_date) OVER w AS nxt, lag(snap_date) OVER w AS prv FROM snap WINDOW w AS (PARTITION BY slug, storefront ORDER BY snap_date)),
item AS (
  SELECT DISTINCT slug, storefront, snap_date, nxt, prv, lower(trim(regexp_extract(regexp_replace(regexp_replace(h, '\?.*$', ''), '[/\s]+$', ''), '([^/]*)$', 1))) AS item
  FROM (SELECT *, unnest(handles) AS h FROM dated)),
side AS (
  SELECT slug, storefront, snap_date AS d, item, 1 AS cur, 0 AS prev FROM item WHERE prv IS NOT NULL AND item <> ''
  UNION ALL SELECT slug, storefront, nxt, item, 0, 1 FROM item WHERE nxt IS NOT NULL AND item <> ''),
net AS (SELECT slug, storefront, d, item, max(cur) AS cur, max(prev) AS prev FROM side GROUP BY ALL),
cap AS (
  SELECT slug, storefront, capture_date, arg_max({'h': coalesce(trim(regexp_replace(hero_message, '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g')), ''),
    'p': coalesce(max_discount_pct, 0), 'c': coalesce(list_sort(list_distinct(list_transform(discount_codes, lambda x: lower(x)))), [])}, (captured_at, capture_id)) AS f
  FROM captures WHERE lower(trim(regexp_replace(status, '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g'))) = 'success' GROUP BY 1, 2, 3),
pair AS (SELECT slug, storefront, capture_date, f, lag(f) OVER (PARTITION BY slug, storefront ORDER BY capture_date) AS g, row_number() OVER (PARTITION BY slug, storefront ORDER BY capture_date) AS n FROM cap)
SELECT 'catalogue_snapshot' AS src, slug, storefront, strftime(d, '%Y-%m-%d') AS on_date, CASE WHEN cur = 1 THEN 'added' ELSE 'removed' END AS change_kind, item FROM net WHERE cur <> prev
UNION ALL SELECT 'captures', slug, storefront, strftime(capture_date, '%Y-%m-%d'), 'changed', 'hero_message' FROM pair WHERE n > 1 AND f.h <> g.h
UNION ALL SELECT 'captures', slug, storefront, strftime(capture_date, '%Y-%m-%d'), 'changed', 'max_discount_pct' FROM pair WHERE n > 1 AND f.p <> g.p
UNION ALL SELECT 'captures', slug, storefront, strftime(capture_date, '%Y-%m-%d'), 'changed', 'discount_codes' FROM pair WHERE n > 1 AND f.c <> g.c
"""

#: Problem 4's declared domains and the moves between loads that count.
NULL_SHARE_MOVE, SUCCESS_SHARE_MOVE, MEAN_MOVE = 0.287, 0.287, 15.0


def declared() -> list[profile.ColumnSpec]:
    pct, offer, status = F.col("max_discount_pct"), F.col("headline_offer"), F.col("status")
    in_range = pct.between(0, 90)
    clean_offer = (
        F.length(offer).between(1, 80)
        & offer.rlike("[A-Za-z]")
        & ~offer.rlike(r"(?U)^\s|\s$")
        & ~offer.rlike(r"[<>\x00-\x1f\x7f]")
    )
    return [
        profile.ColumnSpec("max_discount_pct", pct, in_range, numeric=True, mean_of=in_range),
        profile.ColumnSpec("headline_offer", offer, clean_offer),
        profile.ColumnSpec("status", status, status.isin("success", "failed"), nullable=False, shares={"success": status == "success"}),
    ]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    captures = table(spark, folder, "captures")
    rows = profile.row_violations(captures, "capture_id", declared()).select(F.lit("row").alias("level_name"), "item_id", "column_name")
    measured = profile.metrics(profile.states(captures, ["feed_id", "load_id"], declared()))
    limits = {"null_share": NULL_SHARE_MOVE, "tracked_share": SUCCESS_SHARE_MOVE}
    measured = measured.withColumn("mean", F.when(F.col("column_name") == "max_discount_pct", F.col("mean")))
    moved = profile.shifts(measured, ["feed_id"], "load_id", limits | {"mean": MEAN_MOVE})
    loads = moved.select(F.lit("load").alias("level_name"), F.col("load_id").alias("item_id"), "column_name").distinct()
    return rows.unionByName(loads)


#: Domains of further columns, which the profile watches beside the three declared ones; counts aren't negative, addresses are web addresses.
DOMAINS = {
    "accessibility_score": (0, 100), "reputation.rating": (0, 5), "listing.discounted_share": (0, 1), "trading.free_delivery_threshold": (0, 10_000),
    **{f"{block}{c}": (0, 1_000_000) for block, cols in (("prices.", ("price_min", "price_median", "price_max")), ("listing.prices.", ("price_min", "p25", "price_median", "p75", "price_max"))) for c in cols},
}
COUNTED = ("_count", "_length", "products_seen", "mentions")
#: Types whose values have a range and a mean of their own; for others the length of the text has.
MEASURED = ("integer", "long", "double", "float", "short", "byte", "decimal", "boolean", "date", "timestamp", "timestamp_ntz")


def every_column(df: DataFrame) -> list[profile.ColumnSpec]:
    """The declared columns, and all others (members of structs too, lists by their text) without a constraint."""
    specs = declared()
    known = {s.name for s in specs}

    def domain(name: str, c: Column, kind: str) -> Column | None:
        if name in DOMAINS:
            return c.between(*DOMAINS[name])
        counts = kind in ("integer", "long") and name.endswith(COUNTED)
        return c >= 0 if counts else c.rlike(r"^https?://\S+$") if kind == "string" and name.endswith("url") else None

    def leaves(schema, path):
        for f in schema.fields:
            at = [*path, f.name]
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, at)
            elif (name := ".".join(at)) not in known:
                kind = f.dataType.typeName()
                c = F.col(".".join(f"`{x}`" for x in at))
                if kind in ("date", "timestamp_ntz"):
                    c = c.cast("timestamp")
                yield profile.ColumnSpec(name, F.to_json(c) if kind in ("array", "map") else c, domain(name, c, kind), numeric=kind in MEASURED)

    return specs + list(leaves(df.schema, []))


def p4_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of captures, per load, from one scan."""
    captures = table(spark, folder, "captures")
    return profile.metrics(profile.states(captures, ["feed_id", "load_id"], every_column(captures), sketches=True))


def p4_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of captures, per feed: the loads' states merged, no row read again."""
    captures = table(spark, folder, "captures")
    return profile.metrics(profile.merge_states(profile.states(captures, ["feed_id", "load_id"], every_column(captures), sketches=True), ["feed_id"]))


def p4_control(spark: SparkSession, folder: str) -> DataFrame:
    """Loads whose null share, violation share, tracked share, mean, range or distinct count leaves the control limits of the feed's earlier loads, in any column."""
    captures = table(spark, folder, "captures")
    m = profile.metrics(profile.states(captures, ["feed_id", "load_id"], every_column(captures), sketches=True))
    ends = F.greatest(F.abs("low"), F.abs("high"))
    levels = {"mean": F.abs("mean"), "low": ends, "high": ends, "distinct_estimate": F.col("distinct_estimate")}
    levels |= {"length_mean": F.col("length_mean"), "length_low": F.col("length_high"), "length_high": F.col("length_high")}
    return profile.control_limits(m.withColumn("violation_share", F.col("violations") / F.col("rows")), ["feed_id"], "load_id", ["null_share", "violation_share", "tracked_share", *levels], levels=levels)


P4_SQL = r"""
WITH l AS (
  SELECT feed_id, load_id, count(*) AS n, avg(CASE WHEN max_discount_pct IS NULL THEN 1.0 ELSE 0.0 END) AS pn, avg(CASE WHEN headline_offer IS NULL THEN 1.0 ELSE 0.0 END) AS hn,
    avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END) AS sn, avg(CASE WHEN status = 'success' THEN 1.0 ELSE 0.0 END) AS ss, avg(CASE WHEN max_discount_pct BETWEEN 0 AND 90 THEN max_discount_pct END) AS m
  FROM captures GROUP BY 1, 2),
d AS (SELECT load_id, abs(pn - lag(pn) OVER w) AS pn, abs(hn - lag(hn) OVER w) AS hn, abs(sn - lag(sn) OVER w) AS sn, abs(ss - lag(ss) OVER w) AS ss, abs(m - lag(m) OVER w) AS m
  FROM l WINDOW w AS (PARTITION BY feed_id ORDER BY load_id))
SELECT 'row' AS level_name, capture_id AS item_id, 'max_discount_pct' AS column_name FROM captures WHERE max_discount_pct NOT BETWEEN 0 AND 90
UNION ALL SELECT 'row', capture_id, 'status' FROM captures WHERE status IS NULL OR status NOT IN ('success', 'failed')
UNION ALL SELECT 'row', capture_id, 'headline_offer' FROM captures WHERE headline_offer IS NOT NULL AND NOT (length(headline_offer) BETWEEN 1 AND 80
  AND regexp_matches(headline_offer, '[A-Za-z]') AND NOT regexp_matches(headline_offer, '^[\s\x{00A0}\x{2007}\x{202F}]|[\s\x{00A0}\x{2007}\x{202F}]$') AND NOT regexp_matches(headline_offer, '[<>\x00-\x1f\x7f]'))
UNION ALL SELECT 'load', load_id, 'max_discount_pct' FROM d WHERE pn > 0.287 OR m > 15
UNION ALL SELECT 'load', load_id, 'headline_offer' FROM d WHERE hn > 0.287
UNION ALL SELECT 'load', load_id, 'status' FROM d WHERE sn > 0.287 OR ss > 0.287
"""

FILE_BLOCKS = ["listing", "reputation", "trading"]


def file_values(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Path-value rows of capture_files (kept in the checkpoint folder, as they are read several times) and the files delivered."""
    raw = table(spark, folder, "capture_files")
    values = schema_drift.path_values(raw, ["raw_id", "feed_id", "file_no", *PLACE], FILE_BLOCKS)
    return checkpointed(values), raw.select("feed_id", "file_no")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    values, files = file_values(spark, folder)
    return schema_drift.drift(values, files, "feed_id", "file_no", PLACE, "raw_id")


def _typed_files(spark: SparkSession, folder: str) -> DataFrame:
    values, files = file_values(spark, folder)
    changes = schema_drift.drift(values, files, "feed_id", "file_no", PLACE, "raw_id")
    names = checkpointed(schema_drift.canonical_names(changes, schema_drift.fields_by_file(values, "feed_id", "file_no"), "feed_id"))
    return checkpointed(schema_drift.typed_values(values, names, "feed_id", ["raw_id", "feed_id", "file_no", *PLACE]))


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table: one row per raw record with a typed column for each canonical field of the three blocks; lists as JSON text."""
    wide = schema_drift.wide_table(_typed_files(spark, folder), ["raw_id", "feed_id", "file_no", *PLACE])
    lists = [f.name for f in wide.schema.fields if f.dataType.typeName() == "array"]
    return wide.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in lists})


def p6_casts(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each raw type went into each field's type, and how many couldn't."""
    return schema_drift.cast_report(_typed_files(spark, folder))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per feed, file and block: records, absent and unreadable ones."""
    values, _ = file_values(spark, folder)
    per = values.groupBy("feed_id", "file_no", "block_name", "raw_id").agg(F.max(F.col("kind") == "!absent").alias("a"), F.max(F.col("kind") == "!unreadable").alias("u"))
    return per.groupBy("feed_id", "file_no", "block_name").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("a").alias("n_absent"), F.count_if("u").alias("n_unreadable"))


P6_REPORT_SQL = " UNION ALL ".join(
    f"SELECT feed_id, file_no, '{b}' AS block_name, count(*) AS n_records, count(*) FILTER ({b} IS NULL) AS n_absent, count(*) FILTER ({b} IS NOT NULL AND NOT json_valid({b})) AS n_unreadable FROM capture_files GROUP BY 1, 2"
    for b in FILE_BLOCKS
)

QUERIES = {"p2_found": p2_found, "p2_summary": p2_summary, "p4_found": p4_found, "p4_profile": p4_profile, "p4_feeds": p4_feeds, "p4_control": p4_control, "p6_found": p6_found, "p6_table": p6_table, "p6_casts": p6_casts, "p6_report": p6_report}
SQL = {
    "p2_found": P2_SQL,
    "p2_summary": "SELECT src, slug, storefront, on_date, count(*) FILTER (change_kind = 'added') AS n_added, count(*) FILTER (change_kind = 'removed') AS n_removed, count(*) FILTER (change_kind = 'changed') AS n_changed FROM (" + P2_SQL + ") GROUP BY ALL",
    "p4_found": P4_SQL,
    "p6_report": P6_REPORT_SQL,
}
