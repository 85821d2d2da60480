"""Capture history: keyed upsert, latest and as-of snapshots, change timeline, sale transitions.

Rules are data: each is a condition on (previous, current) with a type and a detail; a
record's rules become one array, exploded, so a rule's place in the list is its order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the timeline: relative price shift, rating step, new products that make an event, cap on the timeline.
PRICE_SHIFT, RATING_STEP, LEAST_NEW, TIMELINE_CAP = 0.15, 0.2, 2, 400
#: Providers that let a shopper pay later; a parameter wherever it is used.
BNPL = ("Klarna", "Clearpay", "Laybuy", "Afterpay")
#: Whole-record caps of the append-only logs.
RUN_LOG_CAP, ANSWER_RUN_CAP, CATALOGUE_RUN_CAP = 120, 104, 400


def upsert(old: DataFrame, new: DataFrame | None, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One record per key: the last by the order columns. Repeats within a batch count once; running it again changes nothing."""
    rows = old if new is None else old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep_last(log: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """A bounded append-only log: its last n rows."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def successful(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "success")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], until: Column | None = None) -> DataFrame:
    """The newest record per key, optionally as of a date; later order columns settle ties."""
    rows = df if until is None else df.filter(F.col(order[0]) <= until)
    return upsert(rows, None, key, order)


def latest_or_failed(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest successful record per key, else the newest of any status."""
    ranked = df.withColumn("_ok", (F.col("status") == "success").cast("int"))
    return upsert(ranked, None, key, ["_ok", *order]).drop("_ok")


def best_median() -> Column:
    """Median price of the listing page, else of the homepage."""
    return F.coalesce("listing.prices.price_median", "prices.price_median")


def _array(c: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def state() -> Column:
    """What the timeline compares, with null, empty and zero folded."""
    return F.struct(
        F.nullif(F.col("headline_offer"), F.lit("")).alias("headline"),
        F.coalesce("max_discount_pct", F.lit(0)).alias("pct"),
        F.coalesce("hero_message", F.lit("")).alias("hero"),
        _array("discount_codes").alias("codes"),
        _array("trading.finance").alias("finance"),
        F.col("reputation.rating").alias("rating"),
        _array("reputation.platforms").alias("platforms"),
        best_median().alias("median"),
    )


def _each(items: Column, kind: str) -> Column:
    return F.transform(F.array_sort(items), lambda x: F.struct(F.lit(kind).alias("event"), x.alias("detail")))


def _one(cond: Column, kind: Column | str, detail: Column) -> Column:
    event = F.lit(kind) if isinstance(kind, str) else kind
    made = F.array(F.struct(event.alias("event"), detail.cast("string").alias("detail")))
    return F.when(cond, made).otherwise(F.array().cast("array<struct<event:string,detail:string>>"))


def change_rules(p: Column, c: Column, bnpl: Sequence[str]) -> Column:
    """All events between two states, in rule order."""
    pay_later = F.array(*[F.lit(b) for b in bnpl])
    no_sale_before, no_sale_now = p["headline"].isNull(), c["headline"].isNull()
    shift = (c["median"] - p["median"]) / F.when(p["median"] != 0, p["median"])
    return F.flatten(F.array(
        _one(no_sale_before & ~no_sale_now, "sale_started", c["headline"]),
        _one(~no_sale_before & no_sale_now, "sale_ended", F.lit("")),
        _one((no_sale_before == no_sale_now) & (c["pct"] != 0) & (c["pct"] != p["pct"]), F.when(c["pct"] > p["pct"], "discount_deepened").otherwise("discount_eased"), F.concat_ws(" to ", p["pct"].cast("string"), c["pct"].cast("string"))),
        _one((c["hero"] != p["hero"]) & (c["hero"] != ""), "hero_changed", c["hero"]),
        _each(F.array_except(c["codes"], p["codes"]), "code_added"),
        _each(F.array_intersect(F.array_except(c["finance"], p["finance"]), pay_later), "bnpl_added"),
        _each(F.array_intersect(F.array_except(p["finance"], c["finance"]), pay_later), "bnpl_removed"),
        _one((c["rating"] != 0) & (p["rating"] != 0) & (F.abs(c["rating"] - p["rating"]) >= RATING_STEP), "rating_changed", F.when(c["rating"] > p["rating"], "up").otherwise("down")),
        _each(F.array_except(c["platforms"], p["platforms"]), "reviews_added"),
        _one(F.abs(shift) >= PRICE_SHIFT, "price_shift", F.when(shift > 0, "up").otherwise("down")),
    ))


def timeline(df: DataFrame, key: Sequence[str], date: str, bnpl: Sequence[str] = BNPL) -> DataFrame:
    """(key, date, seq, event, detail): changes between consecutive successful records of a key."""
    w = Window.partitionBy(*key).orderBy(date)
    pairs = successful(df).select(*key, date, state().alias("c")).withColumn("p", F.lag("c").over(w)).filter("p IS NOT NULL")
    return pairs.select(*key, date, F.posexplode(change_rules(F.col("p"), F.col("c"), bnpl)).alias("seq", "e")).select(*key, date, "seq", "e.event", "e.detail")


def capped_timeline(events: DataFrame, key: Sequence[str], date: str, n: int = TIMELINE_CAP) -> DataFrame:
    """The newest n events in their total order: date and key descending, then rule order."""
    return events.orderBy(F.desc(date), *[F.desc(k) for k in key], "seq").limit(n)


def sale_transitions(df: DataFrame, key: Sequence[str], date: str) -> DataFrame:
    """(key, date, transition, headline): started, ended, or changed wording."""
    w = Window.partitionBy(*key).orderBy(date)
    s = successful(df).select(*key, date, F.coalesce("headline_offer", F.lit("")).alias("h")).withColumn("b", F.lag("h").over(w))
    kind = F.when((F.col("b") == "") & (F.col("h") != ""), "started").when((F.col("b") != "") & (F.col("h") == ""), "ended").when(F.col("b") != F.col("h"), "changed")
    return s.withColumn("transition", kind).filter("transition IS NOT NULL").select(*key, date, "transition", F.col("h").alias("headline"))


def products_added(runs: DataFrame, least: int = LEAST_NEW) -> DataFrame:
    """Catalogue runs that added at least so many products; a first run doesn't count."""
    return runs.filter(F.col("ok") & ~F.col("first_seen") & (F.col("new_count") >= least))
