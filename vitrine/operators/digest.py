"""The weekly digest: anchors, now against then, market figures, rankings, and its plain text and HTML."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.history import best_median, change_rules, latest, state, successful

#: Days back to the earlier snapshot, and changes listed at most.
WINDOW_DAYS, CHANGE_CAP = 7, 25


def anchors(df: DataFrame, date: str) -> DataFrame:
    """One row (today, prior): the newest date of any record, and the newest at least a week before it, else the first."""
    today = df.agg(F.max(date).alias("today"), F.min(date).alias("first"))
    back = df.select(date).join(F.broadcast(today), F.col(date) <= F.date_sub("today", WINDOW_DAYS)).agg(F.max(date).alias("back"))
    return today.crossJoin(back).select("today", F.coalesce("back", "first").alias("prior"))  # one row by one row


def snapshot_at(df: DataFrame, key: Sequence[str], order: Sequence[str], anchor: DataFrame, which: str) -> DataFrame:
    """The newest successful record per key as of an anchor."""
    dated = successful(df).join(F.broadcast(anchor.select(F.col(which).alias("_at"))), F.col(order[0]) <= F.col("_at")).drop("_at")
    return latest(dated, key, order)


def changes(df: DataFrame, key: Sequence[str], order: Sequence[str], bnpl: Sequence[str] = ()) -> DataFrame:
    """(key, seq, event, detail): sale, discount, hero and code changes from then to now, of keys known at both anchors."""
    at = anchors(df, order[0])
    now = snapshot_at(df, key, order, at, "today").select(*key, state().alias("c"))
    then = snapshot_at(df, key, order, at, "prior").select(*key, state().alias("p"))
    pairs = now.join(then, list(key))
    rules = change_rules(F.col("p"), F.col("c"), bnpl or ("",))
    events = pairs.select(*key, F.posexplode(rules).alias("seq", "e")).select(*key, "seq", "e.event", "e.detail")
    return events.filter(F.col("event").isin("sale_started", "sale_ended", "discount_deepened", "discount_eased", "hero_changed", "code_added"))


def listed(found: DataFrame, key: Sequence[str]) -> DataFrame:
    return found.orderBy(*key, "seq").limit(CHANGE_CAP)


def market(now: DataFrame) -> DataFrame:
    """One row: keys on offer, all keys, mean and median discount of those that have one."""
    pct = F.when(F.col("max_discount_pct") != 0, F.col("max_discount_pct"))
    return now.agg(F.count_if(F.coalesce(F.col("headline_offer"), F.lit("")) != "").alias("n_on_offer"), F.count(F.lit(1)).alias("n_brands"), F.bround(F.avg(pct)).alias("mean_discount"), F.median(pct).alias("median_discount"))


def ranked(now: DataFrame, by: Column, key: Sequence[str], descending: bool) -> DataFrame:
    rows = now.select(*key, by.alias("value")).filter("value <> 0")
    return rows.orderBy(F.desc("value") if descending else F.asc("value"), *key)


def price_ranking(now: DataFrame, key: Sequence[str]) -> DataFrame:
    return ranked(now, best_median(), key, False)


def discount_ranking(now: DataFrame, key: Sequence[str]) -> DataFrame:
    return ranked(now, F.coalesce("max_discount_pct", F.lit(0)), key, True)


def render(market_row: dict, rows: Sequence[tuple[str, str, str]]) -> tuple[str, str]:
    """(text, HTML) of a digest; rows: (brand, event, detail), at most CHANGE_CAP of them."""
    head = f"{market_row['n_on_offer']} of {market_row['n_brands']} brands on offer; mean discount {market_row['mean_discount'] or 0:.0f} %"
    lines = [f"{brand}: {event.replace('_', ' ')}" + (f" ({detail})" if detail else "") for brand, event, detail in rows]
    items = "".join(f"<li>{html.escape(x)}</li>" for x in lines)
    return "\n".join([head, *lines]) + "\n", f"<h1>{html.escape(head)}</h1><ul>{items}</ul>"
