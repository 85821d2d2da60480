"""Tables of the dashboard: indexes, market snapshot, cards, search metadata, levers, policies, recent changes. Each is a projection of one record a brand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Lengths that are healthy, values shown of a list, categories on a card, events in the view of recent changes.
TITLE_LENGTH, DESCRIPTION_LENGTH, SHOWN, POLICY_SHOWN, CARD_CATEGORIES, RECENT_EVENTS = (50, 62), (120, 160), 2, 3, 6, 80


def brand_index(records: DataFrame, date: str, tie: Sequence[str]) -> DataFrame:
    """(slug, brand, own, n_records, n_dates, last_date, place): brands with the own one first, then by name; a brand's name and flag are those of its first record."""
    first = F.struct(date, *tie)
    own = F.coalesce("is_self", F.lit(False))
    per = records.groupBy("slug").agg(F.min_by("brand", first).alias("brand"), F.min_by(own, first).alias("own"), F.count(F.lit(1)).alias("n_records"), F.countDistinct(date).alias("n_dates"), F.max(date).alias("last_date"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("own"), "brand", "slug")))  # a row a brand


def date_index(records: DataFrame, date: str) -> DataFrame:
    """(date, n_records, n_brands) of every date, in order."""
    return records.groupBy(date).agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("slug").alias("n_brands")).orderBy(date)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def shown(items: Column, n: int = SHOWN) -> Column:
    return F.array_join(F.slice(items, 1, n), " | ")


def market_snapshot(latest: DataFrame) -> DataFrame:
    """(slug, brand, hero, offer, delivery, codes, status): a row per brand with its first delivery promise and all codes."""
    return latest.select(
        "slug", "brand", F.col("hero_message").alias("hero"), F.nullif(F.col("headline_offer"), F.lit("")).alias("offer"), F.try_element_at(_list("delivery"), F.lit(1)).alias("delivery"), F.array_join(_list("discount_codes"), " | ").alias("codes"), "status"
    )


def competitor_card(latest: DataFrame, shares: DataFrame, date: str) -> DataFrame:
    """(slug, brand, on_date, hero, menu, offer, price_low, price_mid, price_high, mix): mix lists the leading categories with the width of their bar relative to the widest."""
    n = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("share"), "category"))
    top = shares.withColumn("n", n).filter(F.col("n") <= CARD_CATEGORIES).withColumn("widest", F.max("share").over(Window.partitionBy("slug")))
    bars = F.struct("n", F.format_string("%s %d", "category", F.floor(100 * F.col("share") / F.greatest("widest", F.lit(0.0001)) + 0.5).cast("int")).alias("text"))
    mix = top.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(bars)), lambda x: x["text"]), " | ").alias("mix"))  # CARD_CATEGORIES rows a brand
    card = latest.select("slug", "brand", F.col(date).alias("on_date"), F.col("hero_message").alias("hero"), F.array_join(_list("menu"), " | ").alias("menu"), F.nullif(F.col("headline_offer"), F.lit("")).alias("offer"), F.col("prices.price_min").alias("price_low"), F.col("prices.price_median").alias("price_mid"), F.col("prices.price_max").alias("price_high"))
    return card.join(mix, "slug", "left")


def rated_length(length: Column, healthy: tuple[int, int]) -> Column:
    return F.when(length.between(*healthy), "good").when(length > 0, "warn").otherwise("bad")


def seo_table(latest: DataFrame) -> DataFrame:
    """(slug, title, title_rating, description, description_rating, h1_count, word_count, accessibility_score)."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return latest.select(
        "slug", F.col("seo.title").alias("title"), rated_length(size("seo.title"), TITLE_LENGTH).alias("title_rating"), F.col("seo.meta_description").alias("description"), rated_length(size("seo.meta_description"), DESCRIPTION_LENGTH).alias("description_rating"),
        F.col("seo.h1_count").alias("h1_count"), F.col("seo.word_count").alias("word_count"), "accessibility_score",
    )


def latest_shot(records: DataFrame, key: Sequence[str], order: Sequence[str], has_shot: Column) -> DataFrame:
    """The newest record of any status that has a picture."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return records.filter(has_shot).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def threshold_text(c: Column) -> Column:
    return F.when(c == 0, "free").when(c.isNotNull(), F.concat(F.lit("over £"), c.cast("string")))


def levers_table(latest: DataFrame) -> DataFrame:
    """(slug, has_bnpl, finance, sign_up, free_delivery, scarcity)."""
    return latest.select(
        "slug", F.coalesce("trading.has_bnpl", F.lit(False)).alias("has_bnpl"), F.array_join(_list("trading.finance"), " | ").alias("finance"), F.nullif(F.col("trading.email_capture_offer"), F.lit("")).alias("sign_up"),
        threshold_text(F.col("trading.free_delivery_threshold")).alias("free_delivery"), shown(_list("trading.scarcity")).alias("scarcity"),
    )


def policy_table(pages: DataFrame, delivery: Column, returns: Column) -> DataFrame:
    """(slug, options, free_delivery, express, window_days, return_cost, exchanges) of the brands' policy pages, read by the given structs."""
    read = pages.select("slug", delivery.alias("d"), returns.alias("r"))
    options = F.transform("d.options", lambda o: F.concat_ws(" ", o["name"], o["price"]))
    express = F.when(F.col("d.express"), F.concat(F.lit("yes"), F.coalesce(F.concat(F.lit(" by "), F.col("d.express_cutoff")), F.lit(""))))
    cost = F.when(F.col("r.free_returns"), "free").when(~F.col("r.free_returns"), "paid")
    return read.select("slug", shown(options, POLICY_SHOWN).alias("options"), threshold_text(F.col("d.free_threshold")).alias("free_delivery"), express.alias("express"), F.col("r.window_days").alias("window_days"), cost.alias("return_cost"), F.col("r.exchanges").alias("exchanges"))


def recent_changes(timeline: DataFrame, date: str, key: Sequence[str], n: int = RECENT_EVENTS) -> DataFrame:
    """The newest events with their number within their date, as the view lists them under a date's heading."""
    top = timeline.orderBy(F.desc(date), *[F.desc(k) for k in key], "seq").limit(n)
    return top.withColumn("nth", F.row_number().over(Window.partitionBy(date).orderBy(*[F.desc(k) for k in key], "seq")))


