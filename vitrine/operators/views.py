"""Dashboard aggregates as DataFrames: freshness, periods, rankings, market map, palettes, matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.gaps import upper_median

#: Least reviews of a verified rating, ratio at which two medians contradict each other, words and colours shown.
VERIFIED_REVIEWS, NOISY_RATIO, CLOUD_WORDS, PALETTE = 25, 4, 40, 12


def js_round(c: Column) -> Column:
    """Rounds halves up, towards plus infinity."""
    return F.floor(c + 0.5)


def period(date: Column, grain: str) -> Column:
    """'week' as ISO year and week, 'month' or 'quarter' as text."""
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    if grain == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))
    return F.date_format(date, "yyyy-MM")


def seo_health(structured: Column | None = None) -> Column:
    """0 to 100 from the lengths of title and description, headings, and whether there is structured data; records without such a field have none."""
    title, desc = F.coalesce(F.length("seo.title"), F.lit(0)), F.coalesce(F.length("seo.meta_description"), F.lit(0))
    return (
        F.when(title.between(50, 62), 30).when(title > 0, 15).otherwise(0)
        + F.when(desc.between(120, 160), 30).when(desc > 0, 15).otherwise(0)
        + F.when(F.coalesce("seo.h1_count", F.lit(0)) >= 1, 20).otherwise(0)
        + (F.lit(0) if structured is None else F.when(F.coalesce(F.size(structured), F.lit(0)) > 0, 20).otherwise(0))
    )


#: Periods shown of each grain, categories and months of the mix trend. Fixed values.
PERIODS_SHOWN, TREND_CATEGORIES, TREND_MONTHS = {"week": 8, "month": 6, "quarter": 4}, 8, 6


METRICS = {
    "access": lambda: F.col("accessibility_score").cast("double"),
    "seo": lambda: seo_health().cast("double"),
    "promo": lambda: F.when(F.coalesce(F.col("headline_offer"), F.lit("")) != "", 100.0).otherwise(0.0),
    "discount": lambda: F.coalesce(F.col("max_discount_pct"), F.lit(0)).cast("double"),
}


def period_metric(df: DataFrame, key: Sequence[str], date: str, metric: str, grain: str) -> DataFrame:
    """(key, period, value): the mean of a metric over each of the last periods."""
    per = df.select(*key, period(F.col(date), grain).alias("period"), METRICS[metric]().alias("v")).groupBy(*key, "period").agg(F.avg("v").alias("value"))
    periods = per.select("period").distinct().orderBy(F.desc("period")).limit(PERIODS_SHOWN[grain])  # a handful of calendar labels
    return per.join(F.broadcast(periods), "period", "left_semi")


def period_category(rows: DataFrame, date: str, entity: str, category: str, grain: str, top: int = 10) -> DataFrame:
    """(period, category, share): each entity's share of a category, averaged over all entities of the period; a category that an entity lacks counts 0."""
    counted = rows.groupBy(period(F.col(date), grain).alias("period"), entity, category).agg(F.count(F.lit(1)).alias("n"))
    shares = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period", entity)))
    entities = counted.groupBy("period").agg(F.countDistinct(entity).alias("n_entities"))
    leading = counted.groupBy(category).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), category).limit(top)
    kept = shares.join(F.broadcast(leading.select(category)), category, "left_semi").groupBy("period", category).agg(F.sum("share").alias("s"))
    return kept.join(entities, "period").select("period", category, (100 * F.col("s") / F.col("n_entities")).alias("share"))


def mix_trend(runs: DataFrame, date: str, category: str, counts: Sequence[str]) -> DataFrame:
    """(period, category, share, delta) of one brand: its categories' mean share of the range in each of the last months, the leading ones of the newest month, with the move in points of the rounded share.

    runs: a row per run and category with the category's count and the run's product count, the two columns of counts; a run without the category has a row with 0.
    """
    n, total = counts
    per = runs.groupBy(period(F.col(date), "month").alias("period"), category).agg(F.avg(F.col(n) / F.col(total)).alias("share"))
    months = per.select("period").distinct().orderBy(F.desc("period")).limit(TREND_MONTHS)
    kept = per.join(F.broadcast(months), "period", "left_semi")
    newest = months.agg(F.max("period").alias("period"))
    leading = kept.join(F.broadcast(newest), "period", "left_semi").orderBy(F.desc("share"), category).limit(TREND_CATEGORIES).select(category)
    rounded = js_round(100 * F.col("share"))
    return kept.join(F.broadcast(leading), category, "left_semi").withColumn("delta", rounded - F.lag(rounded).over(Window.partitionBy(category).orderBy("period"))).select("period", category, "share", "delta")


def freshness(df: DataFrame, latest_any: DataFrame, date: str, key: str) -> DataFrame:
    """(key, freshness): fresh on the newest date of all, stale before it, failed where the newest record failed."""
    newest = df.agg(F.max(date).alias("_max"))
    joined = latest_any.crossJoin(F.broadcast(newest))  # one row
    return joined.select(key, F.when(F.col("status") != "success", "failed").when(F.col(date) == F.col("_max"), "fresh").otherwise("stale").alias("freshness"))


def overview(today: DataFrame, n_brands: DataFrame) -> DataFrame:
    """One row of headline figures over today's successful records; deeper: the brands above the median discount; blocked: the brands of all (one row, column n_brands) without a record today."""
    pct = F.col("max_discount_pct")
    fast = F.exists(F.coalesce("delivery", F.array().cast("array<string>")), lambda d: F.lower(d).rlike(r"next[\s-]?day|express"))
    threshold = F.col("trading.free_delivery_threshold")
    figures = today.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slug").alias("_fresh"), F.count_if(F.coalesce(F.col("headline_offer"), F.lit("")) != "").alias("n_on_sale"), F.median(pct).alias("median_discount"), F.max(pct).alias("max_discount"),
        F.count_if(fast).alias("n_fast"), F.min(F.when(threshold > 0, threshold)).alias("low_threshold"), F.max(threshold).alias("high_threshold"), F.count_if(threshold == 0).alias("n_no_minimum"),
    )
    # a name a brand: as long as the roster
    deeper = today.crossJoin(F.broadcast(figures.select(F.col("median_discount").alias("_m")))).filter(pct > F.col("_m")).agg(F.array_join(F.array_sort(F.collect_set("slug")), " | ").alias("deeper"))
    return figures.crossJoin(deeper).crossJoin(n_brands).withColumn("n_blocked", F.col("n_brands") - F.col("_fresh")).drop("_fresh", "n_brands")  # one row each


def stance(latest: DataFrame, key: str, margin: float = 0) -> DataFrame:
    """(key, own, stance): each discount against the market's median; the own brand's row is the callout."""
    m = latest.agg(F.median("max_discount_pct").alias("m"))
    d = F.col("max_discount_pct") - F.col("m")
    return latest.crossJoin(F.broadcast(m)).select(key, F.coalesce("is_self", F.lit(False)).alias("own"), F.when(d > margin, "deeper").when(d < -margin, "shallower").when(d.isNotNull(), "in line").alias("stance"))  # one row


def promo_pressure(df: DataFrame, date: str) -> DataFrame:
    return df.groupBy(date).agg(F.count_if(F.coalesce(F.col("headline_offer"), F.lit("")) != "").alias("n_on_sale"), F.count(F.lit(1)).alias("n"))


def keyword_cloud(latest: DataFrame, top: int = CLOUD_WORDS) -> DataFrame:
    words = latest.select(F.explode("keywords").alias("k")).groupBy(F.lower(F.trim("k.word")).alias("word")).agg(F.sum("k.n").alias("n"))
    return words.orderBy(F.desc("n"), "word").limit(top)


def brand_words(latest: DataFrame, key: str, top: int = 12) -> DataFrame:
    words = latest.select(key, F.explode("keywords").alias("k")).groupBy(key, F.lower(F.trim("k.word")).alias("word")).agg(F.sum("k.n").alias("n"))
    return words.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))).filter(F.col("_n") <= top).drop("_n")


def palette(colours: DataFrame, top: int = PALETTE) -> DataFrame:
    """(name, hex, share) of the market: shares summed by colour name, the top ones, scaled to 1. colours: seq, name, hex, share."""
    sums = colours.groupBy("name").agg(F.sum("share").alias("s"), F.min_by("hex", "seq").alias("hex")).orderBy(F.desc("s"), "name").limit(top)
    return sums.select("name", "hex", (F.col("s") / F.sum("s").over(Window.partitionBy(F.lit(1)))).alias("share"))  # at most `top` rows


def gallery(df: DataFrame, date: str, bucket: str, slug: str | None = None) -> DataFrame:
    """Records of a bucket ('week', 'lastweek', 'month', 'all') relative to the newest date, newest first."""
    newest = df.agg(F.max(date).alias("_max"))
    rows = (df if slug is None else df.filter(F.col("slug") == slug)).crossJoin(F.broadcast(newest))  # one row
    age = F.datediff("_max", date)
    keep = {"week": age < 7, "lastweek": age.between(7, 13), "month": age < 30, "all": F.lit(True)}[bucket]
    return rows.filter(keep).drop("_max").orderBy(F.desc(date), "slug")


def price_signal(listing: Column, home: Column) -> Column:
    """The listing's median, else the homepage's; null where they contradict each other."""
    noisy = F.greatest(listing, home) / F.least(listing, home) > NOISY_RATIO
    return F.when(F.coalesce(noisy, F.lit(False)), F.lit(None)).otherwise(F.coalesce(listing, home))


def market_map(latest: DataFrame, sizes: DataFrame) -> DataFrame:
    """(slug, price, size, estimated, quadrant): missing values take the pack's upper median; needs three known of each. One row a brand."""
    price = price_signal(F.col("listing.prices.price_median"), F.col("prices.price_median"))
    rows = latest.select("slug", price.alias("price")).join(sizes.select("slug", F.col("product_count").alias("size")), "slug", "left")
    pack = rows.agg(upper_median(F.col("price")).alias("mp"), upper_median(F.col("size")).alias("ms"), F.count("price").alias("np"), F.count("size").alias("ns")).filter("np >= 3 AND ns >= 3")
    both = rows.crossJoin(F.broadcast(pack))  # one row
    p, s = F.coalesce("price", "mp"), F.coalesce("size", "ms")
    quadrant = F.concat_ws(" ", F.when(p >= F.col("mp"), "premium").otherwise("value"), F.when(s >= F.col("ms"), "broad").otherwise("focused"))
    return both.select("slug", p.alias("price"), s.alias("size"), (F.col("price").isNull() | F.col("size").isNull()).alias("estimated"), quadrant.alias("quadrant"))


def category_matrix(shares: DataFrame, key: str, categories: Sequence[str]) -> DataFrame:
    """A column per category with the key's share, 0 where it has none."""
    return shares.groupBy(key).pivot("category", list(categories)).agg(F.first("share")).fillna(0.0, list(categories))


def reputation_board(latest: DataFrame, least: int = VERIFIED_REVIEWS) -> DataFrame:
    """(slug, rating, review_count, verified, place, market_mean, pack_median): verified ratings first, best first, then thin ones, then those with a review platform only. The mean and the others' upper median are over verified ratings."""
    rating, n = F.col("reputation.rating"), F.coalesce("reputation.review_count", F.lit(0))
    verified = rating.isNotNull() & (n >= least)
    score = F.when(verified, 1e6).otherwise(0.0) + F.coalesce(rating, F.lit(0.0)) * 1000 + n / 1e6 + F.when(F.size(F.coalesce("reputation.platforms", F.array().cast("array<string>"))) > 0, 0.1).otherwise(0.0)
    rows = latest.select("slug", F.coalesce("is_self", F.lit(False)).alias("_own"), rating.alias("rating"), F.col("reputation.review_count").alias("review_count"), verified.alias("verified"), score.alias("_score"))
    market = rows.agg(F.avg(F.when(F.col("verified"), F.col("rating"))).alias("market_mean"), upper_median(F.when(F.col("verified") & ~F.col("_own"), F.col("rating"))).alias("pack_median"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_score"), "slug")))  # a row a brand
    return placed.crossJoin(F.broadcast(market)).select("slug", "rating", "review_count", "verified", "place", "market_mean", "pack_median").orderBy("place")  # one row


def access_board(latest: DataFrame) -> DataFrame:
    """(slug, accessibility_score, place, market_mean): brands with a score, best first."""
    rows = latest.filter("accessibility_score IS NOT NULL").select("slug", "accessibility_score")
    mean = rows.agg(F.avg("accessibility_score").alias("market_mean"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("accessibility_score"), "slug")))  # a row a brand
    return placed.crossJoin(F.broadcast(mean)).select("slug", "accessibility_score", "place", js_round(F.col("market_mean")).alias("market_mean")).orderBy("place")  # one row


def range_board(sizes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n_new, size, place, pack_median, total): newness with each key's place by size, the upper median size and the sum of all sizes."""
    pack = sizes.agg(upper_median(F.col("size")).alias("pack_median"), F.sum("size").alias("total"))
    n = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("size"), *key))  # a row a storefront
    return sizes.withColumn("place", F.when(F.col("size").isNotNull(), n)).crossJoin(F.broadcast(pack))  # one row


def compact_count(c: Column) -> Column:
    """1234 as 1.2k, 12345 as 12k."""
    return F.when(c >= 10000, F.concat(js_round(c / 1000).cast("string"), F.lit("k"))).when(c >= 1000, F.concat(F.format_number(c / 1000, 1), F.lit("k"))).otherwise(c.cast("string"))


def footer(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count_if(F.col("status") == "success").alias("n_success"), F.countDistinct("slug").alias("n_brands"), F.countDistinct(date).alias("n_days"))


def trend_reduce(series: DataFrame, key: str, order: str, value: str, last: int = 13) -> DataFrame:
    """(key, latest, mean, points): a series reduced to its last points, the newest value and the mean of all."""
    rows = series.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("s"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size("s"))
    return rows.select(key, F.element_at("s", -1).alias("latest"), F.round(mean, 1).alias("mean"), F.slice("s", F.greatest(F.size("s") - (last - 1), F.lit(1)), F.lit(last)).alias("points"))
