"""Assortment: sitemap and robots parsing, product handles, runs against the last good baseline, category shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sitemaps read from robots, child sitemaps walked, handles kept of one sitemap walk, new handles sampled.
ROBOTS_SITEMAPS, CHILD_SITEMAPS, MAX_HANDLES, SAMPLES = 5, 12, 8000, 8
#: Entities undone in sitemap text, in this order. Fixed values.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))


def unescape(c: Column) -> Column:
    for entity, sign in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def locs(xml: Column) -> Column:
    """Every <loc> of a sitemap, in order, trimmed and unescaped."""
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: unescape(F.trim(x)))


def is_index(xml: Column) -> Column:
    return F.coalesce(F.lower(xml).contains("<sitemapindex"), F.lit(False))


def is_sitemap(xml: Column) -> Column:
    return is_index(xml) | F.coalesce(F.lower(xml).contains("<urlset"), F.lit(False))


def sitemaps_of_robots(robots: Column) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)), 1, ROBOTS_SITEMAPS)


def urls_with_images(xml: Column) -> Column:
    blocks = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<url>(.*?)</url>"), 1)
    with_image = F.filter(blocks, lambda b: F.lower(b).contains("<image:image"))
    return F.filter(F.transform(with_image, lambda b: unescape(F.trim(F.regexp_extract(b, r"(?is)<loc>\s*(.*?)\s*</loc>", 1)))), lambda u: u != "")


def is_product_sitemap(url: Column) -> Column:
    return F.lower(url).contains("product")


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


def is_product_url(url: Column) -> Column:
    return F.lower(url_path(url)).rlike(r"/products?/")


def handle_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url_path(url), r"/+$", ""), r"([^/]*)$", 1))


def collect(sitemaps: DataFrame, robots: DataFrame) -> DataFrame:
    """(slug, ok, error, handles): the handles that a site's sitemaps list.

    sitemaps: slug, url, body; robots: slug, base_url, body. Roots are the robots' sitemaps, else
    /sitemap.xml; an index leads to its product children (all of them where none is named so).
    Handles by path and by image are both read; the larger set wins, the path's on a tie.
    """
    roots = robots.select("slug", F.explode(F.when(F.size(sitemaps_of_robots(F.col("body"))) > 0, sitemaps_of_robots(F.col("body"))).otherwise(F.array(F.concat(F.rtrim(F.col("base_url"), F.lit("/")), F.lit("/sitemap.xml"))))).alias("url"))
    found = roots.join(sitemaps, ["slug", "url"]).filter(is_sitemap(F.col("body")))
    pages = found.filter(~is_index(F.col("body"))).select("slug", "url", "body")
    children = found.filter(is_index(F.col("body"))).select("slug", F.posexplode(locs(F.col("body"))).alias("pos", "url")).withColumn("product", is_product_sitemap(F.col("url")))
    w = Window.partitionBy("slug")
    children = children.withColumn("any", F.max("product").over(w)).filter("product OR NOT any").withColumn("n", F.row_number().over(w.orderBy("pos", "url"))).filter(F.col("n") <= CHILD_SITEMAPS)
    pages = pages.unionByName(children.select("slug", "url").distinct().join(sitemaps, ["slug", "url"]).filter(is_sitemap(F.col("body")) & ~is_index(F.col("body"))).select("slug", "url", "body")).distinct()
    by_path = pages.select("slug", F.explode(F.filter(locs(F.col("body")), is_product_url)).alias("u")).groupBy("slug").agg(F.collect_set(handle_of(F.col("u"))).alias("by_path"))
    by_image = pages.select("slug", F.explode(urls_with_images(F.col("body"))).alias("u")).groupBy("slug").agg(F.collect_set(handle_of(F.col("u"))).alias("by_image"))
    none = F.array().cast("array<string>")
    both = robots.select("slug").join(found.select("slug").distinct().withColumn("seen", F.lit(True)), "slug", "left").join(by_path, "slug", "left").join(by_image, "slug", "left")
    a, b = F.coalesce("by_path", none), F.coalesce("by_image", none)
    handles = F.slice(F.array_sort(F.filter(F.when(F.size(a) >= F.size(b), a).otherwise(b), lambda h: h != "")), 1, MAX_HANDLES)
    error = F.when(F.col("seen").isNull(), "no sitemap found").when(F.size(handles) == 0, "no product urls")
    return both.select("slug", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), handles).alias("handles"))


def runs(snapshots: DataFrame, key: list[str], date: str) -> DataFrame:
    """(key, date, ok, first_seen, product_count, new_count, removed_count, new_samples) of every run.

    snapshots: one row per key and date with ok and handles. The baseline is the last good
    handle list strictly before; a failed run has nulls and zeros and leaves the baseline as it is.
    """
    w = Window.partitionBy(*key).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    good = F.col("ok") & F.col("handles").isNotNull()
    df = snapshots.withColumn("_cur", F.when(good, F.array_distinct("handles"))).withColumn("_base", F.last("_cur", ignorenulls=True).over(w))
    new = F.array_sort(F.array_except("_cur", "_base"))
    gone = F.array_except("_base", "_cur")
    first = F.col("_base").isNull()
    compared = good & ~first
    return df.select(
        *key, date, good.alias("ok"), (good & first).alias("first_seen"),
        F.when(good, F.size("_cur")).cast("long").alias("product_count"),
        F.when(compared, F.size(new)).otherwise(0).cast("long").alias("new_count"),
        F.when(compared, F.size(gone)).otherwise(0).cast("long").alias("removed_count"),
        F.when(compared, F.slice(new, 1, SAMPLES)).alias("new_samples"),
    )


def run_summary(run: DataFrame, date: str) -> DataFrame:
    return run.groupBy(date).agg(F.count_if("ok").alias("n_ok"), F.sum("new_count").alias("n_new"))


def classified(handles: DataFrame, handle: str, taxonomy: dict[str, list[str]]) -> DataFrame:
    """A row per handle and category whose keyword starts one of the handle's words."""
    spaced = F.regexp_replace(F.lower(F.col(handle)), "[-_]+", " ")
    # keywords are literals, so each pattern is compiled once
    hit = F.array_compact(F.array(*[F.when(spaced.rlike(r"(?U)\b(?:" + "|".join(_escape(k.lower()) for k in words) + ")"), F.lit(cat)) for cat, words in taxonomy.items()]))
    return handles.withColumn("category", F.explode(hit))


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def newness(run: DataFrame, key: list[str], date: str, last: int = 7) -> DataFrame:
    """New products over the last runs of a key, and its newest known size."""
    n = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.desc(date)))
    recent = run.withColumn("_n", n)
    counted = F.when((F.col("_n") <= last) & F.col("ok") & ~F.col("first_seen"), F.col("new_count")).otherwise(0)
    return recent.groupBy(*key).agg(F.sum(counted).alias("n_new"), F.max_by("product_count", F.when(F.col("ok"), F.col(date))).alias("size"))


def category_shares(rows: DataFrame, key: list[str], category: str) -> DataFrame:
    """(key, category, n, share) with the share of the key's own total."""
    n = rows.groupBy(*key, category).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))
