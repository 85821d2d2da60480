"""Answer visibility: brand mentions in order of appearance, share of voice, leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import checkpointed, lookup_join


def matchers(brands: DataFrame) -> DataFrame:
    """(slug, brand_ord, name, lead, pattern): the exact spellings of a brand; '&' also as 'and' and '+', blanks of any length, never inside a word."""
    # the roster's order, over one row a brand
    roster = brands.select("slug", "brand", "aliases", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("slug")).alias("brand_ord"))
    names = roster.select("slug", "brand_ord", F.explode(F.concat(F.array("brand"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("trim(name) <> ''")
    variants = F.array_distinct(F.array(F.col("name"), F.regexp_replace("name", r"\s*&\s*", " and "), F.regexp_replace("name", r"\s*&\s*", " + ")))
    spelt = names.select("slug", "brand_ord", F.explode(F.transform(variants, lambda v: F.lower(F.trim(v)))).alias("name")).distinct()
    quoted = F.regexp_replace(F.regexp_replace("name", r"([\\.^$|?*+()\[\]{}])", r"\\$1"), r"\s+", r"\\s+")
    return spelt.select("slug", "brand_ord", "name", F.regexp_extract("name", r"(?U)^(\w+)", 1).alias("lead"), F.concat(F.lit(r"(?U)(?<!\w)"), quoted, F.lit(r"(?!\w)")).alias("pattern"))


def mentions(answers: DataFrame, brands: DataFrame, item: str, text: str) -> DataFrame:
    """(item, slug, pos, rank): each brand's first position in a text, ranked; the roster's order settles ties.

    A text meets only the brands whose leading word it holds. Words go through the join with the item
    alone; the few candidates of an item then meet its text once.
    """
    names = matchers(brands)
    low = answers.select(F.col(item).alias("item"), F.lower(F.col(text)).alias("t")).filter("t IS NOT NULL")
    words = low.select("item", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"(?U)\w+"), 0))).alias("lead"))
    # the names of a leading word as one list, so that the lookup's keys are unique
    led = checkpointed(names.groupBy("lead").agg(F.collect_list(F.struct("slug", "brand_ord", "pattern")).alias("names")))
    met = lookup_join(words, led, ["lead"]).groupBy("item").agg(F.flatten(F.collect_list("names")).alias("names"))  # candidates of one text
    at = low.join(met, "item").select("item", "t", F.explode("names").alias("n")).select("item", "n.slug", "n.brand_ord", F.regexp_instr("t", F.col("n.pattern")).alias("pos"))
    first = at.filter("pos > 0").groupBy("item", "slug", "brand_ord").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("pos", "brand_ord"))).select("item", "slug", "pos", "rank")


def share_of_voice(found: DataFrame, brands: DataFrame, total: DataFrame) -> DataFrame:
    """Every brand: mentions, questions asked, visibility over all of them (failed ones too), mean rank, points (sum of 1/rank) and their share. total: one row, column n."""
    per = found.groupBy("slug").agg(F.count(F.lit(1)).alias("mentions"), F.avg("rank").alias("avg_rank"), F.sum(1 / F.col("rank")).alias("points"))
    all_brands = brands.select("slug").join(per, "slug", "left").fillna(0, ["mentions", "points"])
    points = F.sum("points").over(Window.partitionBy(F.lit(1)))  # over the roster, one row a brand
    scored = all_brands.crossJoin(F.broadcast(total))  # one row
    return scored.select(
        "slug", "mentions", F.col("n").alias("queries"), F.round(F.expr("try_divide(mentions, n)"), 3).alias("visibility"), F.round("avg_rank", 2).alias("avg_rank"), F.round("points", 4).alias("points"),
        F.round(F.coalesce(F.col("points") / F.when(points > 0, points), F.lit(0.0)), 3).alias("sov"),
    )


#: Characters kept of an answer in a run's record. A fixed value.
EXCERPT = 600


def run_records(answers: DataFrame, found: DataFrame, item: str, date: str, text: str) -> DataFrame:
    """(date, queries_total, n_answered, n_mentions, ok, excerpt_chars): a row per run; ok where any brand was named, excerpt_chars the characters kept of its answers."""
    per = answers.select(F.col(item).alias("item"), date, F.coalesce(F.substring(text, 1, EXCERPT), F.lit("")).alias("excerpt")).join(found.groupBy("item").agg(F.count(F.lit(1)).alias("k")), "item", "left")
    return per.groupBy(date).agg(F.count(F.lit(1)).alias("queries_total"), F.count_if(F.col("excerpt") != "").alias("n_answered"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_mentions"), F.coalesce(F.bool_or(F.col("k") > 0), F.lit(False)).alias("ok"), F.sum(F.length("excerpt")).alias("excerpt_chars"))


def leaders(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("sov"), "slug").limit(n)


def absent(answers: DataFrame, found: DataFrame, item: str, self_slug: DataFrame) -> DataFrame:
    """(item): answers that name some brand but not the own one."""
    named = found.select("item").distinct()
    own = found.join(self_slug.select("slug").distinct(), "slug", "left_semi").select("item").distinct()
    return answers.select(F.col(item).alias("item")).join(named, "item", "left_semi").join(own, "item", "left_anti")
