"""Gap rules: the own brand's newest record against the pack of all others.

The pack is aggregated to one row, rules are a list of conditions on (own, pack), and a
rule whose inputs are missing stays silent. Middle values of the pack are upper medians.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.history import BNPL, best_median

#: Fixed values of the rules: discount points behind the mean, accessibility points behind, rating steps, assortment share, category share of the pack and lead over the own one.
DISCOUNT_BEHIND, ACCESS_BEHIND, RATING_BEHIND, RATING_BETTER, RANGE_SHARE, MIX_SHARE, MIX_LEAD = 10, 8, 0.2, 0.1, 0.5, 0.12, 0.10
PRIORITIES = ("high", "medium", "low")


def upper_median(c: Column) -> Column:
    """The upper of the two middle values of a column (one value where the count is odd); for groups of bounded size."""
    values = F.array_sort(F.collect_list(c))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def facts(latest: DataFrame, bnpl: Sequence[str] = BNPL) -> DataFrame:
    """What the rules need of each brand's newest record."""
    finance = F.coalesce("trading.finance", F.array().cast("array<string>"))
    return latest.select(
        "slug", F.coalesce("is_self", F.lit(False)).alias("own"), F.coalesce(F.col("headline_offer"), F.lit("")).alias("headline"), F.coalesce("max_discount_pct", F.lit(0)).alias("pct"),
        F.array_intersect(finance, F.array(*[F.lit(b) for b in bnpl])).alias("bnpl"), F.col("trading.free_delivery_threshold").alias("threshold"),
        F.coalesce("trading.email_capture_offer", F.lit("")).alias("signup"), F.col("accessibility_score").alias("access"), F.col("reputation.rating").alias("rating"), best_median().alias("median"),
    )


def opportunities(latest: DataFrame, sizes: DataFrame | None = None, shares: DataFrame | None = None, silent_answers: DataFrame | None = None, bnpl: Sequence[str] = BNPL) -> DataFrame:
    """(priority, seq, kind, value) for the own brand, ordered by priority and rule.

    latest: one record per brand. sizes: slug, product_count; shares: slug, category, share;
    silent_answers: item, answers that name brands but not the own one.
    """
    all_facts = facts(latest, bnpl)
    if sizes is not None:
        all_facts = all_facts.join(sizes.select("slug", F.col("product_count").alias("n_products")), "slug", "left")
    else:
        all_facts = all_facts.withColumn("n_products", F.lit(None).cast("long"))
    own = all_facts.filter("own").select(F.struct(*all_facts.columns).alias("me")).limit(1)
    on_sale = F.col("headline") != ""
    paid = F.when(F.col("rating") > 0, F.col("rating"))
    # the pack is the roster of brands: aggregated to one row
    pack = all_facts.filter("NOT own").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(on_sale).alias("n_sale"), F.avg(F.when(F.col("pct") != 0, F.col("pct"))).alias("mean_pct"),
        F.count_if(F.size("bnpl") > 0).alias("n_bnpl"), F.count_if(F.col("threshold") == 0).alias("n_free"), F.count_if(F.col("signup") != "").alias("n_signup"),
        F.bround(F.avg("access")).alias("mean_access"), F.count(paid).alias("n_rated"), upper_median(paid).alias("mid_rating"), F.collect_list(paid).alias("ratings"),
        upper_median(F.col("n_products")).alias("mid_products"),
    ).filter("n > 0")
    least = F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    me = lambda c: F.col(f"me.{c}")
    ahead = F.size(F.filter("ratings", lambda r: r - me("rating") > RATING_BETTER))
    rules = [
        ("high", "promo_absent", (me("headline") == "") & (F.col("n_sale") >= least), F.col("n_sale")),
        ("medium", "promo_shallow", ~((me("headline") == "") & (F.col("n_sale") >= least)) & (me("pct") != 0) & (me("pct") < F.col("mean_pct") - DISCOUNT_BEHIND), F.col("mean_pct")),
        ("high", "bnpl_gap", (F.size(me("bnpl")) == 0) & (F.col("n_bnpl") >= least), F.col("n_bnpl")),
        ("medium", "free_delivery_gap", ~me("threshold").eqNullSafe(F.lit(0)) & (F.col("n_free") >= least), F.col("n_free")),
        ("medium", "signup_gap", (me("signup") == "") & (F.col("n_signup") >= least), F.col("n_signup")),
        ("low", "accessibility_gap", me("access") < F.col("mean_access") - ACCESS_BEHIND, F.col("mean_access")),
        ("medium", "rating_behind", (me("rating") > 0) & (F.col("n_rated") >= 2) & (F.col("mid_rating") - me("rating") >= RATING_BEHIND) & (ahead >= 2), F.col("mid_rating")),
        ("medium", "rating_absent", F.coalesce(me("rating"), F.lit(0.0)).eqNullSafe(F.lit(0.0)) & (F.col("n_rated") >= least), F.col("n_rated")),
        ("low", "range_short", (me("n_products") > 0) & (me("n_products") <= F.col("mid_products") * RANGE_SHARE), F.col("mid_products")),
    ]
    made = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(p).alias("priority"), F.lit(i).alias("seq"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))) for i, (p, kind, cond, value) in enumerate(rules)]))
    out = own.crossJoin(pack).select(F.explode(made).alias("r")).select("r.*")  # one row by one row
    if shares is not None:
        out = out.unionByName(_mix_gap(shares, all_facts, len(rules)))
    if silent_answers is not None:
        out = out.unionByName(silent_answers.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("high").alias("priority"), F.lit(len(rules) + 1).alias("seq"), F.lit("answers_silent").alias("kind"), F.col("n").cast("double").alias("value")))
    return out


def _mix_gap(shares: DataFrame, all_facts: DataFrame, seq: int) -> DataFrame:
    """The category in which the brands that list it lead the own one most; absent isn't zero for the pack, but is for the own brand."""
    joined = shares.join(all_facts.select("slug", "own"), "slug")
    per = joined.groupBy("category").agg(F.avg(F.when(~F.col("own"), F.col("share"))).alias("mean"), F.count_if(~F.col("own")).alias("n"), F.coalesce(F.max(F.when(F.col("own"), F.col("share"))), F.lit(0.0)).alias("mine"))
    lead = per.filter((F.col("n") >= 2) & (F.col("mean") >= MIX_SHARE) & (F.col("mean") - F.col("mine") >= MIX_LEAD))
    return lead.orderBy(F.desc(F.col("mean") - F.col("mine")), F.desc("category")).limit(1).select(F.lit("medium").alias("priority"), F.lit(seq).alias("seq"), F.concat(F.lit("mix_gap:"), "category").alias("kind"), (F.col("mean") - F.col("mine")).alias("value"))


def by_priority(found: DataFrame) -> DataFrame:
    return found.orderBy(F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority")), "seq")
