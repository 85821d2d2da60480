"""Sources mixed to target shares of the token volume: weighted fair queueing.

Every use of a document gets a virtual finish time, the source's cumulative tokens up to it
in shuffled order divided by the source's weight. Sorted by that time, each prefix of the
mix holds the sources in their shares; the mix ends at the total budget. Cumulative sums
are taken in two steps, over hash buckets and within one, so that no source is one task.

The budget, where none is given, is the largest at which no source runs out of uses: the
least of tokens * max_repeats / weight over the sources that have documents. With a budget
given, a source that runs out leaves its share to the others in proportion to their weights,
as in any fair queue, and the mix ends at the time at which all sources together have given
the budget (or when all have run out). Weights of sources without documents are shared out
in the same way. What a source missed is reported.

Defined results: null texts and texts without tokens are never used; a document is used at
most max_repeats times, a second time only after all of its source were used once; equal
documents are documents of their own; a mix whose sources are all empty gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import checkpointed, lookup_join

#: Documents of a bucket of a source's shuffled order, and its buckets at least: a bucket is summed in one task.
BUCKET_ITEMS, LEAST_BUCKETS = 20_000, 64


def mix(sized: DataFrame, item: str, source: str, targets: DataFrame, budget: int | None = None, seed: int = 1, planned: DataFrame | None = None) -> DataFrame:
    """(mix_name, source, item, use_no, n_tokens, finish_time), sorted by mix and finish time; targets: mix_name, source, target_share, max_repeats (small)."""
    items = checkpointed(_items(sized, item, source))
    plan = plan_of(items, "item", "source", targets, budget) if planned is None else planned
    uses = lookup_join(items, plan, ["source"]) if plan.groupBy("source").count().filter("count > 1").isEmpty() else _per_mix(items, plan)
    # uses that can come before the end: round e of a source starts at e times its tokens
    uses = uses.select("*", F.explode(F.expr("sequence(1, greatest(1, least(max_repeats, cast(ceil(weight * until / source_tokens) as int))))")).alias("use_no"))
    uses = uses.withColumn("_h", F.xxhash64(F.lit(seed), "mix_name", "use_no", "item")).withColumn("_b", F.pmod(F.col("_h"), F.col("buckets")))
    place = ["mix_name", "source", "use_no", "_b"]
    sums = uses.groupBy(*place).agg(F.sum("n_tokens").alias("_sum"))  # a row a bucket
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("mix_name", "source").orderBy("use_no", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(sums.withColumn("_ahead", ahead).drop("_sum"))
    within = F.sum("n_tokens").over(Window.partitionBy(*place).orderBy("_h", "item").rowsBetween(Window.unboundedPreceding, 0))
    timed = lookup_join(uses.withColumn("_within", within), starts, place).withColumn("finish_time", (F.col("_ahead") + F.col("_within")) / F.col("weight"))
    kept = timed.filter("finish_time <= until").select("mix_name", "source", "item", "use_no", "n_tokens", "finish_time")
    return kept.orderBy("mix_name", "finish_time", "source", "item")


def _items(sized: DataFrame, item: str, source: str) -> DataFrame:
    return sized.select(F.col(item).alias("item"), F.col(source).alias("source"), "n_tokens").filter("n_tokens > 0 AND source IS NOT NULL")


def _per_mix(items: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows of a source as one array, so that a document meets each of its mixes."""
    cols = [c for c in plan.columns if c != "source"]
    lists = checkpointed(plan.groupBy("source").agg(F.collect_list(F.struct(*cols)).alias("_m")))
    return lookup_join(items, lists, ["source"]).select("item", "source", "n_tokens", F.explode("_m").alias("_m")).select("item", "source", "n_tokens", "_m.*")


def plan_of(sized: DataFrame, item: str, source: str, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(mix_name, source, weight, max_repeats, source_tokens, supply, buckets, until, exhausted), a row a target whose source has documents.

    until: the finish time at which the mix ends. By time t a source has given the lesser of weight * t
    and its supply; the sum of these over a mix's sources reaches the budget at until.
    """
    totals = _items(sized, item, source).groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.greatest(F.lit(LEAST_BUCKETS), F.ceil(F.count(F.lit(1)) / BUCKET_ITEMS)).cast("int").alias("buckets"))
    live = targets.select("mix_name", "source", F.col("target_share").alias("share"), "max_repeats").filter("share > 0 AND max_repeats > 0").join(totals, "source")
    w = Window.partitionBy("mix_name")  # a mix's targets, a handful of rows
    live = live.withColumn("weight", F.col("share") / F.sum("share").over(w)).withColumn("supply", F.col("source_tokens") * F.col("max_repeats")).withColumn("_ends", F.col("supply") / F.col("weight"))
    if budget is None:
        live = live.withColumn("until", F.floor(F.min("_ends").over(w)).cast("double"))
    else:
        by_end = w.orderBy("_ends", "source")
        upto, after = by_end.rowsBetween(Window.unboundedPreceding, 0), by_end.rowsBetween(1, Window.unboundedFollowing)
        given = F.sum("supply").over(upto) + F.col("_ends") * F.coalesce(F.sum("weight").over(after), F.lit(0.0))
        live = live.withColumn("_out", given <= budget)
        spent, waiting = F.sum(F.when(F.col("_out"), F.col("supply")).otherwise(0)).over(w), F.sum(F.when(~F.col("_out"), F.col("weight")).otherwise(0.0)).over(w)
        live = live.withColumn("until", F.when(waiting > 0, (budget - spent) / waiting).otherwise(F.max("_ends").over(w)))
    return checkpointed(live.withColumn("exhausted", F.col("_ends") <= F.col("until")).select("mix_name", "source", "weight", "max_repeats", "source_tokens", "supply", "buckets", "until", "exhausted"))


def report(mixed: DataFrame, targets: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Per mix and source: target share, share reached, share missed, tokens, documents, the most uses of one and, with the plan, the source's supply and whether it ran out."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_uses"), F.max("use_no").alias("most_uses"))
    full = targets.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left").fillna(0, ["n_tokens", "n_uses", "most_uses"])
    if planned is not None:
        full = full.join(planned.select("mix_name", "source", "supply", "exhausted"), ["mix_name", "source"], "left").fillna(0, ["supply"]).fillna(True, ["exhausted"])
    total = F.sum("n_tokens").over(Window.partitionBy("mix_name"))
    full = full.withColumn("actual_share", F.coalesce(F.expr("try_divide(n_tokens, 1D)") / F.when(total > 0, total), F.lit(0.0)))
    return full.withColumn("missed_share", F.greatest(F.lit(0.0), F.col("target_share") - F.col("actual_share")))
