"""Column-level data quality: declared constraints compiled into one aggregate scan.

States are mergeable: counts and sums add, ranges extend, distinct counts are HLL
sketches that unite. So states per partition or delivery can be kept and merged later
without reading the rows again. Metrics come from states; a metric's move from the load
before is held against control limits.

Defined results: null is its own case (a constraint says whether null is allowed); a
group without values has null ranges and a null mean; ranges and means of dates and
timestamps are in seconds since 1970, of booleans in 0 and 1; text has a range and mean of
its length, under names of their own, and no other; an empty table gives no states;
repeated rows count as often as they occur; columns that aren't profiled are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.session import checkpointed, lookup_join
from vitrine.sources.files import read_generation, write_generation

#: lg(k) of the distinct sketches: 2^11 buckets, a relative error of about 2.3 %.
SKETCH_LGK = 11


@dataclass(frozen=True)
class ColumnSpec:
    """A column to profile. numeric: a number, date, timestamp or boolean, else its text's length is measured. valid: condition over its value, or None for no constraint; null is valid where nullable.
    shares: name -> condition, whose share is tracked. mean_of: condition for values that enter the mean."""

    name: str
    value: Column
    valid: Column | None = None
    nullable: bool = True
    numeric: bool = False
    shares: dict[str, Column] = field(default_factory=dict)
    mean_of: Column | None = None

    def violated(self) -> Column:
        ok = F.lit(True) if self.valid is None else F.coalesce(self.valid, F.lit(False))
        return F.when(self.value.isNull(), F.lit(not self.nullable)).otherwise(~ok)


def row_violations(df: DataFrame, item: str, specs: Sequence[ColumnSpec]) -> DataFrame:
    """(item_id, column_name), one row per row and column whose value is out of its domain."""
    hit = F.array_compact(F.array(*[F.when(s.violated(), F.lit(s.name)) for s in specs]))
    return df.select(F.col(item).alias("item_id"), F.explode(hit).alias("column_name"))


def states(df: DataFrame, by: list[str], specs: Sequence[ColumnSpec], sketches: bool = False) -> DataFrame:
    """One mergeable state row per group and column, from a single scan with map-side combine."""
    aggs = []
    for s in specs:
        v, parts = s.value, {}
        parts["rows"] = F.count(F.lit(1))
        parts["nulls"] = F.count_if(v.isNull())
        parts["violations"] = F.count_if(s.violated())
        parts["by_length"] = F.lit(not s.numeric)
        number = v.cast("double") if s.numeric else F.length(v.cast("string")).cast("double")
        parts["low"], parts["high"] = F.min(number), F.max(number)
        kept = F.when(s.mean_of, number) if s.mean_of is not None else number
        parts["total"], parts["counted"] = F.coalesce(F.sum(kept), F.lit(0.0)), F.count(kept)
        parts["share_rows"] = F.count_if(next(iter(s.shares.values()))) if s.shares else F.lit(None).cast("long")
        if sketches:
            parts["sketch"] = F.hll_sketch_agg(v.cast("string"), SKETCH_LGK)
        aggs.append(F.struct(F.lit(s.name).alias("column_name"), *[c.alias(k) for k, c in parts.items()]).alias(f"_{len(aggs)}"))
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[F.col(f"_{i}") for i in range(len(aggs))])).alias("_s")).select(*by, "_s.*")


def merge_states(parts: DataFrame, by: list[str]) -> DataFrame:
    """States of coarser groups from states of finer ones (partitions, deliveries); adding one delivery reads its state only."""
    add = {k: F.sum(k) for k in ("rows", "nulls", "violations", "total", "counted", "share_rows")}
    add |= {"low": F.min("low"), "high": F.max("high")}
    if "sketch" in parts.columns:
        add["sketch"] = F.hll_union_agg("sketch")
    return parts.groupBy(*by, "column_name", "by_length").agg(*[c.alias(k) for k, c in add.items()])


def update_states(spark: SparkSession, path: str, df: DataFrame, by: list[str], specs: Sequence[ColumnSpec], sketches: bool = True) -> DataFrame:
    """The states of all groups, kept in a folder: only groups that are new, or whose number of rows has changed, are profiled; the others' states are read.

    Finding them reads the group columns alone. Groups are compared null-safe.
    """
    kept = read_generation(spark, path)
    if kept is None:
        write_generation(states(df, by, specs, sketches), path)
        return read_generation(spark, path)
    known = kept.groupBy(*by).agg(F.max("rows").alias("_known")).select(F.struct(*by).alias("_g"), "_known")
    now = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).select(F.struct(*by).alias("_g"), "_rows")
    # a struct of nulls equals its like, as a plain key doesn't
    stale = checkpointed(now.join(known, "_g", "left").filter(~F.col("_rows").eqNullSafe(F.col("_known"))).select("_g"))
    if not stale.isEmpty():
        old = lookup_join(kept.withColumn("_g", F.struct(*by)), stale, ["_g"], "left_anti").drop("_g")
        fresh = states(lookup_join(df.withColumn("_g", F.struct(*by)), stale, ["_g"]).drop("_g"), by, specs, sketches)
        write_generation(old.unionByName(fresh), path)
    return read_generation(spark, path)


def metrics(state: DataFrame) -> DataFrame:
    """Null share, violation share, tracked share, mean and range (of the values or of their texts' lengths) and distinct estimate of each state."""
    extra = [F.hll_sketch_estimate("sketch").alias("distinct_estimate")] if "sketch" in state.columns else []
    keys = [c for c in state.columns if c not in ("rows", "nulls", "violations", "low", "high", "total", "counted", "share_rows", "sketch", "by_length")]
    measured = {"mean": F.expr("try_divide(total, counted)"), "low": F.col("low"), "high": F.col("high")}
    return state.select(
        *keys, "rows", "nulls", "violations",
        (F.col("nulls") / F.col("rows")).alias("null_share"),
        (F.col("share_rows") / F.col("rows")).alias("tracked_share"),
        *[F.when(~F.col("by_length"), c).alias(k) for k, c in measured.items()],
        *[F.when(F.col("by_length"), c).alias(f"length_{k}") for k, c in measured.items()], *extra,
    )


def shifts(metric: DataFrame, series: list[str], order: str, limits: dict[str, float]) -> DataFrame:
    """Metrics whose move from the series' previous load exceeds the limit: (series, order, column_name, metric, moved).

    Runs over metric rows (one per load and column), never over data rows.
    """
    w = Window.partitionBy(*series, "column_name").orderBy(order)
    moves = [F.when(F.abs(F.col(m) - F.lag(m).over(w)) > limit, F.struct(F.lit(m).alias("metric"), (F.col(m) - F.lag(m).over(w)).alias("moved"))) for m, limit in limits.items()]
    found = metric.select(*series, order, "column_name", F.array_compact(F.array(*moves)).alias("_m"))
    return found.select(*series, order, "column_name", F.explode("_m").alias("_m")).select(*series, order, "column_name", "_m.*")


def control_limits(metric: DataFrame, series: list[str], order: str, names: Sequence[str], sigmas: float = 3.0, least: int = 3, floor: float = 0.02, levels: dict[str, Column] | None = None, level_floor: float = 0.05) -> DataFrame:
    """Metrics outside mean +- sigmas * deviation of the series' earlier loads (at least `least` of them).

    The deviation counts as `floor` at least; for metrics in levels (name -> size of its values) as `level_floor` times the earlier loads' level.
    """
    w = Window.partitionBy(*series, "column_name").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tests = []
    for m in names:
        lowest = F.lit(floor) if m not in (levels or {}) else level_floor * F.avg(levels[m]).over(w)
        value = F.col(m).cast("double")
        centre, spread = F.avg(value).over(w), F.greatest(F.stddev_samp(value).over(w), lowest)
        tests.append(F.when((F.count(value).over(w) >= least) & (F.abs(value - centre) > sigmas * spread), F.struct(F.lit(m).alias("metric"), value.alias("value"), centre.alias("centre"), spread.alias("spread"))))
    found = metric.select(*series, order, "column_name", F.array_compact(F.array(*tests)).alias("_t"))
    return found.select(*series, order, "column_name", F.explode("_t").alias("_t")).select(*series, order, "column_name", "_t.*")
