"""What changed between full snapshots.

Set snapshots (a list of item keys per group and date): every item gets a persistent
ordinal within its group; a snapshot becomes a compressed bitmap, stored as its non-zero
64-bit words; AND-NOT of a date's words with those of the date before gives additions
and removals. Items, and the dictionary of ordinals given earlier, cross the network once.
The dictionary can be kept in a folder, where each run reads it and adds the items that are new.

Record snapshots (fields per key and date): a key's dates become ordinals, each field an
ordinal-aligned vector, and neighbours in the vector are compared.

Defined results: rows with a null date or a null group key take part like any value (groups
are compared null-safe); null and blank items are dropped; a date's repeated deliveries count once,
the latest one by the order columns given; an empty table gives no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.files import read_generation, write_generation

#: Shards of a group's ordinal space: a hot group is spread over so many tasks. A dictionary keeps the number it began with.
SHARDS = 16


def latest_delivery(df: DataFrame, keys: dict[str, Column], order: list[Column], payload: dict[str, Column]) -> DataFrame:
    """One row per key, with the payload of the delivery that comes last by the order columns (aggregated before the shuffle)."""
    kept = df.select(*[c.alias(k) for k, c in keys.items()], F.struct(*order).alias("_o"), F.struct(*[c.alias(k) for k, c in payload.items()]).alias("_p"))
    best = kept.groupBy(*keys).agg(F.max_by("_p", "_o").alias("_p"))
    return best.select(*keys, *[F.col("_p")[k].alias(k) for k in payload])


def shard_of(item: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(shards)).cast("int")


def assign_ordinals(items: DataFrame, group: list[str], item: str, existing: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """A dictionary (group, _shard, item) -> _ord; ordinals already given stay, new items follow on.

    An item's shard is a hash of it, and ordinals are dense within (group, shard); both
    together identify an item for good. Groups are compared null-safe.
    """
    rows = items.select(*group, shard_of(F.col(item), shards).alias("_shard"), F.col(item).alias("item"), F.lit(0).alias("_at")).filter("item IS NOT NULL")
    return _numbered(rows, group, existing).select(*group, "_shard", F.col("item").alias(item), "_ord")


def _numbered(rows: DataFrame, group: list[str], existing: DataFrame | None) -> DataFrame:
    """(group, _shard, item, _at, _ord) from rows of (group, _shard, item, _at): a row an item with all its _at as a list; items that only the dictionary has come along with none."""
    rows = rows.select(*group, "_shard", "item", "_at", F.lit(None).cast("long").alias("_old"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*group, "_shard", "item", F.col("_ord").alias("_old")), allowMissingColumns=True)
    # one partitioning, by group and shard, serves the items and their numbering
    per_item = rows.repartition(*[F.col(c) for c in (*group, "_shard")]).groupBy(*group, "_shard", "item").agg(F.collect_list("_at").alias("_at"), F.max("_old").alias("_old"))
    w = Window.partitionBy(*group, "_shard")
    new = F.row_number().over(w.orderBy(F.col("_old").isNotNull(), F.col("item")))
    begins = F.coalesce(F.max("_old").over(w) + 1, F.lit(0)) if existing is not None else F.lit(0)
    return per_item.select(*group, "_shard", "item", "_at", F.coalesce("_old", begins + new - 1).cast("long").alias("_ord"))


def set_changes(snapshots: DataFrame, group: list[str], date: str, items: str, existing: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """Added and removed items per group and date against the date before: (group, date, change_kind, item).

    snapshots: one row per (group, date), items an array of keys. The first date of a
    group has no predecessor and gives no rows. existing: a dictionary of ordinals given earlier.
    """
    return _changes(_presence(snapshots, group, date, items, existing, shards), group, date)


def set_changes_kept(snapshots: DataFrame, group: list[str], date: str, items: str, path: str, shards: int = SHARDS) -> DataFrame:
    """set_changes with its dictionary in a folder: read, extended by the new items and written as the next generation."""
    spark = snapshots.sparkSession
    rows = _presence(snapshots, group, date, items, read_generation(spark, path), shards)
    write_generation(rows.select(*group, "_shard", "item", "_ord"), path)
    return set_changes(snapshots, group, date, items, read_generation(spark, path), shards)


def _presence(snapshots: DataFrame, group: list[str], date: str, items: str, existing: DataFrame | None, shards: int) -> DataFrame:
    """(group, _shard, item, _ord, _at): each item with its ordinal and the dates that hold it, each with the date that follows in the group and whether it is the group's first."""
    # which date follows which: over light rows, without the arrays
    w = Window.partitionBy(*group).orderBy(date)
    calendar = snapshots.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*group, date))], F.lead(date).over(w).alias("_next"), (F.row_number().over(w) == 1).alias("_head"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*group, date))]
    dated = snapshots.select(*group, date, F.col(items).alias("_items")).join(calendar, same)
    at = F.struct(F.col(date).alias("d"), F.col("_next").alias("n"), F.col("_head").alias("h")).alias("_at")
    flat = dated.select(*group, at, F.explode(F.array_distinct("_items")).alias("item")).filter(F.length(F.trim("item")) > 0)
    return _numbered(flat.withColumn("_shard", shard_of(F.col("item"), shards)), group, existing)


def _changes(rows: DataFrame, group: list[str], date: str) -> DataFrame:
    # words of the bitmaps: 64 ordinals to a word, zero words aren't stored. An item counts as current for its date and as previous for the next one
    word, bit = F.shiftright("_ord", 6).alias("_word"), F.expr("shiftleft(1L, cast(_ord & 63 as int))")
    spread = rows.select(*group, "_shard", word, bit.alias("_bit"), "item", F.explode("_at").alias("_at"))
    nothing = F.lit(0).cast("long")
    sides = spread.select(
        *group, "_shard", "_word", F.struct("_bit", "item").alias("_e"),
        F.explode(F.array(
            F.struct(F.when(~F.col("_at.h"), F.col("_at.d")).alias("on"), F.col("_bit").alias("cur"), nothing.alias("prev")),
            F.struct(F.col("_at.n").alias("on"), nothing.alias("cur"), F.col("_bit").alias("prev")),
        )).alias("_s"),
    ).filter("_s.on IS NOT NULL")
    # a word comes with the part of the dictionary that it needs, 64 entries at most: nothing is looked up later
    words = sides.groupBy(*group, "_shard", "_word", F.col("_s.on").alias(date)).agg(
        F.expr("bit_or(_s.cur)").alias("_cur"), F.expr("bit_or(_s.prev)").alias("_prev"), F.collect_set("_e").alias("_names")
    )
    words = words.select(*group, date, "_names", F.expr("_cur & ~_prev").alias("_added"), F.expr("_prev & ~_cur").alias("_removed")).filter("_added <> 0 OR _removed <> 0")
    named = lambda c, kind: f"transform(filter(_names, e -> e._bit & {c} <> 0), e -> named_struct('change_kind', '{kind}', 'item', e.item))"
    changed = words.select(*group, date, F.expr(f"explode(concat({named('_added', 'added')}, {named('_removed', 'removed')}))").alias("_c"))
    return changed.select(*group, date, "_c.change_kind", "_c.item")


def field_changes(records: DataFrame, key: list[str], date: str, fields: dict[str, Column]) -> DataFrame:
    """Fields that differ from the key's date before: (key, date, item), item the field's name.

    records: one row per (key, date). A key's vectors hold one entry a date, so their
    length is bounded by the number of snapshots, not by the rows delivered.
    """
    entry = F.struct(F.col(date).alias("d"), *[c.alias(f) for f, c in fields.items()])
    vectors = records.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_v")).filter(F.size("_v") > 1)
    compare = ", ".join(f"if(_v[i].`{f}` <=> _v[i - 1].`{f}`, null, '{f}')" for f in fields)
    steps = vectors.select(*key, F.expr(f"explode(transform(sequence(1, size(_v) - 1), i -> named_struct('d', _v[i].d, 'items', array_compact(array({compare})))))").alias("_s"))
    return steps.select(*key, F.col("_s.d").alias(date), F.explode("_s.items").alias("item"))
