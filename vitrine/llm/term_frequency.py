"""Frequency of every distinct value or term, with bounds.

Each record emits its uses of terms with their weights, the first use of a term with the
record's mark. One hash aggregate then sums both; its map side combines before the
shuffle, so a term that sits in every record costs one row per task.

Defined results: null lists and null or blank terms emit nothing; a null weight counts as
0 uses; a term that a record has twice counts once as a record; an empty table gives no
rows; other columns are ignored. Long lists cost time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import blank_free

#: Items of a list whose first uses are marked by looking back.
SHORT = 200


def normal_term(c: Column) -> Column:
    return F.lower(blank_free(c))


def term_counts(df: DataFrame, fields: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """(field_name, term, n_uses, n_records). fields: name -> (array of terms, array of weights or None for 1 each)."""
    emitted = []
    for name, (terms, weights) in fields.items():
        normal = F.transform(terms, normal_term)
        weight = F.transform(terms, lambda _: F.lit(1).cast("long")) if weights is None else F.transform(weights, lambda w: F.coalesce(w.cast("long"), F.lit(0).cast("long")))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        entry = lambda t, u, r: F.struct(F.lit(name).alias("f"), t.alias("t"), u.alias("u"), r.alias("r"))  # noqa: B023, E731
        zipped = lambda r: F.arrays_zip(r["t"].alias("t"), r["w"].alias("w"))
        # a short list marks first uses by looking back; a long one, where that would grow with the square, emits each distinct term once more
        short = lambda r: F.transform(zipped(r), lambda z, i: entry(z["t"], F.coalesce(z["w"], zero), F.when(F.array_position(r["t"], z["t"]) == i + 1, one).otherwise(zero)))  # noqa: B023, E731
        long = lambda r: F.concat(F.transform(zipped(r), lambda z: entry(z["t"], F.coalesce(z["w"], zero), zero)), F.transform(F.array_distinct(r["t"]), lambda t: entry(t, zero, one)))  # noqa: B023, E731
        # the list is normalised once: a lambda's variable isn't expanded at each use
        uses = F.element_at(F.transform(F.array(F.struct(normal.alias("t"), weight.alias("w"))), lambda r: F.when(F.size(r["t"]) <= SHORT, short(r)).otherwise(long(r))), 1)  # noqa: B023
        emitted.append(F.coalesce(uses, F.array().cast("array<struct<f:string,t:string,u:bigint,r:bigint>>")))
    rows = df.select(F.explode(F.concat(*emitted)).alias("_e")).filter("_e.t IS NOT NULL AND _e.t <> ''")
    return rows.groupBy(F.col("_e.f").alias("field_name"), F.col("_e.t").alias("term")).agg(F.sum("_e.u").alias("n_uses"), F.sum("_e.r").alias("n_records"))


def marked(counts: DataFrame, total: DataFrame, rare: int, common_share: float) -> DataFrame:
    """Adds mark: 'rare' with at most `rare` records, 'common' with more than `common_share` of all records, else null.

    total: one row, column n, the number of all records.
    """
    n = F.col("n_records")
    mark = F.when(n <= rare, F.lit("rare")).when(n > common_share * F.col("n"), F.lit("common"))
    return counts.crossJoin(F.broadcast(total)).withColumn("mark", mark).drop("n")  # one row, by construction
