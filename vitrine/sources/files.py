"""Files in and out: fault-tolerant JSON, keyed stores, images, answers and rosters as config."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.history import keep_last, upsert


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything that a reader would see."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(where))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """A JSON file, array or lines. A missing path gives no rows; unreadable records are left out. Other faults of the path are raised."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in kind.fields if f.name != "_bad"]
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType(kept))
    read = spark.read.schema(T.StructType([*kept, T.StructField("_bad", T.StringType())])).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return read.json(path).filter("_bad IS NULL").drop("_bad")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_by_date(df: DataFrame, path: str, date: str) -> None:
    """Parquet by date; only the dates that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def _pending(path: str) -> str:
    return path.rstrip("/") + ".pending"


def finish_pending(spark: SparkSession, path: str, date: str) -> None:
    """Completes a merge that was interrupted: whole pending partitions replace the store's, half-written ones are thrown away."""
    staged = _pending(path)
    if exists(spark, f"{staged}/_SUCCESS"):
        write_by_date(spark.read.parquet(f"{staged}/rows"), path, date)
        _delete(spark, f"{staged}/_SUCCESS")
    if exists(spark, staged):
        _delete(spark, staged)


def read_store(spark: SparkSession, path: str, date: str) -> DataFrame | None:
    """A keyed store with the columns of all its batches; None where there is none yet."""
    finish_pending(spark, path, date)
    return spark.read.option("mergeSchema", "true").parquet(path) if has_rows(spark, path) else None


def stage_upsert(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], date: str, order: Sequence[str]) -> None:
    """Writes the merged partitions of a batch's dates beside the store; nothing of the store is touched."""
    old = read_store(spark, path, date)
    dates = new.select(F.col(date).alias("_date")).distinct()
    if old is not None:
        first, last = dates.agg(F.min("_date"), F.max("_date")).first()  # keeps the read to the batch's span
        at = F.col(date)
        old = old.withColumn(date, at.cast(new.schema[date].dataType)).filter(at.between(F.lit(first), F.lit(last)) | at.isNull())
        old = old.join(dates, at.eqNullSafe(F.col("_date")), "left_semi")
    staged = _pending(path)
    # the date is kept as a column: a partition folder's name would come back as another type
    (upsert(new, None, key, order) if old is None else upsert(old, new, key, order)).write.mode("overwrite").parquet(f"{staged}/rows")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()


def upsert_store(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], date: str, order: Sequence[str]) -> None:
    """Merges a batch into a store: only the partitions of the batch's dates are read and rewritten.

    The merge is written in full beside the store before any stored file is replaced, so a run that is
    lost at any point either leaves the store as it was or is completed by the next run (or by
    read_store). Columns that only the store or only the batch has are kept, null where they lack.
    """
    stage_upsert(spark, path, new, key, date, order)
    finish_pending(spark, path, date)


def append_log(spark: SparkSession, path: str, new: DataFrame, order: Sequence[str], n: int, replaces: Sequence[str] = ()) -> None:
    """A bounded log: the batch is added, rows of the batch's own `replaces` values go first, and the last n whole records by `order` stay.

    Written beside the old log and swapped in by renaming; the bound is the log's feature, so it is a small table.
    """
    at = path.rstrip("/")
    if exists(spark, f"{at}.next/_SUCCESS") and not exists(spark, at):
        _rename(spark, f"{at}.next", at)
    old = spark.read.parquet(at) if exists(spark, f"{at}/_SUCCESS") else None
    if old is not None and replaces:
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in replaces]
        old = old.alias("o").join(new.select(*replaces).distinct().alias("n"), same, "left_anti")
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    keep_last(rows, order, n).coalesce(1).write.mode("overwrite").parquet(f"{at}.next")
    if exists(spark, at):
        _delete(spark, at)
    _rename(spark, f"{at}.next", at)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(old)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).rename(where, spark._jvm.org.apache.hadoop.fs.Path(new))


def _generation(spark: SparkSession, path: str) -> int:
    n = 0
    while has_rows(spark, f"{path}/{n + 1}/_done"):
        n += 1
    return n


def read_generation(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete generation of a table that is kept in whole generations; None where there is none."""
    n = _generation(spark, path)
    return spark.read.parquet(f"{path}/{n}") if n else None


def write_generation(df: DataFrame, path: str) -> None:
    """Writes the next generation beside those before it, and marks it as complete last."""
    to = f"{path}/{_generation(df.sparkSession, path) + 1}"
    df.write.mode("overwrite").parquet(to)
    df.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{to}/_done")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of image files."""
    return spark.read.format("binaryFile").load(path)


def seed_history(spark: SparkSession, brands: int = 7, days: int = 7, seed: int = 3) -> DataFrame:
    """A made-up capture history for tests: brands x days, from arithmetic on a seeded hash."""
    n = spark.range(brands * days).select((F.col("id") % brands).alias("b"), F.floor(F.col("id") / brands).cast("int").alias("d"))
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "b", "d"), F.lit(100))
    pct = F.when(h("pct") < 40, (h("size") % 6 + 1) * 10).cast("int")
    return n.select(
        F.concat(F.lit("brand-"), "b").alias("slug"), F.concat(F.lit("Brand "), "b").alias("brand"), F.date_add(F.lit("2025-03-03").cast("date"), F.col("d")).alias("capture_date"),
        (F.col("b") == 0).alias("is_self"), F.when(h("fail") < 8, "failed").otherwise("success").alias("status"), pct.alias("max_discount_pct"),
        F.when(pct.isNotNull(), F.concat_ws(" ", F.lit("up to"), pct.cast("string"), F.lit("% off"))).alias("headline_offer"), F.concat(F.lit("Message "), (h("hero") % 3).cast("string")).alias("hero_message"),
    )
