"""Parquet tables of a data folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a single file and a directory of parts read alike."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: dict[str, str]) -> None:
    """Temporary views of a folder's tables; one that is missing becomes an empty view. names: table -> schema of the empty one (DDL)."""
    from vitrine.sources.files import exists

    for name, ddl in names.items():
        path = f"{folder.rstrip('/')}/{name}.parquet"
        (table(spark, folder, name) if exists(spark, path) else spark.createDataFrame([], ddl)).createOrReplaceTempView(name)
