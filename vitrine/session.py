"""Session defaults and the few cluster helpers every operator shares."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that may be broadcast, in rows and in bytes, after it has been measured.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
#: Parts into which a hot key is split when a side is too large to broadcast.
SALTS = 16


def build_session(master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine's results assume (UTC, AQE)."""
    b = SparkSession.builder.appName("vitrine")
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # checkpoint files go when their DataFrames do
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder named by spark.checkpoint.dir. Where none is set, a local session gets a folder of its own; a cluster session is refused, as its executors share no temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "vitrine-checkpoints"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that the part survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """A row's size, near enough: texts and binaries by their length, nested values by their JSON, the rest 8 bytes each."""
    size = F.lit(16)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            size = size + F.lit(8)
    return size


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a side is within both bounds; a count that stops at the first bound."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a large side to a lookup whose keys are unique, whatever the skew of the large side.

    The lookup is measured first: up to max_rows and BROADCAST_BYTES it is broadcast, beyond that it is
    replicated SALTS times and the large side's rows of a key are spread over the copies, by a merge: else
    the planner may broadcast either side, by an estimate from compressed files that is many times too small.
    Give a lookup that is cheap to read twice (a checkpoint or a table).
    """
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in on] or [F.lit(0)]), F.lit(SALTS)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", salt).join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that none depends on the driver's folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "vitrine"), "zip", os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(made)


def blank_free(c: Column) -> Column:
    """Trims blanks of any kind (no-break ones too) and folds their runs into one space."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s   ]+", " "))
