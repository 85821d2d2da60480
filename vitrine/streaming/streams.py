"""Streaming forms of the history's operators over a file stream of events or captures."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vitrine.session import ensure_checkpoint_dir
from vitrine.sources.files import upsert_store


def read_events(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """A file stream with the schema of an existing file; zone-less times become timestamps, as watermarks need them."""
    fixed = spark.read.parquet(sample).schema
    stream = spark.readStream.schema(fixed).parquet(path)
    naive = [f.name for f in fixed.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Tumbling or sliding counts and sums with a watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, time: str, by: str, gap: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def deduplicated(stream: DataFrame, time: str, key: Sequence[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def transitions(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, at, before, after): changes between consecutive records of a key, kept across batches; a record older than the last one seen is ignored."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(time)
        out = []
        for t, v in zip(rows[time], rows[value]):
            micros = int(pd.Timestamp(t).value // 1000)
            if at is not None and micros < at:
                continue
            if at is not None and v != last:
                out.append((k[0], t, last, v))
            last, at = v, micros
        state.update((last, at))
        yield pd.DataFrame(out, columns=["key", "at", "before", "after"])

    return stream.groupBy(key).applyInPandasWithState(step, f"key {kind}, at timestamp, before string, after string", "last string, at long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], date: str, order: Sequence[str]):
    """A keyed store kept by a stream: each batch replaces its keys' records."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_store(batch.sparkSession, path, batch, key, date, order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all input that is there, and gives what it wrote: a table in the shared checkpoint folder. 'complete' results replace each other, appended ones add up."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, sink: Callable | None = None) -> DataFrame:
    """Drains the available input into a memory table and returns it; for tests and small results."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return df.sparkSession.table(name)
