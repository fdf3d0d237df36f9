"""Incremental ingestion with Structured Streaming.

Ingest, session grouping and interval joins run as streams; elections, ballots and components need all
rows of a group and belong in ``foreachBatch``. Every stream here gives what its batch counterpart gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def ingest(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once, the first time it arrives; keys older than the watermark are forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, by: list[str], time: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of rows with at most ``gap`` between one and the next: bounds and counts, complete when the watermark has passed."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def interval_join(left: DataFrame, right: DataFrame, by: str, time: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows of two streams at most ``seconds`` apart with equal ``by``; state is dropped by watermark."""
    a = (left.withWatermark(time, late) if left.isStreaming else left).alias("a")
    b = (right.withWatermark(time, late) if right.isStreaming else right).alias("b")
    near = F.expr(f"a.{by} = b.{by} and b.{time} >= a.{time} - interval {seconds} seconds and b.{time} <= a.{time} + interval {seconds} seconds")
    return a.join(b, near)


def earliest(stream: DataFrame, key: str, time: str, source: str) -> DataFrame:
    """The earliest claim per key so far; a late claim may only move it earlier. Emits each improvement."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        new = best
        for p in parts:
            for t, s in zip(p["_t"], p[source], strict=True):
                if new is None or (t, s) < tuple(new):
                    new = (int(t), s)
        if new != best:
            state.update(new)
            yield pd.DataFrame({key: [k[0]], "t": [new[0]], "source": [new[1]]})

    rows = stream.withColumn("_t", F.unix_micros(time)).select(key, "_t", source)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t long, source string", "t long, source string", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch, and returns; the checkpoint makes a restart go on where it stopped."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def regroup(stream: DataFrame, checkpoint: str, state: str, rebuild: Callable[[DataFrame], DataFrame], out: str) -> None:
    """After each batch, adds it to the table ``state`` (a batch that is retried overwrites itself) and rebuilds what depends on all rows into ``out``."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")
        rebuild(batch.sparkSession.read.parquet(state)).write.mode("overwrite").parquet(out)

    drain(stream, checkpoint, each)
