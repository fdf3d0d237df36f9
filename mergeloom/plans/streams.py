"""Streams over the events table, drained into tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import cut, table
from mergeloom.streaming.claims import EVENTS, drain, ingest, sessions


def _folder(spark: SparkSession) -> str:
    cut(spark.range(1).toDF("x"))  # names the shared folder where none is set
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent, name = sf_dir, "events.parquet"
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name if not _is_folder(spark, f"{parent}/{name}") else "*.parquet").parquet(f"{parent}/{name}" if _is_folder(spark, f"{parent}/{name}") else parent)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type after an ingest that takes each event once."""
    out = _folder(spark)
    drain(ingest(_stream(spark, sf_dir), "event_id", "ts"), f"{out}/cp", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events per type with at most a minute in between, as the stream alone finds them.

    A session comes out when the watermark has passed it. A marker a day after the last event, which arrives when all events have,
    moves the watermark past the last sessions; its own never closes."""
    out = _folder(spark)
    marker = f"{out}/marker"
    schema = table(spark, sf_dir, "events").limit(0).withColumn("ts", F.col("ts").cast("timestamp"))
    schema.write.parquet(marker)
    events = _stream(spark, sf_dir).unionByName(spark.readStream.schema(schema.schema).parquet(marker))

    def run() -> None:
        drain(sessions(events, ["event_type"], "ts"), f"{out}/cp", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))

    run()
    last = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts")).where("ts is not null")
    late = last.select((F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("event_type"))
    schema.unionByName(late, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(marker)
    run()
    return spark.read.parquet(f"{out}/rows").where("event_type <> ''").groupBy("event_type").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (stream_ingest, stream_sessions)}
SQL = {
    "stream_ingest": "SELECT event_type, count(*)::BIGINT AS n, min(event_id) AS first_id FROM events GROUP BY event_type",
    "stream_sessions": """
WITH g AS (SELECT event_type, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 60 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
i AS (SELECT event_type, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), s AS (SELECT event_type, k, count(*) AS n FROM i GROUP BY event_type, k)
SELECT event_type, count(*)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM s GROUP BY event_type
""",
}
