"""Queries on what is left to fill in: sources of an event's time, place and zone are stand-ins by its number, user and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import table
from mergeloom.operators.fillin import filters, flags

TIMES = ("exif", "mtime (unreliable)", "filename, date only", "you entered the day", "none")
PLACES = ("measured", "same day centre", "nearest fix 12 min", "same folder centre", "you entered it", "you confirmed it")
ZONES = ("place", "you picked it", "neighbour")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(names: tuple[str, ...], n: Column, missing: int) -> Column:
        return F.get(F.array(*[F.lit(x) for x in names]), (n % missing).cast("int"))

    e = table(spark, sf_dir, "events")
    return e.select("event_id", pick(TIMES, F.col("event_id"), 6).alias("t"), pick(PLACES, F.col("user_id") + F.col("event_id"), 7).alias("p"), pick(ZONES, F.col("user_id"), 3).alias("z"))


_ROWS = f"""
e AS (SELECT event_id, {list(TIMES)}[event_id % 6 + 1] AS t, {list(PLACES)}[(user_id + event_id) % 7 + 1] AS p, {list(ZONES)}[user_id % 3 + 1] AS z FROM events),
f AS (SELECT event_id, t IS NULL OR t = 'none' OR t LIKE 'mtime%' OR t LIKE '%date only%' AS needs_date, p IS NULL OR p = 'none' AS needs_place,
  coalesce(p LIKE 'same day%' OR p LIKE 'nearest fix%' OR p LIKE 'same folder%', false) AS worked_out, coalesce(t LIKE 'you entered%', false) OR coalesce(p IN ('you entered it', 'you confirmed it'), false) AS entered,
  z NOT LIKE 'you %' AS audited FROM e)
"""


def fill_in_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with what it lacks, what was worked out or entered, and whether its zone is audited."""
    own = _rows(spark, sf_dir)
    return own.select("event_id", *[c.alias(k) for k, c in flags(F.col("t"), F.col("p"), F.col("z")).items()])


def fill_in_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each of the six filters shows."""
    own = _rows(spark, sf_dir)
    return own.agg(*[F.count_if(c).alias(k) for k, c in filters(flags(F.col("t"), F.col("p"), F.col("z"))).items()])


def place_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the source of their place, none included."""
    return _rows(spark, sf_dir).groupBy(F.coalesce("p", F.lit("none")).alias("place_source")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (fill_in_flags, fill_in_filters, place_sources)}
SQL = {
    "fill_in_flags": f"WITH {_ROWS} SELECT * FROM f",
    "fill_in_filters": f"""
WITH {_ROWS} SELECT count_if(needs_date OR needs_place OR worked_out)::BIGINT AS attention, count_if(needs_date OR needs_place)::BIGINT AS either, count_if(needs_date)::BIGINT AS date,
count_if(needs_place)::BIGINT AS place, count_if(worked_out)::BIGINT AS worked_out, count_if(entered)::BIGINT AS entered FROM f
""",
    "place_sources": f"WITH {_ROWS} SELECT coalesce(p, 'none') AS place_source, count(*)::BIGINT AS n FROM e GROUP BY 1",
}
