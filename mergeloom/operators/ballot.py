"""Ballots: candidate offsets for a day without one, scored by independent signals and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Offsets that some place keeps, in hours.
OFFSETS = [-12, -11, -10, -9.5, -9, -8, -7, -6, -5, -4, -3.5, -3, -2, -1, 0, 1, 2, 3, 3.5, 4, 4.5, 5, 5.5, 5.75, 6, 6.5, 7, 8, 8.75, 9, 9.5, 10, 10.5, 11, 12, 12.75, 13, 14]
LEAST_SCORE = 0.45
LEAST_MARGIN = 0.08


def candidates(days: DataFrame) -> DataFrame:
    return days.withColumn("cand", F.explode(F.array(*[F.lit(float(x)) for x in OFFSETS])))


def neighbour(cand: Column, offset: Column, gap_days: Column) -> Column:
    """Nearness to a neighbouring day's offset, toward a half as the gap grows; no opinion after 14 days."""
    trust = F.greatest(F.lit(0.15), 1 - gap_days / 14)
    return F.when(offset.isNotNull() & (gap_days <= 14), F.greatest(F.lit(0.0), 1 - F.abs(cand - offset) / 12) * trust + (1 - trust) * 0.5)


def daylight(cand: Column, centre_hour: Column, lon: Column, n: Column) -> Column:
    """Whether the brightest hours would be around noon: flat for four hours, then falling to nothing at twelve; needs four readings and a longitude."""
    implied = centre_hour - 12 + lon / 15
    off = F.abs(cand - implied)
    return F.when((n >= 4) & lon.isNotNull(), F.when(off <= 4, 1 - off / 4 * 0.05).when(off >= 12, 0.0).otherwise(0.95 * (12 - off) / 8))


def habit(cand: Column, usual: Column, samples: Column) -> Column:
    """What the device mostly kept around that time; needs three samples."""
    return F.when(samples >= 3, F.when(F.abs(cand - usual) < 1 / 3600, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(cand - usual) / 12)))


def epoch_name(cand: Column, implied: Column) -> Column:
    """Whether a file name that holds an instant implies the offset, to a quarter of an hour."""
    return F.when(implied.isNotNull(), F.when(F.abs(cand - implied) < 0.25, 1.0).otherwise(0.0))


def bright_hour(rows: DataFrame, by: list[str], value: str, hour: str) -> DataFrame:
    """Mean hour weighted by how far a reading is above the day's brightest less six; with the number of readings."""
    top = rows.groupBy(*by).agg(F.max(value).alias("_top"))
    w = F.greatest(F.lit(0.0), F.col(value) - (F.col("_top") - 6))
    return rows.join(top, by).groupBy(*by).agg((F.sum(w * F.col(hour)) / F.sum(w)).alias("centre"), F.count(F.lit(1)).alias("readings"))


def rank(scored: DataFrame, by: list[str], signals: list[str], top: int = 3) -> DataFrame:
    """The best candidates per key by the mean of the signals that have an opinion; ``clear`` unless the best is weak or hardly ahead."""
    given = F.filter(F.array(*signals), lambda x: x.isNotNull())
    score = F.when(F.size(given) > 0, F.round(F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given), 9)).otherwise(0.0)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "cand")
    own = scored.withColumn("score", score).withColumn("place", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    best = F.max(F.when(F.col("place") == 1, (F.col("score") >= LEAST_SCORE) & (F.round(F.col("score") - F.col("_next"), 9) >= LEAST_MARGIN))).over(Window.partitionBy(*by))
    return own.withColumn("clear", best).where(F.col("place") <= top).drop("_next")


def majority(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value per key, the least of equals, with its count and all counts."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("samples")).select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("votes"), "samples")
