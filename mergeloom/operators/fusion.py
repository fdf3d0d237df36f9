"""Fusion of competing claims into one answer per field, with what lost beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How far a source is trusted for times; lower is better.
TIME_RANK = {"manual": -1, "exif": 0, "quicktime": 1, "xmp": 2, "google_json": 3, "filename": 4, "fs": 9}
GROUP_SECONDS = 60
ZONE_HOURS = 14
CONFLICT_HOURS = 24
#: Sources that a batch job stamps, sources of offsets by trust, what a stamp or a wall clock without an offset loses, and the start of 1990.
STAMPED = ("exif", "quicktime", "google_json")
OFFSET_RANK = {"exif": 0, "quicktime": 1, "xmp": 2}
BATCH_PENALTY = 0.25
LOCAL_PENALTY = 0.9
EARLIEST = 631_152_000


def ranked(source: Column, ranks: dict[str, int], other: int = 99) -> Column:
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def batch_minutes(claims: DataFrame, instant: str, owner: str, least: int) -> DataFrame:
    """Minutes that at least ``least`` different owners claim: stamps of a batch job, not of a moment."""
    minute = F.date_trunc("minute", F.col(instant)).cast("timestamp_ntz").alias("minute")
    return claims.groupBy(minute).agg(F.count_distinct(owner).alias("owners")).where(F.col("owners") >= least)


def islands(rows: DataFrame, by: list[str], time: str, gap: int, name: str) -> DataFrame:
    """Adds the number of the run that a row is in: a new one starts when the time since the row before exceeds ``gap``. ``time`` is in seconds."""
    w = Window.partitionBy(*by).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def time_pool(claims: DataFrame, owner: str, field: str, time: str, source: str, confidence: str, least: int) -> DataFrame:
    """The claims that ``resolve_time`` may choose from: owner, time, source, confidence and whether the time is ``unanchored``.

    claims: owner, field, time, source, confidence; time is in seconds: the instant of a ``datetime_utc``, the wall clock of a ``datetime_local``, the
    shift of a ``utc_offset``. Instants of file systems (``fs``) count only where the owner has nothing else, and beside manual instants no others do.
    Wall clocks of sources without an instant in the pool are anchored with the owner's best offset, or taken as they are at 0.9 of their
    confidence. Times that are null or before 1990 say nothing. Claims of cameras and sidecars in minutes in which ``least`` or more owners have
    such instants are lowered to a quarter."""
    utc, local = F.col(field) == "datetime_utc", F.col(field) == "datetime_local"
    source_name = F.coalesce(F.col(source), F.lit(""))
    instant = utc & (source_name != "fs")
    order = F.struct(ranked(F.col(source), OFFSET_RANK).alias("r"), (-F.col(confidence)).alias("c"), F.col(time).alias("t"))
    known = claims.groupBy(owner).agg(
        F.max(instant & (source_name == "manual")).alias("_manual"), F.collect_set(F.when(instant, source_name)).alias("_sources"), F.max(instant | (local & F.col(time).isNotNull())).alias("_some"),
        F.min(F.when((F.col(field) == "utc_offset") & F.col(source).isin(list(OFFSET_RANK)) & F.col(time).isNotNull(), order)).getField("t").alias("_shift"),
    )
    own = claims.join(known, owner)
    have = F.when(F.col("_manual"), F.array(F.lit("manual"))).otherwise(F.col("_sources"))
    taken = F.when(utc, F.when(F.col("_some"), instant & (~F.col("_manual") | (source_name == "manual"))).otherwise(True)).otherwise(local & ~F.array_contains(have, source_name))
    anchored = F.when(local, F.col(time) - F.coalesce("_shift", F.lit(0))).otherwise(F.col(time))
    unanchored = local & F.col("_shift").isNull()
    pool = own.where(taken).select(owner, anchored.alias(time), source, F.when(unanchored, F.col(confidence) * LOCAL_PENALTY).otherwise(F.col(confidence)).alias(confidence), unanchored.alias("unanchored"))
    minute = F.floor(F.col(time) / 60).alias("_minute")
    batch = claims.where(utc & F.col(source).isin(list(STAMPED))).groupBy(minute).agg(F.count_distinct(owner).alias("_owners")).where(F.col("_owners") >= least).select("_minute", F.lit(True).alias("_batch"))
    met = pool.where(F.col(time) >= EARLIEST).withColumn("_minute", minute).join(batch, "_minute", "left")
    lowered = F.when(F.col("_batch") & F.col(source).isin(list(STAMPED)), F.col(confidence) * BATCH_PENALTY).otherwise(F.col(confidence))
    return met.select(owner, time, source, lowered.alias(confidence), "unanchored")


def resolve_time(claims: DataFrame, owner: str, time: str, source: str, confidence: str) -> DataFrame:
    """One time per owner from claims (owner, time in seconds, source, confidence).

    Claims within a minute of the one before agree. If all agree that's it. If groups are whole hours apart (to 90 s, at most 14 h), it is
    one moment in several zones: the first group with a camera's claim wins (``tz_resolved``). Otherwise the earliest wins, as
    ``soft_conflict``, or ``date_conflict`` beyond a day. The best claim of the group is the most confident, then
    the most trusted source, then the earliest. ``competing`` counts the claims of the other groups."""
    own = islands(claims, [owner], time, GROUP_SECONDS, "island")
    rank = ranked(F.col(source), TIME_RANK)
    best = F.min(F.struct((-F.col(confidence)).alias("c"), rank.alias("r"), F.col(time).alias("t"), F.col(source).alias("s"))).alias("best")
    camera = F.max(F.when(F.col(source).isin("exif", "quicktime"), 1).otherwise(0)).alias("camera")
    groups = own.groupBy(owner, "island").agg(best, camera, F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
    whole = groups.groupBy(owner).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("claims"), F.min("first").alias("t0"), F.max(F.struct("island", "first")).alias("tail"),
        F.min(F.struct((1 - F.col("camera")).alias("k"), "island", "best", "n")).alias("by_camera"), F.min(F.struct("island", "best", "n")).alias("earliest"),
    )
    spread = F.col("tail.first") - F.col("t0")
    off = F.abs(spread - F.round(spread / 3600) * 3600)
    zone = (spread <= ZONE_HOURS * 3600) & (off <= 90)
    note = F.when(F.col("groups") == 1, "agreed").when(zone, "tz_resolved").when(spread > CONFLICT_HOURS * 3600, "date_conflict").otherwise("soft_conflict")
    pick = F.when((F.col("groups") > 1) & zone, F.col("by_camera.best")).otherwise(F.col("earliest.best"))
    n = F.when((F.col("groups") > 1) & zone, F.col("by_camera.n")).otherwise(F.col("earliest.n"))
    return whole.select(owner, pick["t"].alias(time), pick["s"].alias(source), F.bround(-pick["c"], 3).alias(confidence), note.alias("note"), "groups", (F.col("claims") - n).alias("competing"))


def best_claim(claims: DataFrame, by: list[str], ranks: dict[str, int], source: str, confidence: str, value: str) -> DataFrame:
    """The value of the most trusted source per key, then the most confident, then the least; sources without a rank don't count."""
    rank = ranked(F.col(source), ranks)
    best = F.min(F.struct(rank.alias("r"), (-F.col(confidence)).alias("c"), F.col(value).alias("v"), F.col(source).alias("s"))).alias("b")
    return claims.where(F.col(source).isin(list(ranks))).groupBy(*by).agg(best).select(*by, F.col("b.v").alias(value), F.col("b.s").alias(source), (-F.col("b.c")).alias(confidence))
