"""Places and zones: nearest in time, nearest in space, day and folder centres, rules, audits.

Every search by distance in time or space is an equi-join on buckets or cells with a residual test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mergeloom.functions.geo import cell, cells, centre, haversine_km


def centres(fixes: DataFrame, by: list[str], limit_km: float, least: int = 1) -> DataFrame:
    """Spherical centre and radius per key, of keys with at least ``least`` fixes, all within ``limit_km`` of it."""
    mid = fixes.groupBy(*by).agg(*centre("lat", "lon"), F.count(F.lit(1)).alias("fixes"))
    radius = fixes.join(mid, by).groupBy(*by).agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).alias("radius_km"))
    return mid.join(radius, by).where((F.col("fixes") >= least) & (F.col("radius_km") <= limit_km))


def diameters(fixes: DataFrame, by: list[str]) -> DataFrame:
    """The farthest two fixes per key. Distinct places of a key are compared, as a key is a person's day."""
    own = fixes.select(*by, "lat", "lon").distinct()
    other = own.select(*by, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return own.join(other, by).groupBy(*by).agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("diameter_km"))


def nearest_place(points: DataFrame, places: DataFrame, key: str, size: float = 1.0) -> DataFrame:
    """Each point with the nearest place of the nine cells around it, if any: columns ``place``, ``km``. Equal distances go to the more populous, then by name.

    ``places``: place, lat, lon, population. Longitudes wrap around the date line."""
    p = places.select("place", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "population", *cell(F.col("lat"), F.col("lon"), size))
    near = points.withColumn("c", F.explode(cells(F.col("lat"), F.col("lon"), size))).withColumn("cy", F.col("c.cy")).withColumn("cx", F.col("c.cx")).drop("c")
    met = near.join(p, ["cy", "cx"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")))
    best = met.groupBy(key).agg(F.min(F.struct(F.col("km"), (-F.col("population")).alias("pop"), F.col("place"))).alias("b"))
    return points.join(best, key, "left").select(*points.columns, F.col("b.place").alias("place"), F.col("b.km").alias("km"))


def label(place: Column, km: Column, lat: Column, lon: Column) -> Column:
    """The place's name up to 15 km, ``near`` it up to 60 km, else the coordinates."""
    return F.when(km <= 15, place).when(km <= 60, F.concat(F.lit("near "), place)).otherwise(F.concat(F.format_string("%.4f", F.abs(lat)), F.when(lat < 0, "°S").otherwise("°N"), F.lit(" "), F.format_string("%.4f", F.abs(lon)), F.when(lon < 0, "°W").otherwise("°E")))


def first_rule(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Each row with the first rule that covers its day and folder: rules for a folder first, then the shortest span, then the least id.

    ``rules`` (rule_id, day_from, day_to, folder, place), a person's few settings, are exploded to days, so the
    join is on the day; a rule's folder may be null, for any."""
    days = rules.withColumn("day", F.explode(F.sequence("day_from", "day_to"))).withColumn("span", F.datediff("day_to", "day_from"))
    met = rows.join(days.withColumnRenamed("folder", "rule_folder"), "day").where(F.col("rule_folder").isNull() | (F.col("rule_folder") == F.col("folder")))
    best = met.groupBy(key).agg(F.min(F.struct(F.col("rule_folder").isNull().cast("int").alias("any"), "span", "rule_id", "place")).alias("b"))
    return best.select(key, F.col("b.rule_id").alias("rule_id"), F.col("b.place").alias("place"))


def rounded_offset(wall: Column, instant: Column) -> Column:
    """Offset of a wall clock from an instant (both in seconds), to a quarter of an hour; null if more than two minutes off one, or impossible."""
    d = wall - instant
    q = F.round(d / 900) * 900
    return F.when((F.abs(d - q) <= 120) & q.between(-12 * 3600, 14 * 3600), q.cast("long"))


def nearest_observation(points: DataFrame, observations: DataFrame, key: str, limit_km: float = 300.0, penalty: float = 50.0, size: float = 3.0) -> DataFrame:
    """Each point with the offset of the nearest observation, where another month counts ``penalty`` km more; null from ``limit_km`` on.

    Cells of ``size`` degrees hold at least the limit in latitude; in longitude as many cells are searched as the limit
    spans at the point's latitude. Ties go to the least offset."""
    n = int(360 / size)
    o = observations.select(F.col("offset").alias("o_offset"), F.col("month").alias("o_month"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), *cell(F.col("lat"), F.col("lon"), size)).distinct()
    reach = F.least(F.lit(n // 2), F.ceil(F.lit(limit_km / 111.0) / F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + size, F.lit(89.9)))), F.lit(1e-3)) / size)).cast("int")
    near = points.withColumn("dx", F.explode(F.sequence(-reach, reach))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    near = near.withColumn("cy", F.floor(F.col("lat") / size) + F.col("dy")).withColumn("cx", F.pmod(F.floor(F.col("lon") / size) + F.col("dx"), F.lit(n)))
    met = near.join(o, ["cy", "cx"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) + F.when(F.col("month") != F.col("o_month"), penalty).otherwise(0.0)).where(F.col("km") < limit_km)
    best = met.groupBy(key).agg(F.min(F.struct("km", "o_offset")).alias("b"))
    return points.join(best, key, "left").select(*points.columns, F.col("b.o_offset").alias("offset"), F.col("b.km").alias("km"))


def nearest_day(days: DataFrame, known: DataFrame, by: str, reach: int = 2) -> DataFrame:
    """Each day (``by``, day) with the offset of the nearest known day at most ``reach`` away; the earlier one wins ties."""
    k = known.select(by, F.col("day").alias("k_day"), "offset")
    near = days.withColumn("k_day", F.explode(F.sequence(F.date_sub("day", reach), F.date_add("day", reach))))
    best = near.join(k, [by, "k_day"]).groupBy(by, "day").agg(F.min(F.struct(F.abs(F.datediff("k_day", "day")).alias("d"), "k_day", "offset")).alias("b"))
    return days.join(best, [by, "day"], "left").select(by, "day", F.col("b.offset").alias("offset"), F.col("b.k_day").alias("from_day"))


def zone_conflicts(rows: DataFrame, key: str, seconds: int = 1800, km: float = 50.0) -> DataFrame:
    """Pairs (a < b) at most half an hour and 50 km apart whose offsets differ. Buckets of time and of latitude are join keys."""
    r = rows.select(F.col(key).alias("b"), F.col("t").alias("t2"), F.col("offset").alias("o2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.floor(F.col("t") / seconds).alias("bucket"), F.floor("lat").alias("band"))
    probe = rows.select(F.col(key).alias("a"), "t", "offset", "lat", "lon", F.explode(F.array(*[F.floor(F.col("t") / seconds) + d for d in (-1, 0, 1)])).alias("bucket")).withColumn("band", F.explode(F.array(*[F.floor("lat") + d for d in (-1, 0, 1)])))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return probe.join(r, ["bucket", "band"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("t") - F.col("t2")) <= seconds) & (F.col("offset") != F.col("o2")) & (far <= km)).select("a", "b", F.col("offset").alias("offset_a"), F.col("o2").alias("offset_b"), far.alias("km"))


def place_record(rows: DataFrame, key: str, size: float = 0.5, km: float = 50.0, least: int = 3) -> DataFrame:
    """Rows whose offset differs from the one that all others, three or more, within 50 km and the same month have."""
    r = rows.select(F.col(key).alias("other"), F.col("offset").alias("o2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "month", *cell(F.col("lat"), F.col("lon"), size, wrap=False))
    probe = rows.withColumn("c", F.explode(cells(F.col("lat"), F.col("lon"), size, wrap=False))).withColumn("cy", F.col("c.cy")).withColumn("cx", F.col("c.cx"))
    met = probe.join(r, ["cy", "cx", "month"]).where((F.col(key) != F.col("other")) & (haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= km))
    seen = met.groupBy(key, "offset").agg(F.min("o2").alias("expected"), F.max("o2").alias("most"), F.count(F.lit(1)).alias("n"))
    return seen.where((F.col("expected") == F.col("most")) & (F.col("n") >= least) & (F.col("expected") != F.col("offset"))).select(key, "offset", "expected", "n")


def greedy_areas(points: DataFrame, key: str, by: str, km: float = 50.0) -> DataFrame:
    """Points, in order of ``key``, join the first area whose running mean is within ``km``, else open one. Sequential within each ``by``."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        mids: list[list[float]] = []
        area = []
        for lat, lon in zip(part["lat"], part["lon"], strict=True):
            at = None
            for i, (a, b, n) in enumerate(mids):
                x, y = np.radians(lat), np.radians(a)
                s = np.sin((y - x) / 2) ** 2 + np.cos(x) * np.cos(y) * np.sin(np.radians(b - lon) / 2) ** 2
                if 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(s))) <= km:
                    mids[i] = [a + (lat - a) / (n + 1), b + (lon - b) / (n + 1), n + 1]
                    at = i
                    break
            if at is None:
                mids.append([lat, lon, 1])
                at = len(mids) - 1
            area.append(at)
        return pd.DataFrame({by: part[by], key: part[key], "area": area})

    kinds = dict(points.dtypes)
    return points.select(by, key, "lat", "lon").groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, area long")


def earlier_in_day(rows: DataFrame, anchors: DataFrame, key: str, by: list[str], limit: int) -> DataFrame:
    """Each row with the anchor of its own day that is nearest by clock, at most ``limit`` seconds off; the earlier one wins ties."""
    met = rows.join(anchors.select(*by, F.col("t").alias("t2"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), by)
    best = met.where(F.abs(F.col("t") - F.col("t2")) <= limit).groupBy(key).agg(F.min(F.struct(F.abs(F.col("t") - F.col("t2")).alias("gap"), "t2", "a_lat", "a_lon")).alias("b"))
    return rows.join(best, key, "left").select(*rows.columns, F.col("b.a_lat").alias("a_lat"), F.col("b.a_lon").alias("a_lon"), F.col("b.gap").alias("gap"))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
