"""Places and zones over events: users stand in for cameras, users' days for outings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.geo import haversine_km
from mergeloom.functions.session import table
from mergeloom.operators import places as P
from mergeloom.operators.similarity import band_join, nearest_by_time


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a place for two of five, a folder, and an offset that is wrong now and then."""
    k = F.get_json_object("props", "$.k").cast("long")
    has = F.col("event_id") % 5 < 2
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.month("ts").cast("long").alias("month"), (F.col("user_id") % 7).cast("string").alias("folder"),
        F.when(has, F.col("user_id") % 60 + k / 400.0).alias("lat"), F.when(has, F.col("user_id") * 7 % 360 - 180 + k / 400.0).alias("lon"),
        ((F.col("user_id") * 7 % 360 - 180).cast("double") / 15).cast("long").alias("zone"), k.alias("k"),
    )


_ROWS = """
e AS (SELECT event_id, user_id, ts::DATE AS day, floor(epoch(ts))::BIGINT AS t, month(ts)::BIGINT AS month, (user_id % 7)::VARCHAR AS folder, (props->>'$.k')::BIGINT AS k,
  CASE WHEN event_id % 5 < 2 THEN user_id % 60 + (props->>'$.k')::BIGINT / 400.0::DOUBLE END AS lat, CASE WHEN event_id % 5 < 2 THEN user_id * 7 % 360 - 180 + (props->>'$.k')::BIGINT / 400.0::DOUBLE END AS lon,
  trunc((user_id * 7 % 360 - 180)::DOUBLE / 15)::BIGINT AS zone FROM events)
"""


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event without a place, with the offset of the same user's event with one that is nearest in time, however far."""
    own = _rows(spark, sf_dir)
    got = nearest_by_time(own.where("lat is null").select("event_id", "user_id", "t"), own.where("lat is not null").select("user_id", "t", "zone"), "t", ["zone"], ["user_id"])
    return got.select("event_id", F.col("a_zone").alias("zone"), "gap")


def travel_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a place, placed by the user's nearest fix if that is at most an hour away, with the radius travelled since."""
    own = _rows(spark, sf_dir)
    fixes = own.where("lat is not null").select("user_id", "t", "event_id").withColumnRenamed("event_id", "fix")
    got = nearest_by_time(own.where("lat is null").select("event_id", "user_id", "t"), fixes, "t", ["fix"], ["user_id"]).where("gap <= 3600")
    return got.select("event_id", F.col("a_fix").alias("fix"), "gap", F.round(F.col("gap") / 3600 * 100, 6).alias("radius_km"))


def nearest_in_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a place, with the fix of their own day that is nearest by clock, at most three hours off."""
    own = _rows(spark, sf_dir)
    got = P.earlier_in_day(own.where("lat is null").select("event_id", "user_id", "day", "t"), own.where("lat is not null"), "event_id", ["user_id", "day"], 10800).where("gap is not null")
    return got.select("event_id", F.round("a_lat", 6).alias("lat"), F.round("a_lon", 6).alias("lon"), "gap")


def stationary_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days on which no two fixes are more than 25 km apart: what their other events may be placed by."""
    fixes = _rows(spark, sf_dir).where("lat is not null")
    wide = P.diameters(fixes, ["user_id", "day"]).where("diameter_km <= 25")
    span = fixes.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("fixes"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    own = _rows(spark, sf_dir).where("lat is null").join(wide.join(span, ["user_id", "day"]), ["user_id", "day"])
    off = F.greatest(F.col("t0") - F.col("t"), F.col("t") - F.col("t1"), F.lit(0))
    placed = F.when((F.col("fixes") == 1) & (off > 3 * 3600), "too far").when(off > 6 * 3600, "too far").when(off == 0, "inside").otherwise("near")
    return own.select("event_id", "user_id", F.round("diameter_km", 6).alias("diameter_km"), placed.alias("placed"))


def day_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and radius of users' days whose fixes are within 25 km of it."""
    got = P.centres(_rows(spark, sf_dir).where("lat is not null"), ["user_id", "day"], 25.0)
    return got.select("user_id", F.col("day").cast("string").alias("day"), *[F.round(c, 6).alias(c) for c in ("c_lat", "c_lon")], "fixes")


def folder_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of folders (a user's month) with three fixes or more within 50 km."""
    got = P.centres(_rows(spark, sf_dir).where("lat is not null"), ["user_id", "month"], 50.0, 3)
    return got.select("user_id", "month", *[F.round(c, 6).alias(c) for c in ("c_lat", "c_lon")], "fixes")


RULES = [(1, "2024-01-05", "2024-01-20", None, "winter house"), (2, "2024-01-10", "2024-01-12", None, "conference"), (3, "2024-01-01", "2024-01-31", "3", "studio"), (4, "2024-01-11", "2024-01-11", "3", "fair")]


def place_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the most specific rule that covers their day and folder."""
    rules = spark.createDataFrame(RULES, "rule_id long, day_from string, day_to string, folder string, place string").withColumn("day_from", F.to_date("day_from")).withColumn("day_to", F.to_date("day_to"))
    return P.first_rule(_rows(spark, sf_dir).select("event_id", "day", "folder"), rules, "event_id")


def derived_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of wall clocks from instants where they are close to a quarter of an hour."""
    own = _rows(spark, sf_dir).withColumn("wall", F.col("t") + F.col("zone") * 3600 + F.when(F.col("k") % 4 == 0, F.lit(500)).otherwise(F.col("k") - 50))
    return own.select("event_id", P.rounded_offset(F.col("wall"), F.col("t")).alias("offset"))


def zone_neighbour_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days without an offset, with that of the nearest day at most two away."""
    own = _rows(spark, sf_dir)
    known = own.where("event_id % 9 = 0").groupBy("user_id", "day").agg((F.min("zone") * 3600).alias("offset"))
    days = own.select("user_id", "day").distinct().join(known, ["user_id", "day"], "left_anti")
    got = P.nearest_day(days, known, "user_id")
    return got.select("user_id", F.col("day").cast("string").alias("day"), "offset", F.col("from_day").cast("string").alias("from_day"))


def zone_from_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed events without a zone, with that of the nearest place whose zone is known, under 300 km."""
    own = _rows(spark, sf_dir).where("lat is not null")
    seen = own.where("event_id % 20 = 0").select((F.col("zone") * 3600).alias("offset"), "month", "lat", "lon")
    got = P.nearest_observation(own.where("event_id % 20 <> 0").select("event_id", "lat", "lon", "month"), seen, "event_id")
    return got.select("event_id", "offset", F.round("km", 6).alias("km"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("place"), (n * 2.3 + 1).alias("lat"), (n * 49 % 360 - 180 + 0.2).cast("double").alias("lon"), (1000 - n).cast("long").alias("population"))


_PLACES = "pl AS (SELECT n_name AS place, n_nationkey * 2.3::DOUBLE + 1 AS lat, (n_nationkey * 49 % 360 - 180)::DOUBLE + 0.2::DOUBLE AS lon, 1000 - n_nationkey AS population FROM nation)"


def grid_nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix with the nearest place of the cells around it, and how it would be labelled."""
    own = _rows(spark, sf_dir).where("lat is not null").select("event_id", "lat", "lon")
    got = P.nearest_place(own, _places(spark, sf_dir), "event_id", 5.0)
    named = F.when(F.col("km") <= 15, F.col("place")).when(F.col("km") <= 60, F.concat(F.lit("near "), F.col("place"))).when(F.col("place").isNotNull(), "far")
    return got.where("place is not null").select("event_id", "place", F.round("km", 6).alias("km"), named.alias("label"))


def place_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as places: names near them, coordinates away from them."""
    own = _places(spark, sf_dir)
    moved = own.withColumn("km", (F.length("place") * 7 + F.col("population") % 50).cast("double"))
    return moved.select("place", P.label(F.col("place"), F.col("km"), F.col("lat"), F.col("lon")).alias("label"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("event_id") % 97 == 0, 3600 * 3).otherwise(0)
    return _rows(spark, sf_dir).where("lat is not null").select("event_id", "user_id", "t", "lat", "lon", "month", "day", (F.col("zone") * 3600 + wrong).alias("offset"))


_RESOLVED = "z AS (SELECT event_id, user_id, t, lat, lon, month, day, zone * 3600 + CASE WHEN event_id % 97 = 0 THEN 10800 ELSE 0 END AS off FROM e WHERE lat IS NOT NULL)"


def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at most six hours and 50 km apart whose zones differ, and whom to blame: the one fewer others agree with, or both."""
    own = _resolved(spark, sf_dir)
    pairs = P.zone_conflicts(own, "event_id", 21600)
    support = own.groupBy("user_id", "offset").agg(F.count(F.lit(1)).alias("n"))
    with_n = own.select("event_id", "user_id", "offset").join(support, ["user_id", "offset"]).select("event_id", "n")
    both = pairs.join(with_n.select(F.col("event_id").alias("a"), F.col("n").alias("na")), "a").join(with_n.select(F.col("event_id").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", "offset_a", "offset_b", F.round("km", 6).alias("km"), F.when(F.col("na") < F.col("nb"), "a").when(F.col("na") > F.col("nb"), "b").otherwise("both").alias("blamed"))


def audit_place_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose zone isn't the one that all others around them in that month have."""
    return P.place_record(_resolved(spark, sf_dir), "event_id")


def audit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding per event over both audits, by rule number, grouped by the correction it asks for."""
    own = _resolved(spark, sf_dir)
    one = P.zone_conflicts(own, "event_id", 21600).select(F.col("a").alias("event_id"), F.col("offset_b").alias("expected"), F.lit(1).alias("rule_no"))
    three = P.place_record(own, "event_id").select("event_id", "expected", F.lit(3).alias("rule_no"))
    first = one.unionByName(three).groupBy("event_id").agg(F.min(F.struct("rule_no", "expected")).alias("f"))
    return first.join(own, "event_id").groupBy("offset", F.col("f.expected").alias("expected"), F.col("f.rule_no").cast("long").alias("rule_no")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def video_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a type's events at most three seconds and 15 in value apart: recordings that may be one."""
    own = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    got = band_join(own, own, "us", 3_000_000, ["event_type"])
    return got.where((F.col("event_id") < F.col("event_id_r")) & (F.abs(F.col("value") - F.col("value_r")) <= 15)).select(F.col("event_id").alias("a"), F.col("event_id_r").alias("b"), (F.col("us_r") - F.col("us")).alias("gap"))


def greedy_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of a user's fixes, opened one after the other."""
    own = _rows(spark, sf_dir).where("lat is not null").select("event_id", "user_id", "lat", "lon")
    return P.greedy_areas(own, "event_id", "user_id", 15.0).groupBy("user_id", "area").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def place_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another travel limit would change: events gained, lost or moved by more than 0.05 km."""
    own = _rows(spark, sf_dir)
    fixes = own.where("lat is not null").select("user_id", "t", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    got = nearest_by_time(own.where("lat is null").select("event_id", "user_id", "t"), fixes, "t", ["f_lat", "f_lon"], ["user_id"])
    old = got.where("gap <= 3600").select("event_id", F.col("a_f_lat").alias("lat1"), F.col("a_f_lon").alias("lon1"))
    new = got.where("gap <= 7200 and event_id % 10 <> 0").select("event_id", F.col("a_f_lat").alias("lat2"), (F.col("a_f_lon") + F.when(F.col("event_id") % 3 == 0, 0.01).otherwise(0.0)).alias("lon2"))
    both = old.join(new, "event_id", "full")
    change = F.when(F.col("lat1").isNull(), "gained").when(F.col("lat2").isNull(), "lost").when(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) > 0.05, "moved")
    return both.select(change.alias("change"), "event_id").where("change is not null").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


_NEAREST = """
n AS (SELECT e.event_id, a.t AS at, a.zone, a.event_id AS fix, a.lat AS f_lat, a.lon AS f_lon, abs(e.t - a.t) AS gap,
  row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - a.t), a.t, {tie}) AS k FROM e JOIN e a ON a.user_id = e.user_id AND a.lat IS NOT NULL WHERE e.lat IS NULL)
"""

QUERIES = {
    f.__name__: f
    for f in (
        asof_nearest, travel_bound, nearest_in_day, stationary_day, day_centre, folder_centre, place_rules, derived_offset, zone_neighbour_day, zone_from_place, grid_nearest_place, place_labels, audit_pairs, audit_place_record,
        audit_first, video_band_join, greedy_areas, place_diff,
    )
}
_DAYS = f"d AS (SELECT a.user_id, a.day, max({_km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS diameter_km FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL GROUP BY ALL)"


def _centres(by: str, limit: int, least: int) -> str:
    return f"""
WITH {_ROWS}, f AS (SELECT * FROM e WHERE lat IS NOT NULL),
x AS (SELECT {by}, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z, count(*) AS fixes FROM f GROUP BY {by}),
c AS (SELECT {by}, degrees(atan2(z, sqrt(x * x + y * y))) AS c_lat, degrees(atan2(y, x)) AS c_lon, fixes FROM x),
r AS (SELECT {by}, max({_km('f.lat', 'f.lon', 'c.c_lat', 'c.c_lon')}) AS radius FROM f JOIN c USING ({by}) GROUP BY {by})
SELECT {by}, round(c_lat, 6) AS c_lat, round(c_lon, 6) AS c_lon, fixes::BIGINT AS fixes FROM c JOIN r USING ({by}) WHERE fixes >= {least} AND radius <= {limit}
"""


_PAIRS = f"pr AS (SELECT a.event_id AS a, b.event_id AS b, a.off AS offset_a, b.off AS offset_b, {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km, a.user_id AS ua, b.user_id AS ub FROM z a JOIN z b ON a.event_id < b.event_id AND abs(a.t - b.t) <= 21600 AND a.off <> b.off WHERE {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 50)"
_RECORD = f"""q AS (SELECT a.event_id, a.off, min(b.off) AS expected, max(b.off) AS most, count(*) AS n FROM z a JOIN z b ON a.event_id <> b.event_id AND a.month = b.month
  AND abs(floor(a.lat / 0.5) - floor(b.lat / 0.5)) <= 1 AND abs(floor(a.lon / 0.5) - floor(b.lon / 0.5)) <= 1 WHERE {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 50 GROUP BY a.event_id, a.off HAVING min(b.off) = max(b.off) AND count(*) >= 3 AND min(b.off) <> a.off)"""
_R = "r(rule_id, f, t, folder, place) AS (VALUES (1, DATE '2024-01-05', DATE '2024-01-20', NULL, 'winter house'), (2, DATE '2024-01-10', DATE '2024-01-12', NULL, 'conference'), (3, DATE '2024-01-01', DATE '2024-01-31', '3', 'studio'), (4, DATE '2024-01-11', DATE '2024-01-11', '3', 'fair'))"
SQL = {
    "asof_nearest": f"WITH {_ROWS}, {_NEAREST.format(tie='a.zone')} SELECT event_id, zone, gap FROM n WHERE k = 1",
    "travel_bound": f"WITH {_ROWS}, {_NEAREST.format(tie='a.event_id')} SELECT event_id, fix, gap, round(gap / 3600 * 100, 6) AS radius_km FROM n WHERE k = 1 AND gap <= 3600",
    "nearest_in_day": f"""
WITH {_ROWS}, n AS (SELECT e.event_id, a.lat, a.lon, abs(e.t - a.t) AS gap, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - a.t), a.t, a.lat, a.lon) AS k FROM e JOIN e a ON a.user_id = e.user_id AND a.day = e.day AND a.lat IS NOT NULL WHERE e.lat IS NULL AND abs(e.t - a.t) <= 10800)
SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, gap FROM n WHERE k = 1
""",
    "stationary_day": f"""
WITH {_ROWS}, {_DAYS}, s AS (SELECT user_id, day, count(*) AS fixes, min(t) AS t0, max(t) AS t1 FROM e WHERE lat IS NOT NULL GROUP BY ALL),
o AS (SELECT e.event_id, e.user_id, d.diameter_km, s.fixes, greatest(t0 - t, t - t1, 0) AS off FROM e JOIN d USING (user_id, day) JOIN s USING (user_id, day) WHERE e.lat IS NULL AND diameter_km <= 25)
SELECT event_id, user_id, round(diameter_km, 6) AS diameter_km, CASE WHEN fixes = 1 AND off > 10800 THEN 'too far' WHEN off > 21600 THEN 'too far' WHEN off = 0 THEN 'inside' ELSE 'near' END AS placed FROM o
""",
    "day_centre": _centres("user_id, day", 25, 1).replace("SELECT user_id, day, round", "SELECT user_id, day::VARCHAR AS day, round"),
    "folder_centre": _centres("user_id, month", 50, 3),
    "place_rules": f"""
WITH {_ROWS}, {_R}, m AS (SELECT event_id, rule_id, r.place, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN r.folder IS NULL THEN 1 ELSE 0 END, r.t - r.f, rule_id) AS k FROM e JOIN r ON e.day BETWEEN r.f AND r.t AND (r.folder IS NULL OR r.folder = e.folder))
SELECT event_id, rule_id::BIGINT AS rule_id, place FROM m WHERE k = 1
""",
    "derived_offset": f"""
WITH {_ROWS}, d AS (SELECT event_id, (zone * 3600 + CASE WHEN k % 4 = 0 THEN 500 ELSE k - 50 END)::DOUBLE AS d FROM e), q AS (SELECT event_id, d, round(d / 900) * 900 AS q FROM d)
SELECT event_id, CASE WHEN abs(d - q) <= 120 AND q BETWEEN -43200 AND 50400 THEN q::BIGINT END AS "offset" FROM q
""",
    "zone_neighbour_day": f"""
WITH {_ROWS}, kn AS (SELECT user_id, day, min(zone) * 3600 AS off FROM e WHERE event_id % 9 = 0 GROUP BY ALL), d AS (SELECT DISTINCT user_id, day FROM e WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.user_id = e.user_id AND kn.day = e.day)),
m AS (SELECT d.user_id, d.day, kn.off, kn.day AS from_day, row_number() OVER (PARTITION BY d.user_id, d.day ORDER BY abs(kn.day - d.day), kn.day) AS k FROM d LEFT JOIN kn ON kn.user_id = d.user_id AND abs(kn.day - d.day) <= 2)
SELECT user_id, day::VARCHAR AS day, off::BIGINT AS "offset", from_day::VARCHAR AS from_day FROM m WHERE k = 1
""",
    "zone_from_place": f"""
WITH {_ROWS}, o AS (SELECT DISTINCT zone * 3600 AS off, month, lat, lon FROM e WHERE lat IS NOT NULL AND event_id % 20 = 0), p AS (SELECT event_id, lat, lon, month FROM e WHERE lat IS NOT NULL AND event_id % 20 <> 0),
m AS (SELECT p.event_id, o.off, {_km('p.lat', 'p.lon', 'o.lat', 'o.lon')} + CASE WHEN p.month <> o.month THEN 50.0 ELSE 0.0 END AS km FROM p JOIN o ON true),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, off) AS k FROM m WHERE km < 300)
SELECT p.event_id, k.off::BIGINT AS "offset", round(k.km, 6) AS km FROM p LEFT JOIN k ON k.event_id = p.event_id AND k.k = 1
""",
    "grid_nearest_place": f"""
WITH {_ROWS}, {_PLACES}, m AS (SELECT event_id, place, population, {_km('e.lat', 'e.lon', 'pl.lat', 'pl.lon')} AS km FROM e JOIN pl ON abs(floor(e.lat / 5) - floor(pl.lat / 5)) <= 1
  AND list_contains([0, 1, 71], ((floor(e.lon / 5) - floor(pl.lon / 5))::BIGINT % 72 + 72) % 72) WHERE e.lat IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY km, population DESC, place) AS k FROM m)
SELECT event_id, place, round(km, 6) AS km, CASE WHEN km <= 15 THEN place WHEN km <= 60 THEN 'near ' || place ELSE 'far' END AS label FROM k WHERE k = 1
""",
    "place_labels": f"""
WITH {_PLACES}, m AS (SELECT *, length(place) * 7 + population % 50 AS km FROM pl)
SELECT place, CASE WHEN km <= 15 THEN place WHEN km <= 60 THEN 'near ' || place ELSE printf('%.4f', abs(lat)) || CASE WHEN lat < 0 THEN '°S' ELSE '°N' END || ' ' || printf('%.4f', abs(lon)) || CASE WHEN lon < 0 THEN '°W' ELSE '°E' END END AS label FROM m
""",
    "audit_pairs": f"""
WITH {_ROWS}, {_RESOLVED}, {_PAIRS}, s AS (SELECT user_id, off, count(*) AS n FROM z GROUP BY ALL)
SELECT a, b, offset_a, offset_b, round(km, 6) AS km, CASE WHEN x.n < y.n THEN 'a' WHEN x.n > y.n THEN 'b' ELSE 'both' END AS blamed FROM pr JOIN s x ON x.user_id = ua AND x.off = offset_a JOIN s y ON y.user_id = ub AND y.off = offset_b
""",
    "audit_place_record": f'WITH {_ROWS}, {_RESOLVED}, {_RECORD} SELECT event_id, off AS "offset", expected, n::BIGINT AS n FROM q',
    "audit_first": f"""
WITH {_ROWS}, {_RESOLVED}, {_PAIRS}, {_RECORD}, f AS (SELECT a AS event_id, 1 AS rule_no, offset_b AS expected FROM pr UNION ALL SELECT event_id, 3, expected FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rule_no, expected) AS k FROM f)
SELECT z.off AS "offset", k.expected, k.rule_no::BIGINT AS rule_no, count(*)::BIGINT AS n, min(z.event_id)::BIGINT AS first_id FROM k JOIN z USING (event_id) WHERE k = 1 GROUP BY ALL
""",
    "video_band_join": """
SELECT a.event_id AS a, b.event_id AS b, (epoch_us(b.ts) - epoch_us(a.ts))::BIGINT AS gap FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id
WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3000000 AND abs(a.value - b.value) <= 15
""",
    "place_diff": f"""
WITH {_ROWS}, {_NEAREST.format(tie='a.lat, a.lon')}, o AS (SELECT event_id, f_lat AS lat1, f_lon AS lon1 FROM n WHERE k = 1 AND gap <= 3600),
w AS (SELECT event_id, f_lat AS lat2, f_lon + CASE WHEN event_id % 3 = 0 THEN 0.01 ELSE 0.0 END AS lon2 FROM n WHERE k = 1 AND gap <= 7200 AND event_id % 10 <> 0),
c AS (SELECT event_id, CASE WHEN lat1 IS NULL THEN 'gained' WHEN lat2 IS NULL THEN 'lost' WHEN {_km('lat1', 'lon1', 'lat2', 'lon2')} > 0.05 THEN 'moved' END AS change FROM o FULL JOIN w USING (event_id))
SELECT change, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id FROM c WHERE change IS NOT NULL GROUP BY change
""",
}
