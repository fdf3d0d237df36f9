"""Claims: batch stamps, agreement in time, places and simple fields. Events stand in for claims, users for items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.geo import haversine_km
from mergeloom.functions.session import table
from mergeloom.operators.fusion import batch_minutes, best_claim, islands, ranked, resolve_time, time_pool

SOURCES = {"click": "exif", "view": "quicktime", "purchase": "google_json", "signup": "filename", "error": "fs"}
GPS_RANK = {"exif": 0, "quicktime": 1, "google_json": 2}
FIELD_RANK = {"exif": 0, "google_json": 1, "filename": 2}


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of an item: a user's day; sources by event type, confidence from the value."""
    source = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("event_type"))
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", day.alias("day"), F.concat_ws("/", "user_id", day.cast("string")).alias("item"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"),
        source.alias("source"), (F.floor(F.col("value") / 50) / 10).alias("confidence"), _k(F.col("props")).alias("k"),
    )


_CLAIMS = """
c AS (SELECT event_id, user_id, ts, ts::DATE AS day, user_id || '/' || ts::DATE::VARCHAR AS item, floor(epoch(ts))::BIGINT AS t,
  CASE event_type WHEN 'click' THEN 'exif' WHEN 'view' THEN 'quicktime' WHEN 'purchase' THEN 'google_json' WHEN 'signup' THEN 'filename' WHEN 'error' THEN 'fs' END AS source,
  floor(value / 50)::DOUBLE / 10 AS confidence, (props->>'$.k')::BIGINT AS k FROM events)
"""


def claims_batch_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that two or more users claim."""
    return batch_minutes(_claims(spark, sf_dir), "ts", "user_id", 2)


def batch_exact_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims left once hours that more than a fourteenth of a day's average claims share are dropped."""
    own = _claims(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    batch = own.groupBy("hour").agg(F.count(F.lit(1)).alias("n")).where("n >= 25").select("hour")
    return own.join(batch, "hour", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("claims"), F.min("event_id").alias("first_id"))


def claim_time_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's claims with at most an hour between one and the next."""
    own = islands(_claims(spark, sf_dir), ["user_id"], "t", 3600, "island")
    return own.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def claim_time_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time per item, with the reason and how many claims lost. Events are instants; there are no wall clocks or offsets among them."""
    own = _claims(spark, sf_dir).withColumn("field", F.lit("datetime_utc"))
    pool = time_pool(own, "item", "field", "t", "source", "confidence", 2)
    return resolve_time(pool, "item", "t", "source", "confidence").withColumn("competing", F.col("competing").cast("long"))


def downgraded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of batch minutes at a quarter of their confidence."""
    own = _claims(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    batch = batch_minutes(own, "ts", "user_id", 2).select("minute", F.lit(True).alias("batch"))
    lowered = F.when(F.col("batch") & F.col("source").isin("exif", "quicktime", "google_json"), F.col("confidence") * 0.25).otherwise(F.col("confidence"))
    return own.join(batch, "minute", "left").groupBy("source").agg(F.round(F.sum(lowered), 6).alias("confidence"), F.count_if(F.col("batch")).alias("batched"))


def competing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, the sources of all claims in order of time, and how many lie more than a minute after the first."""
    own = _claims(spark, sf_dir)
    parts = own.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("t", "event_id", "source"))).alias("c"))
    return parts.select("item", F.array_join(F.transform("c", lambda x: x["source"]), ",").alias("sources"), F.size(F.filter("c", lambda x: x["t"] > F.element_at("c", 1)["t"] + 60)).cast("long").alias("later"))


def simple_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best claim of a simple field per user: by source, confidence, value."""
    return best_claim(_claims(spark, sf_dir), ["user_id"], FIELD_RANK, "source", "confidence", "k")


def gps_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per item: the most trusted fix; how far the others lie, and whether that's a spread, a conflict or a review."""
    own = _claims(spark, sf_dir).where(F.col("source").isin(list(GPS_RANK))).withColumn("lat", F.col("user_id") % 60 + F.col("k") / 500.0).withColumn("lon", F.col("user_id") % 170 + F.col("k") / 400.0)
    rank = ranked(F.col("source"), GPS_RANK)
    first = own.groupBy("item").agg(F.min(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), "event_id", "lat", "lon", "source")).alias("b"))
    far = own.join(first, "item").groupBy("item", "b").agg(F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("b.lat"), F.col("b.lon"))).alias("km"), F.count(F.lit(1)).alias("claims"))
    verdict = F.when(F.col("km") <= 0.1, "agreed").when(F.col("km") < 5, "gps_spread").when(F.col("b.source").isin("exif", "quicktime"), "camera").otherwise("gps_review")
    return far.select("item", F.round("b.lat", 6).alias("lat"), F.round("b.lon", 6).alias("lon"), F.col("b.source").alias("source"), F.round("km", 6).alias("km"), "claims", verdict.alias("verdict"))


def json_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar's JSON as claims: time taken, upload time, a place unless it is null island, a title."""
    ev = table(spark, sf_dir, "events")
    k = _k(F.col("props"))
    taken = F.unix_seconds(F.col("ts").cast("timestamp"))
    payload = F.to_json(F.struct(
        F.struct(taken.cast("string").alias("timestamp")).alias("photoTakenTime"), F.struct((taken + 86400).cast("string").alias("timestamp")).alias("creationTime"),
        F.struct(F.when(k % 3 == 0, F.lit(0.0)).otherwise(k * 0.5).alias("latitude"), F.when(k % 3 == 0, F.lit(0.0)).otherwise(k * 1.0).alias("longitude")).alias("geoDataExif"), F.concat(F.lit("IMG_"), F.col("event_id").cast("string")).alias("title"),
    ))
    shape = "photoTakenTime struct<timestamp: string>, creationTime struct<timestamp: string>, geoDataExif struct<latitude: double, longitude: double>, title string"
    own = ev.select("event_id", F.from_json(payload, shape).alias("j"))
    island = (F.col("j.geoDataExif.latitude") == 0) & (F.col("j.geoDataExif.longitude") == 0)
    claim = lambda f, v, c: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), F.lit(c).alias("confidence"))
    claims = F.array(
        claim("datetime_utc", F.col("j.photoTakenTime.timestamp"), 0.9), claim("upload", F.col("j.creationTime.timestamp"), 0.2), claim("gps", F.when(~island, F.format_string("%.7f,%.7f", "j.geoDataExif.latitude", "j.geoDataExif.longitude")), 0.9), claim("original_filename", F.col("j.title"), 1.0)
    )
    return own.select("event_id", F.explode(F.filter(claims, lambda x: x["value"].isNotNull())).alias("c")).select("event_id", "c.*")


#: Which tag says what, and how far it is trusted.
TAGS = [("DateTimeOriginal", "datetime_local", 0.95), ("CreateDate", "datetime_local", 0.8), ("ModifyDate", "datetime_local", 0.3), ("OffsetTimeOriginal", "utc_offset", 0.9), ("OffsetTime", "utc_offset", 0.7)]


def tag_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as claims by a mapping table; of equal field and value the most confident stays; absent dates say nothing."""
    o = table(spark, sf_dir, "orders")
    date = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    tags = F.create_map(
        F.lit("DateTimeOriginal"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("0000:00:00 00:00:00")).otherwise(date), F.lit("CreateDate"), date, F.lit("ModifyDate"), F.date_format(F.date_add("o_orderdate", 1), "yyyy:MM:dd HH:mm:ss"),
        F.lit("OffsetTimeOriginal"), F.lit("+02:00"), F.lit("OffsetTime"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("+02:00")).otherwise(F.lit("+01:00")),
    )
    known = spark.createDataFrame(TAGS, "tag string, field string, confidence double")
    long = o.select("o_orderkey", F.explode(tags).alias("tag", "value")).where("value not like '0000%'")
    return long.join(F.broadcast(known), "tag").groupBy("o_orderkey", "field", "value").agg(F.max("confidence").alias("confidence"))  # the mapping is a fixed list


QUERIES = {f.__name__: f for f in (claims_batch_minutes, batch_exact_stamps, claim_time_groups, claim_time_choice, downgraded_claims, competing_claims, simple_fields, gps_fusion, json_claims, tag_claims)}
SQL = {
    "claims_batch_minutes": f"WITH {_CLAIMS} SELECT date_trunc('minute', ts) AS minute, count(DISTINCT user_id)::BIGINT AS owners FROM c GROUP BY 1 HAVING count(DISTINCT user_id) >= 2",
    "batch_exact_stamps": f"WITH {_CLAIMS}, b AS (SELECT date_trunc('hour', ts) AS h FROM c GROUP BY 1 HAVING count(*) >= 25) SELECT source, count(*)::BIGINT AS claims, min(event_id)::BIGINT AS first_id FROM c WHERE date_trunc('hour', ts) NOT IN (SELECT h FROM b) GROUP BY source",
    "claim_time_groups": f"""
WITH {_CLAIMS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS fresh FROM c),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, island::BIGINT AS island, count(*)::BIGINT AS n, min(t) AS first, max(t) AS last FROM i GROUP BY user_id, island
""",
    "claim_time_choice": f"""
WITH {_CLAIMS}, f AS (SELECT *, CASE source WHEN 'exif' THEN 0 WHEN 'quicktime' THEN 1 WHEN 'google_json' THEN 3 ELSE 4 END AS r FROM (SELECT c.* REPLACE (CASE WHEN m IS NOT NULL AND source IN ('exif', 'quicktime', 'google_json') THEN confidence * 0.25 ELSE confidence END AS confidence)
FROM c LEFT JOIN (SELECT t // 60 AS m FROM c WHERE source IN ('exif', 'quicktime', 'google_json') GROUP BY 1 HAVING count(DISTINCT item) >= 2) ON m = t // 60
WHERE source <> 'fs' OR item NOT IN (SELECT item FROM c WHERE source <> 'fs'))),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY item ORDER BY t, event_id) > 60 THEN 1 ELSE 0 END AS fresh FROM f),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY item ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT item, island, max(CASE WHEN source IN ('exif', 'quicktime') THEN 1 ELSE 0 END) AS camera, min(t) AS t0, count(*) AS n FROM i GROUP BY item, island),
w AS (SELECT item, count(*) AS groups, sum(n) AS claims, max(t0) - min(t0) AS spread FROM s GROUP BY item),
z AS (SELECT *, groups > 1 AND spread <= 50400 AND abs(spread - round(spread / 3600.0) * 3600) <= 90 AS zone FROM w),
p AS (SELECT s.item, s.island, s.n, z.groups, z.claims, z.spread, z.zone, row_number() OVER (PARTITION BY s.item ORDER BY CASE WHEN z.zone THEN 1 - s.camera ELSE 0 END, s.island) AS k FROM s JOIN z USING (item)),
b AS (SELECT i.item, i.t, i.source, i.confidence, p.groups, p.claims - p.n AS competing, p.spread, p.zone, row_number() OVER (PARTITION BY i.item ORDER BY i.confidence DESC, i.r, i.t, i.source) AS k FROM i JOIN p ON p.item = i.item AND p.island = i.island AND p.k = 1)
SELECT item, t, source, confidence, CASE WHEN groups = 1 THEN 'agreed' WHEN zone THEN 'tz_resolved' WHEN spread > 86400 THEN 'date_conflict' ELSE 'soft_conflict' END AS note, groups::BIGINT AS groups, competing::BIGINT AS competing FROM b WHERE k = 1
""",
    "downgraded_claims": f"""
WITH {_CLAIMS}, b AS (SELECT date_trunc('minute', ts) AS m FROM c GROUP BY 1 HAVING count(DISTINCT user_id) >= 2), j AS (SELECT c.*, date_trunc('minute', ts) IN (SELECT m FROM b) AS batch FROM c)
SELECT source, round(sum(CASE WHEN batch AND source IN ('exif', 'quicktime', 'google_json') THEN confidence * 0.25 ELSE confidence END), 6) AS confidence, count(*) FILTER (batch)::BIGINT AS batched FROM j GROUP BY source
""",
    "competing_claims": f"WITH {_CLAIMS} SELECT item, string_agg(source, ',' ORDER BY t, event_id) AS sources, (SELECT count(*) FROM c x WHERE x.item = c.item AND x.t > min(c.t) + 60)::BIGINT AS later FROM c GROUP BY item",
    "simple_fields": f"""
WITH {_CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE source WHEN 'exif' THEN 0 WHEN 'google_json' THEN 1 ELSE 2 END, confidence DESC, k) AS n FROM c WHERE source IN ('exif', 'google_json', 'filename'))
SELECT user_id, k, source, confidence FROM k WHERE n = 1
""",
    "gps_fusion": f"""
WITH {_CLAIMS}, g AS (SELECT *, user_id % 60 + k / 500.0 AS lat, user_id % 170 + k / 400.0 AS lon, CASE source WHEN 'exif' THEN 0 WHEN 'quicktime' THEN 1 ELSE 2 END AS r FROM c WHERE source IN ('exif', 'quicktime', 'google_json')),
b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r, confidence DESC, event_id) AS n FROM g),
f AS (SELECT g.item, b.lat, b.lon, b.source, max(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(g.lat)) / 2), 2) + cos(radians(g.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(g.lon)) / 2), 2))))) AS km, count(*) AS claims FROM g JOIN b ON b.item = g.item AND b.n = 1 GROUP BY ALL)
SELECT item, round(lat, 6)::DOUBLE AS lat, round(lon, 6)::DOUBLE AS lon, source, round(km, 6) AS km, claims::BIGINT AS claims, CASE WHEN km <= 0.1 THEN 'agreed' WHEN km < 5 THEN 'gps_spread' WHEN source IN ('exif', 'quicktime') THEN 'camera' ELSE 'gps_review' END AS verdict FROM f
""",
    "json_claims": """
WITH e AS (SELECT event_id, floor(epoch(ts))::BIGINT AS t, (props->>'$.k')::BIGINT AS k FROM events)
SELECT event_id, 'datetime_utc' AS field, t::VARCHAR AS value, 0.9::DOUBLE AS confidence FROM e UNION ALL SELECT event_id, 'upload', (t + 86400)::VARCHAR, 0.2 FROM e
UNION ALL SELECT event_id, 'gps', printf('%.7f,%.7f', (k * 0.5)::DOUBLE, (k * 1.0)::DOUBLE), 0.9 FROM e WHERE k % 3 <> 0 UNION ALL SELECT event_id, 'original_filename', 'IMG_' || event_id, 1.0 FROM e
""",
    "tag_claims": """
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS d, strftime(o_orderdate + INTERVAL 1 DAY, '%Y:%m:%d 00:00:00') AS m FROM orders),
c AS (SELECT o_orderkey, 'datetime_local' AS field, d AS value, 0.95 AS confidence FROM o WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'datetime_local', d, 0.8 FROM o UNION ALL SELECT o_orderkey, 'datetime_local', m, 0.3 FROM o
  UNION ALL SELECT o_orderkey, 'utc_offset', '+02:00', 0.9 FROM o UNION ALL SELECT o_orderkey, 'utc_offset', CASE WHEN o_orderkey % 4 = 0 THEN '+02:00' ELSE '+01:00' END, 0.7 FROM o)
SELECT o_orderkey, field, value, max(confidence)::DOUBLE AS confidence FROM c GROUP BY ALL
""",
}
