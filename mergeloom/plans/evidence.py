"""Evidence from names, paths, coordinates and headers; orders and pages stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import table
from mergeloom.operators import evidence as E


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    name = (
        F.when(k % 8 == 0, F.concat(F.lit("IMG_"), F.date_format(d, "yyyyMMdd"), F.lit("_101112.jpg"))).when(k % 8 == 1, F.concat(F.lit("IMG-"), F.date_format(d, "yyyyMMdd"), F.lit("-WA0001.jpg")))
        .when(k % 8 == 2, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 09.08.07.png"))).when(k % 8 == 3, F.concat(F.lit("FB_"), (k + 1400000000).cast("string"), F.lit("123.jpg"))).when(k % 8 == 4, F.concat(F.lit("dsc"), k.cast("string"), F.lit("-edited(2).jpg")))
        .when(k % 8 == 5, F.concat(F.lit("Screenshot_"), F.date_format(d, "yyyyMMdd"), F.lit("235959~2.mp"))).when(k % 8 == 6, F.lit("Thumbs.db")).otherwise(F.concat(F.lit("scan-EFFECTS-edited"), k.cast("string"), F.lit(".tif.part")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))


_NAMES = """
n AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_101112.jpg' WHEN 1 THEN 'IMG-' || strftime(o_orderdate, '%Y%m%d') || '-WA0001.jpg' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09.08.07.png'
  WHEN 3 THEN 'FB_' || (o_orderkey + 1400000000) || '123.jpg' WHEN 4 THEN 'dsc' || o_orderkey || '-edited(2).jpg' WHEN 5 THEN 'Screenshot_' || strftime(o_orderdate, '%Y%m%d') || '235959~2.mp' WHEN 6 THEN 'Thumbs.db' ELSE 'scan-EFFECTS-edited' || o_orderkey || '.tif.part' END AS name, o_orderdate FROM orders)
"""


def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that names give, as wall clocks or instants."""
    own = _names(spark, sf_dir).select("o_orderkey", E.filename_time(F.col("name"), 2025).alias("c")).where("c is not null")
    return own.select("o_orderkey", "c.kind", F.col("c.t").cast("long").alias("t"))


def capture_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without what copies and edits add; what an edit came from; whether the file is skipped."""
    n = F.col("name")
    return _names(spark, sf_dir).select("o_orderkey", E.capture_stem(n).alias("stem"), F.coalesce(E.edit_origin(n), F.lit("")).alias("origin"), E.skipped(n).alias("skipped"))


def exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path is excluded by a word, a glob over names or one over paths."""
    path = F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", E.excluded(path, ["fr # French", "*.example.org/*", "7??", "# nothing"]).alias("excluded"))


def unrecognised_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per folder, the endings of files by count, at most eight, as text."""
    from mergeloom.operators.places import numbered

    own = _names(spark, sf_dir).select((F.col("o_orderkey") % 5).alias("folder"), F.regexp_extract(F.lower("name"), r"\.([a-z0-9]+)$", 1).alias("ext"))
    top = numbered(own.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("n")), ["folder"], [F.desc("n"), F.col("ext")], "k").where("k <= 8")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat("ext", F.lit(" x"), F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ")
    return top.groupBy("folder").agg(text.alias("kinds"))


def folder_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years and albums that folders claim."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("Takeout/Google Photos/"), F.when(k % 2 == 0, F.concat(F.lit("Photos from "), F.date_format("o_orderdate", "yyyy"))).otherwise(F.concat(F.lit("Trip "), (F.col("o_custkey") % 20).cast("string"))), F.lit("/"), F.when(k % 3 == 0, F.lit("ab/")).otherwise(F.lit("")), F.lit("x.jpg"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(E.folder_claims(path)).alias("c"))
    return own.select("o_orderkey", "c.*")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates that people typed, in several notations."""
    k = F.col("o_orderkey")
    a, b = (k % 180 - 90).cast("string"), (k % 360 - 180).cast("string")
    text = F.when(k % 5 == 0, F.concat(a, F.lit(".5, "), b, F.lit(".25"))).when(k % 5 == 1, F.concat((k % 90).cast("string"), F.lit("°S "), (k % 180).cast("string"), F.lit("°E"))).when(k % 5 == 2, F.concat((k % 90).cast("string"), F.lit("°30'0\"N "), (k % 180).cast("string"), F.lit("°15'36\"W"))).when(k % 5 == 3, F.lit("0, 0")).otherwise(F.lit("somewhere"))
    own = table(spark, sf_dir, "orders").select("o_orderkey", E.coordinate(text).alias("p")).where("p is not null")
    return own.select("o_orderkey", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets written with and without a colon, and positions in the compact notation."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("+"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit(":30"))).when(k % 3 == 1, F.concat(F.lit("-"), F.lpad((k % 12).cast("string"), 2, "0"), F.lit("00"))).otherwise(F.lit("Z"))
    place = F.concat(F.lit("+"), (k % 90).cast("string"), F.lit(".5-"), (k % 180).cast("string"), F.lit(".25+010/"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.offset_seconds(text).cast("long").alias("seconds"), E.iso6709(place)["lat"].alias("lat"), E.iso6709(place)["lon"].alias("lon"))


def sidecar_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON file beside each picture, by ranked rules on names; pages stand in for pictures and for the files beside them."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).cast("string").alias("folder"), (F.floor(F.col("page_id") / 20) % 30).cast("string").alias("i"))
    k = F.col("page_id")
    name = F.concat(F.lit("IMG_"), "i", F.when(k % 5 == 1, F.lit("(1)")).when(k % 5 == 2, F.lit("-edited")).otherwise(F.lit("")), F.lit(".JPG"))
    side = F.concat(F.lit("img_"), "i", F.when(k % 7 == 0, F.lit(".jpg.supplemental-metadata.json")).when(k % 7 == 1, F.lit(".jpg.json")).when(k % 7 == 2, F.lit(".jpg.supplemental-me.json")).when(k % 7 == 3, F.lit(".jpg(1).json")).when(k % 7 == 4, F.lit(".json")).when(k % 7 == 5, F.lit(".jpg.supplemental-metadata(1).json")).otherwise(F.lit(".txt")))
    return E.sidecars(p.select(F.col("page_id").alias("id"), "folder", name.alias("name")), p.select("folder", side.alias("name")))


def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by their first bytes."""
    heads = [(1, b"\xff\xd8\xff\xe0"), (2, b"\x89PNG\r\n\x1a\n"), (3, b"GIF89a"), (4, b"\0\0\0\x18ftypheic\0\0\0\0mif1heic"), (5, b"\0\0\0\x14ftypqt  \0\0\0\0qt  "), (6, b"\0\0\0\x18ftypmp42\0\0\0\0mp42isom"), (7, b"RIFF\0\0\0\0WEBP"), (8, b"\0\0\0\x08wide"), (9, b"text"), (10, b"\0\0\0\x1cftypmp42\0\0\0\0isomavif"), (11, b"\x1a\x45\xdf\xa3"), (12, b"II*\0")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in heads], "id long, head binary").select("id", E.magic(F.col("head")).alias("m"))
    return df.select("id", F.coalesce("m.kind", F.lit("unknown")).alias("kind"), F.coalesce("m.mime", F.lit("")).alias("mime"))


QUERIES = {f.__name__: f for f in (filename_dates, capture_stem, exclusion, unrecognised_kinds, folder_evidence, coordinates, clock_offsets, sidecar_cascade, magic_sniff)}
SQL = {
    "filename_dates": f"""
WITH {_NAMES} SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 3 THEN 'datetime_utc' ELSE 'datetime_local' END AS kind,
CASE o_orderkey % 8 WHEN 0 THEN floor(epoch(o_orderdate))::BIGINT + 36672 WHEN 1 THEN floor(epoch(o_orderdate))::BIGINT WHEN 2 THEN floor(epoch(o_orderdate))::BIGINT + 32887 WHEN 3 THEN o_orderkey + 1400000000 ELSE floor(epoch(o_orderdate))::BIGINT + 86399 END AS t FROM n WHERE o_orderkey % 8 IN (0, 1, 2, 3, 5) AND (o_orderkey % 8 = 3 OR year(o_orderdate) BETWEEN 1995 AND 2025)
""",
    "capture_stem": rf"""
WITH {_NAMES}, s AS (SELECT o_orderkey, name, lower(name) AS l, regexp_replace(lower(name), '\.[a-z0-9]{{1,5}}$', '') AS a FROM n),
t AS (SELECT *, regexp_replace(a, '(-effects-edited|-edited|-effects)$', '') AS b FROM s)
SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(b, '\s*\([0-9]+\)$', ''), '~[0-9]+$', ''), '\.mp$', '') AS stem, '' AS origin, l = 'thumbs.db' OR ends_with(l, '.part') AS skipped FROM t
""",
    "exclusion": r"""
WITH p AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/$', '')) AS path FROM pages)
SELECT page_id, list_contains(string_split(path, '/'), 'fr') OR regexp_matches(path, '^(.*/)?.*\.example\.org/.*$') OR regexp_matches(path, '^(.*/)?7..$') AS excluded FROM p
""",
    "unrecognised_kinds": rf"""
WITH {_NAMES}, c AS (SELECT o_orderkey % 5 AS folder, regexp_extract(lower(name), '\.([a-z0-9]+)$', 1) AS ext, count(*) AS n FROM n GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, ext) AS k FROM c)
SELECT folder, string_agg(ext || ' x' || n, ', ' ORDER BY k) AS kinds FROM k WHERE k <= 8 GROUP BY folder
""",
    "folder_evidence": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'year' ELSE 'album' END AS field, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::VARCHAR ELSE 'Trip ' || o_custkey % 20 END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence FROM orders
""",
    "coordinates": """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ((o_orderkey % 180 - 90) || '.5')::DOUBLE WHEN 1 THEN -(o_orderkey % 90)::DOUBLE WHEN 2 THEN o_orderkey % 90 + 0.5 END AS lat,
  CASE o_orderkey % 5 WHEN 0 THEN ((o_orderkey % 360 - 180) || '.25')::DOUBLE WHEN 1 THEN (o_orderkey % 180)::DOUBLE WHEN 2 THEN -(o_orderkey % 180 + 15 / 60.0 + 36 / 3600.0) END AS lon FROM orders)
SELECT o_orderkey, round(lat, 6)::DOUBLE AS lat, round(lon, 6)::DOUBLE AS lon FROM p WHERE lat IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)
""",
    "clock_offsets": """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 14 * 3600 + 1800 WHEN 1 THEN -(o_orderkey % 12) * 3600 END::BIGINT AS seconds, (o_orderkey % 90 || '.5')::DOUBLE AS lat, -(o_orderkey % 180 || '.25')::DOUBLE AS lon FROM orders
""",
    "sidecar_cascade": r"""
WITH p AS (SELECT page_id AS k, page_id % 20 AS d, page_id // 20 % 30 AS i FROM pages),
m AS (SELECT k AS id, d, 'img_' || i || CASE k % 5 WHEN 1 THEN '(1)' WHEN 2 THEN '-edited' ELSE '' END AS stem, 'img_' || i AS root, k % 5 AS v FROM p),
f AS (SELECT DISTINCT d, 'img_' || i || CASE k % 7 WHEN 0 THEN '.jpg.supplemental-metadata.json' WHEN 1 THEN '.jpg.json' WHEN 2 THEN '.jpg.supplemental-me.json' WHEN 3 THEN '.jpg(1).json' WHEN 4 THEN '.json' ELSE '.jpg.supplemental-metadata(1).json' END AS f FROM p WHERE k % 7 <> 6),
c AS (SELECT m.id, f.f, CASE WHEN f = stem || '.jpg.supplemental-metadata.json' THEN 1 WHEN f = stem || '.jpg.json' THEN 2 WHEN starts_with(f, stem || '.jpg.supplemental') THEN 3 WHEN v = 1 AND f = root || '.jpg.supplemental-metadata(1).json' THEN 4 WHEN v = 1 AND f = root || '.jpg(1).json' THEN 5
  WHEN starts_with(f, stem || '.') THEN 6 WHEN v = 2 AND f = root || '.jpg.supplemental-metadata.json' THEN 7 WHEN v = 2 AND f = root || '.jpg.json' THEN 8 END AS rank FROM m JOIN f USING (d)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, f) AS n FROM c WHERE rank IS NOT NULL)
SELECT id, f AS sidecar, ['exact', 'bare', 'truncated', 'suffix_n', 'suffix_n', 'stem', 'edited_origin', 'edited_origin'][rank] AS rule FROM b WHERE n = 1
""",
}
