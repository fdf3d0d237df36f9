"""Files as tables: listings of folders, sidecar JSON, and small tab-separated dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.operators.evidence import magic, skipped

SIDECAR = "photoTakenTime struct<timestamp: string>, creationTime struct<timestamp: string>, geoData struct<latitude: double, longitude: double, altitude: double>, geoDataExif struct<latitude: double, longitude: double, altitude: double>, title string, description string, favorited boolean, people array<struct<name: string>>"


def listing(spark: SparkSession, roots: list[str], heads: bool = True) -> DataFrame:
    """All files below the roots: path, name, size, mtime, priority (a root's place), kind, mime, status and reason.

    Nothing that the file source delivers is dropped: skipped and unknown files stay, with the reason (it doesn't deliver
    empty files). Contents are read for their first bytes and hash, and not at all with ``heads`` off."""
    out = None
    for i, root in enumerate(roots):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("priority", F.lit(i))
        out = one if out is None else out.unionByName(one)
    name = F.element_at(F.split("path", "/"), -1)
    own = out.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "priority", *([magic(F.substring("content", 1, 4096)).alias("m"), F.sha2("content", 256).alias("sha256")] if heads else []))
    if not heads:
        return own
    reason = F.when(skipped(F.col("name")), "never media").when(F.col("m").isNull(), "unknown type")
    return own.select("path", "name", "size", "mtime", "priority", "m.kind", "m.mime", "sha256", F.when(reason.isNull(), "scanned").otherwise("skipped").alias("status"), reason.alias("reason"))


def sidecar_claims(files: DataFrame, key: str, payload: str) -> DataFrame:
    """Claims (key, field, value, confidence) of sidecar JSON texts: times, the first place that isn't null island, altitude, title, description, people."""
    j = F.from_json(F.col(payload), SIDECAR)
    own = files.select(key, j.alias("j"))

    def fix(name: str) -> F.Column:
        lat, lon = F.col(f"j.{name}.latitude"), F.col(f"j.{name}.longitude")
        return F.when(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)), F.format_string("%.7f,%.7f", lat, lon))

    positive = lambda c: F.when(F.col(c).try_cast("long") > 0, F.col(c))
    gps = F.when(fix("geoDataExif").isNotNull(), F.struct(F.lit("gps").alias("field"), fix("geoDataExif").alias("value"), F.lit(0.9).alias("confidence"))).otherwise(F.struct(F.lit("gps").alias("field"), fix("geoData").alias("value"), F.lit(0.85).alias("confidence")))
    claim = lambda f, v, c: F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(c).alias("confidence"))
    people = F.array_join(F.transform("j.people", lambda p: p["name"]), ", ")
    claims = F.array(
        claim("datetime_utc", positive("j.photoTakenTime.timestamp"), 0.9), claim("upload", positive("j.creationTime.timestamp"), 0.2), gps, claim("original_filename", F.col("j.title"), 1.0),
        claim("description", F.nullif(F.col("j.description"), F.lit("")), 1.0), claim("favorite", F.when(F.col("j.favorited"), "true"), 1.0), claim("people", F.nullif(people, F.lit("")), 1.0),
    )
    return own.select(key, F.explode(F.filter(claims, lambda c: c["value"].isNotNull())).alias("c")).select(key, "c.*")


def places(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer: tab-separated name, country, region, lat, lon, population, zone and folded name; ``#`` starts a comment."""
    shape = "place string, country string, region string, lat double, lon double, population long, zone string, folded string"
    return spark.read.csv(path, sep="\t", comment="#", schema=shape, mode="DROPMALFORMED").where("lat is not null and lon is not null")


def search_places(gazetteer: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """Places by name, without case and accents: exact ones first, then those that begin so; the most populous first. One letter finds nothing."""
    folded = F.collate(F.col("place"), "UNICODE_CI_AI")
    exact, begins = folded == F.collate(F.lit(needle), "UNICODE_CI_AI"), F.startswith(folded, F.collate(F.lit(needle), "UNICODE_CI_AI"))
    return gazetteer.where(begins & F.lit(len(needle) >= 2)).orderBy(F.when(exact, 0).otherwise(1), F.desc("population"), "place").limit(limit)
