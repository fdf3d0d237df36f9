"""Evidence that names, paths, headers and texts give, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names, beginnings and endings of files that are never media.
SKIP_NAMES = ["thumbs.db", "desktop.ini", "metadata.json"]
SKIP_PREFIXES = ["._", ".ds_store"]
SKIP_SUFFIXES = [".part", ".tmp", ".crdownload"]
#: Endings that editors add, the longest first.
EDIT_ENDINGS = ["-effects-edited", "-edited", "-effects"]


def skipped(name: Column) -> Column:
    low = F.lower(name)
    out = low.isin(SKIP_NAMES)
    for p in SKIP_PREFIXES:
        out = out | low.startswith(p)
    for s in SKIP_SUFFIXES:
        out = out | low.endswith(s)
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded: a plain word names any part of it; one with ``*``, ``?`` or ``/`` is a glob over the file name or the path. ``#`` starts a comment."""
    import re

    low = F.lower(path)
    out = F.lit(False)
    for raw in patterns:
        p = raw.split("#")[0].strip().lower()
        if not p:
            continue
        if any(c in p for c in "*?/"):
            regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
            out = out | low.rlike(f"^(?:.*/)?{regex}$")
        else:
            out = out | F.array_contains(F.split(low, "/"), p)
    return out


def capture_stem(name: Column) -> Column:
    """A file's name without what copies and edits add: an uuid in front, one editor's ending, a copy's number and blanks before it, a motion suffix, in this order."""
    out = F.regexp_replace(F.lower(name), r"\.[a-z0-9]{1,5}$", "")
    out = F.regexp_replace(out, r"^original_[0-9a-f-]{36}_", "")
    out = F.regexp_replace(out, f"({'|'.join(EDIT_ENDINGS)})$", "")  # the first that fits, which is the longest
    out = F.regexp_replace(out, r"\s*\([0-9]+\)$", "")
    out = F.regexp_replace(out, r"~[0-9]+$", "")
    return F.regexp_replace(out, r"\.mp$", "")


def edit_origin(name: Column) -> Column:
    """The name of the picture that an edit was made from; null if the name isn't an edit's."""
    return F.when(F.lower(name).rlike(r"(-effects-edited|-edited|-effects)(\.[a-z0-9]+)?$"), F.regexp_replace(name, r"(?i)(-effects-edited|-edited|-effects)(?=(\.[A-Za-z0-9]+)?$)", ""))


def filename_time(name: Column, last_year: int) -> Column:
    """(kind, epoch seconds) that a name gives: wall clocks in four notations, else an instant of 10 or 13 digits; only plausible years."""
    stamp = lambda p: F.regexp_replace(F.regexp_extract(name, p, 0), r"[^0-9]", "")
    forms = [r"(?<![0-9])(?:19|20)[0-9]{6}[_-][0-9]{6}(?![0-9])", r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}[ _-][0-9]{2}[-.][0-9]{2}[-.][0-9]{2}(?![0-9])", r"(?<![0-9])(?:19|20)[0-9]{12}(?![0-9])"]
    wall = F.coalesce(*[F.try_to_timestamp(F.when(F.length(stamp(p)) == 14, stamp(p)), F.lit("yyyyMMddHHmmss")) for p in forms])
    day = F.try_to_timestamp(F.when(name.rlike(r"(?<![0-9])(?:19|20)[0-9]{6}-WA[0-9]+"), F.regexp_extract(name, r"((?:19|20)[0-9]{6})-WA", 1)), F.lit("yyyyMMdd"))
    local = F.coalesce(wall, day)
    local = F.when(F.year(local).between(1995, last_year), F.unix_seconds(local))
    epoch = F.coalesce(F.regexp_extract(name, r"(?<![0-9])(1[0-9]{12})(?![0-9])", 1).try_cast("long") / 1000, F.regexp_extract(name, r"(?<![0-9])(1[0-9]{9})(?![0-9])", 1).try_cast("double"))
    return F.when(local.isNotNull(), F.struct(F.lit("datetime_local").alias("kind"), local.alias("t"))).when(epoch.isNotNull(), F.struct(F.lit("datetime_utc").alias("kind"), F.floor(epoch).alias("t")))


def folder_claims(path: Column) -> Column:
    """Claims of the folders on a path: a year of ``Photos from YYYY``, and other folders as albums, but for storage ones."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    years = F.transform(F.filter(parts, lambda p: p.rlike("^Photos from [0-9]{4}$")), lambda p: F.struct(F.lit("year").alias("field"), F.right(p, F.lit(4)).alias("value"), F.lit(0.3).alias("confidence")))
    albums = F.transform(F.filter(parts, lambda p: ~p.rlike("^Photos from [0-9]{4}$") & ~p.isin("", "Takeout", "Google Photos") & (F.length(p) > 2)), lambda p: F.struct(F.lit("album").alias("field"), p.alias("value"), F.lit(0.8).alias("confidence")))
    return F.concat(years, albums)


def coordinate(text: Column) -> Column:
    """(lat, lon) of ``lat, lon`` in decimals, with hemisphere letters, or in degrees, minutes and seconds; null if out of range or (0, 0)."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    decimal = rf"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*[,;\s]\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*$"
    letters = rf"^\s*{number}°?\s*([NS])\s*[,;\s]?\s*{number}°?\s*([EW])\s*$"
    dms = rf"^\s*{number}°\s*{number}['′]\s*(?:{number}[\"″])?\s*([NS])\s*[,;\s]?\s*{number}°\s*{number}['′]\s*(?:{number}[\"″])?\s*([EW])\s*$"
    g = lambda p, i: F.regexp_extract(text, p, i)
    n = lambda p, i: F.coalesce(g(p, i).try_cast("double"), F.lit(0.0))
    sign = lambda c: F.when(c.isin("S", "W"), -1.0).otherwise(1.0)
    point = (
        F.when(text.rlike(decimal), F.struct(n(decimal, 1).alias("lat"), n(decimal, 2).alias("lon")))
        .when(text.rlike(letters), F.struct((n(letters, 1) * sign(g(letters, 2))).alias("lat"), (n(letters, 3) * sign(g(letters, 4))).alias("lon")))
        .when(text.rlike(dms), F.struct(((n(dms, 1) + n(dms, 2) / 60 + n(dms, 3) / 3600) * sign(g(dms, 4))).alias("lat"), ((n(dms, 5) + n(dms, 6) / 60 + n(dms, 7) / 3600) * sign(g(dms, 8))).alias("lon")))
    )
    good = (F.abs(point["lat"]) <= 90) & (F.abs(point["lon"]) <= 180) & ~((point["lat"] == 0) & (point["lon"] == 0))
    return F.when(good, point)


def iso6709(text: Column) -> Column:
    """(lat, lon) of ``+DD.D-DDD.D+AAA/``."""
    p = r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)"
    return F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).cast("double").alias("lat"), F.regexp_extract(text, p, 2).cast("double").alias("lon")))


def offset_seconds(text: Column) -> Column:
    """Seconds of ``+08:00`` or ``-0500``; null for anything else."""
    p = r"^([+-])([0-9]{2}):?([0-9]{2})$"
    s = F.regexp_extract(text, p, 2).try_cast("int") * 3600 + F.regexp_extract(text, p, 3).try_cast("int") * 60
    return F.when(text.rlike(p), F.when(F.startswith(text, F.lit("-")), -s).otherwise(s))


def magic(head: Column) -> Column:
    """(kind, mime) of a file's first bytes; null if unknown. Of the brands of a media container, a picture's wins over a video's."""
    h = F.hex(head)
    brands = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(h) - 16) / 8) - 1, F.lit(0))), lambda i: F.substring(h, F.lit(17) + i * 8, F.lit(8)))
    code = lambda s: F.array(*[F.lit(x.ljust(4).encode().hex().upper()) for x in s.split()])
    ftyp = F.substring(h, 9, 8) == b"ftyp".hex().upper()
    kind = lambda k, m: F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mime"))
    return (
        F.when(h.startswith("FFD8FF"), kind("image", "image/jpeg")).when(h.startswith("89504E470D0A1A0A"), kind("image", "image/png")).when(h.startswith("47494638"), kind("image", "image/gif"))
        .when(h.startswith("424D"), kind("image", "image/bmp")).when(h.startswith("49492A00") | h.startswith("4D4D002A"), kind("image", "image/tiff"))
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), kind("image", "image/webp")).when(h.startswith("52494646") & (F.substring(h, 17, 8) == "41564920"), kind("video", "video/x-msvideo"))
        .when(h.startswith("1A45DFA3"), kind("video", "video/x-matroska")).when(ftyp & F.arrays_overlap(brands, code("heic heix hevc mif1 msf1")), kind("image", "image/heic")).when(ftyp & F.arrays_overlap(brands, code("avif avis")), kind("image", "image/avif"))
        .when(ftyp & (F.substring(h, 17, 8) == "71742020"), kind("video", "video/quicktime")).when(ftyp, kind("video", "video/mp4"))
        .when(F.substring(h, 9, 8).isin(*[x.encode().hex().upper() for x in ("moov", "mdat", "wide", "free", "skip", "pnot")]), kind("video", "video/quicktime"))
    )


def sidecars(media: DataFrame, files: DataFrame) -> DataFrame:
    """(id, sidecar, rule) for media (id, folder, name) from the JSON files (folder, name) beside them.

    In order: ``name.supplemental-metadata.json``, ``name.json``, a truncated ``name.supplemental…json``, ``X.ext(n)`` for ``X(n).ext``, ``stem.…json``, the picture that an edit
    came from (any of these). Names are compared without case; of several that begin alike the first by name counts."""
    m = media.select("id", F.lower("folder").alias("d"), F.lower("name").alias("n")).withColumn("stem", F.regexp_replace("n", r"\.[a-z0-9]+$", "")).withColumn("ext", F.regexp_extract("n", r"(\.[a-z0-9]+)$", 1))
    num = F.regexp_extract("stem", r"^(.*)\(([0-9]+)\)$", 2)
    base = F.regexp_extract("stem", r"^(.*)\(([0-9]+)\)$", 1)
    origin = F.regexp_replace("stem", r"(-effects-edited|-edited|-effects)$", "")
    want = lambda rank, rule, key: F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), key.alias("key"))
    edited = origin != F.col("stem")
    exact = F.array(
        want(1, "exact", F.concat("n", F.lit(".supplemental-metadata.json"))), want(2, "bare", F.concat("n", F.lit(".json"))),
        want(4, "suffix_n", F.when(num != "", F.concat(base, F.col("ext"), F.lit(".supplemental-metadata("), num, F.lit(").json")))), want(5, "suffix_n", F.when(num != "", F.concat(base, F.col("ext"), F.lit("("), num, F.lit(").json")))),
        want(7, "edited_origin", F.when(edited, F.concat(origin, F.col("ext"), F.lit(".supplemental-metadata.json")))), want(8, "edited_origin", F.when(edited, F.concat(origin, F.col("ext"), F.lit(".json")))),
    )
    f = files.select(F.lower("folder").alias("d"), F.lower("name").alias("f")).where(F.col("f").endswith(".json"))
    by_name = m.select("id", "d", F.explode(exact).alias("w")).select("id", "d", "w.*").where("key is not null").join(f.withColumnRenamed("f", "key"), ["d", "key"]).select("id", "rank", "rule", F.col("key").alias("f"))
    # names that begin alike: keyed by what stands before the marker
    marked = f.withColumn("key", F.regexp_extract("f", r"^(.*)\.supplemental", 1)).where("key <> ''")
    truncated = m.join(marked.select("d", F.col("key").alias("n"), "f"), ["d", "n"]).select("id", F.lit(3).alias("rank"), F.lit("truncated").alias("rule"), "f")
    stems = f.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("f", r"\.")) - 1), lambda i: F.array_join(F.slice(F.split("f", r"\."), 1, i), "."))))
    by_stem = m.join(stems.select("d", "stem", "f"), ["d", "stem"]).select("id", F.lit(6).alias("rank"), F.lit("stem").alias("rule"), "f")
    best = by_name.unionByName(truncated).unionByName(by_stem).groupBy("id").agg(F.min(F.struct("rank", "f", "rule")).alias("b"))
    return best.select("id", F.col("b.f").alias("sidecar"), F.col("b.rule").alias("rule"))
