"""Plans, gates and ledgers as relations: what would be written, dropped or kept, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def target_paths(rows: DataFrame, key: str, local: Column, ext: Column, zone_known: Column) -> DataFrame:
    """Adds ``path``: ``YYYY/MM/YYYYMMDD_HHMMSS`` with a number for further rows of one second, ``Z`` after clocks without a zone, or ``undated/asset_%06d``.

    Numbers are per base name, ordered by key; only rows of one second share a window."""
    stamp = F.date_format(local, "yyyyMMdd_HHmmss")
    base = F.concat(stamp, F.when(zone_known, "").otherwise("Z"))
    k = F.row_number().over(Window.partitionBy("_base").orderBy(key)) - 1
    own = rows.withColumn("_base", base).withColumn("_k", F.when(F.col("_base").isNotNull(), k))
    path = F.concat(F.date_format(local, "yyyy/MM/"), F.col("_base"), F.when(F.col("_k") > 0, F.concat(F.lit("_"), F.col("_k").cast("string"))).otherwise(""), ext)
    return own.withColumn("path", F.coalesce(path, F.concat(F.format_string("undated/asset_%06d", key), ext))).drop("_base", "_k")


def rescan(old: DataFrame, new: DataFrame, complete: bool = True) -> DataFrame:
    """(path, change) of two listings (path, size, mtime): new, changed (size or more than half a second), moved on (unchanged), or gone; gone only if the walk was complete."""
    o = old.select("path", F.col("size").alias("s1"), F.col("mtime").alias("m1"))
    n = new.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"))
    both = o.join(n, "path", "full")
    change = F.when(F.col("s1").isNull(), "new").when(F.col("s2").isNull(), "gone" if complete else "unseen").when((F.col("s1") != F.col("s2")) | (F.abs(F.col("m1") - F.col("m2")) > 0.5), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def trash_gate(duplicates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each duplicate (file_id, keeper) with whether it may go: it needs a keeper with a decision that was verified."""
    d = decisions.select(F.col("file_id").alias("keeper"), "verified_at", F.lit(True).alias("decided"))
    met = duplicates.join(d, "keeper", "left")
    reason = F.when(F.col("keeper").isNull(), "no keeper").when(F.col("decided").isNull(), "keeper undecided").when(F.col("verified_at").isNull(), "keeper unverified").otherwise("eligible")
    return met.select("file_id", "keeper", reason.alias("reason"))


def retire(manifest: DataFrame, kept: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (file_id, sha) after a change: kept, re-attached to the least free file of the same content, or dropped."""
    alive = kept.select("file_id", F.lit(True).alias("alive"))
    free = files.join(manifest.select("file_id"), "file_id", "left_anti").groupBy("sha").agg(F.min("file_id").alias("other"))
    met = manifest.join(alive, "file_id", "left").join(free, "sha", "left")
    state = F.when(F.col("alive"), "kept").when(F.col("other").isNotNull(), "reattached").otherwise("dropped")
    return met.select("file_id", state.alias("state"), F.when(F.col("alive"), F.col("file_id")).otherwise(F.col("other")).alias("now"))


def latest(rows: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """The last row per key: overrides where a later one replaces an earlier one."""
    fields = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max(F.struct(F.col(sequence).alias("_s"), *[F.col(c) for c in fields])).alias("_b")).select(*by, *[F.col(f"_b.{c}").alias(c) for c in fields])


def reachable(target: Column, source: Column) -> Column:
    """Whether one folder contains the other, either way: then it can't be a destination."""
    t, s = F.concat(F.rtrim(target, F.lit("/")), F.lit("/")), F.concat(F.rtrim(source, F.lit("/")), F.lit("/"))
    return t.startswith(s) | s.startswith(t)


def canonical_root(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``, by text alone."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    done = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def csv_field(text: Column, defuse: bool = False) -> Column:
    """A field by RFC 4180: quoted if it holds a quote, comma or line break; a leading formula sign is defused on request."""
    safe = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text) if defuse else text
    return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(safe, F.lit("")))
