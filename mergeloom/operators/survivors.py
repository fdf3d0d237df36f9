"""Grouping of records and election of one survivor per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_edges(df: DataFrame, key: str, *hashes: str) -> DataFrame:
    """(u, v): each row linked to the least key with the same hash, for each hash column in turn. Null and empty hashes link nothing."""
    out = None
    for h in hashes:
        own = df.where((F.col(h).isNotNull()) & (F.col(h) != "")).select(F.col(key).alias("v"), F.col(h).alias("_h"))
        least = own.groupBy("_h").agg(F.min("v").alias("u"))
        edges = own.join(least, "_h").where("u <> v").select("u", "v")
        out = edges if out is None else out.unionByName(edges)
    return out


def guarded_edges(df: DataFrame, key: str, hashed: str, moment: str) -> DataFrame:
    """(u, v): each row linked to the first earlier row with its hash whose moment isn't in conflict (either is null, or they're equal).

    The first one is a minimum per hash and moment, so no pairs of a hash are formed. Keeping all compatible pairs
    would let a row without a moment bridge two that exclude each other."""
    own = df.where(F.col(hashed).isNotNull()).select(F.col(key).alias("v"), F.col(hashed).alias("_h"), F.col(moment).alias("_m"))
    per = own.groupBy("_h", "_m").agg(F.min("v").alias("first"))
    anyone = per.groupBy("_h").agg(F.min("first").alias("any"), F.min(F.when(F.col("_m").isNull(), F.col("first"))).alias("undated"))
    same = own.join(per.where("_m is not null"), ["_h", "_m"], "left").join(anyone, "_h")
    pick = F.when(F.col("_m").isNull(), F.col("any")).otherwise(F.least("first", "undated"))
    return same.select(pick.alias("u"), "v").where("u < v")


def elect(df: DataFrame, group: str, order: list[Column], carried: list[str]) -> DataFrame:
    """The row of each group that sorts first by ``order`` (ascending; end it with a unique key): ``carried`` and the group's size.

    A minimum over structs is pre-aggregated, so a large group isn't gathered and sorted in one task."""
    best = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*carried).alias("row"))).alias("best")
    return df.groupBy(group).agg(best, F.count(F.lit(1)).alias("members")).select(group, *[F.col(f"best.row.{c}").alias(c) for c in carried], "members")


def in_band(df: DataFrame, group: str, pixels: str, share: float = 0.98) -> DataFrame:
    """Adds ``in_band``: whether a row has at least ``share`` of its group's most pixels (or there are none)."""
    most = df.groupBy(group).agg(F.max(pixels).alias("_most"))
    return df.join(most, group).withColumn("in_band", F.coalesce(F.col(pixels) >= F.col("_most") * share, F.lit(True))).drop("_most")
