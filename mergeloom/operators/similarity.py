"""Similarity and interval joins as equi-joins on buckets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mergeloom.functions.hashing import hamming


#: Bands that make up a key of the Hamming join. Each multiplies the bits of a key, and the keys of a hash.
AGREE = 2


def _bands(n: int, bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` bands."""
    edges = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def hamming_join(df: DataFrame, key: str, value: str, radius: int, bits: int = 64, on: list[str] | None = None) -> DataFrame:
    """All pairs (a < b, distance) of rows whose hashes differ in at most ``radius`` bits and whose ``on`` columns are equal.

    Lossless for any radius below ``bits``: of radius + 2 bands at least two agree, and each two of them are an equi-join key (of
    radius + 1 bands one, where the bits don't suffice for more). Different hashes are joined, then their rows. A pair of hashes comes only
    from the first bands on which it agrees, so nothing has to be made distinct afterwards. Rows with a null hash pair with nothing."""
    if radius >= bits:
        raise ValueError("the radius must be below the number of bits")
    agree = min(AGREE, bits - radius)
    bands = _bands(radius + agree, bits)

    def part(x: Column, shift: int, width: int) -> Column:
        return F.call_function("shiftrightunsigned", x, F.lit(shift)).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    on = on or []
    rows = df.where(F.col(value).isNotNull()).select(*on, F.col(key).alias("k"), F.col(value).cast("long").alias("h"))
    keys = []
    for chosen in combinations(range(len(bands)), agree):
        word, at = F.lit(0).cast("long"), 0
        for i in chosen:
            word, at = word.bitwiseOR(F.shiftleft(part(F.col("h"), *bands[i]).cast("long"), at)), at + bands[i][1]
        # the bands of the key, and those up to its last one
        keys.append(F.struct(F.lit(sum(1 << i for i in chosen)).cast("long").alias("own"), F.lit((2 << chosen[-1]) - 1).cast("long").alias("upto"), word.alias("bits")))
    one = rows.select(*on, "h").distinct().withColumn("x", F.explode(F.array(*keys))).select(*on, "h", "x.own", "x.upto", "x.bits")
    x, y = one.withColumnRenamed("h", "ha"), one.drop("upto").withColumnRenamed("h", "hb")
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    agreed = F.lit(0).cast("long")
    for i, band in enumerate(bands):
        agreed = agreed.bitwiseOR(F.when(part(differ, *band) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    d = hamming(F.col("ha"), F.col("hb"))
    # Spark's estimate of an explode is one row for each that goes in, so it would broadcast a table of keys many times over the threshold
    near = x.hint("merge").join(y, [*on, "own", "bits"]).where((F.col("ha") < F.col("hb")) & (d <= radius) & (agreed.bitwiseAND(F.col("upto")) == F.col("own"))).select(*on, "ha", "hb", d.alias("distance"))
    a, b = rows.select(*on, F.col("k").alias("a"), F.col("h").alias("ha")), rows.select(*on, F.col("k").alias("b"), F.col("h").alias("hb"))
    crossed = near.join(a, [*on, "ha"]).join(b, [*on, "hb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").where("a <> b")
    same = a.join(b.withColumnRenamed("hb", "ha"), [*on, "ha"]).where("a < b").select("a", "b", F.lit(0).alias("distance"))
    return crossed.unionByName(same.withColumn("distance", F.col("distance").cast(crossed.schema["distance"].dataType)))


def hamming_edges(df: DataFrame, key: str, value: str, radius: int, bits: int = 64, on: list[str] | None = None) -> DataFrame:
    """Edges (u, v, distance) with the same components as all pairs of ``hamming_join``.

    Rows with equal hashes form a star around the least key; only different hashes are joined. A group
    of identical rows costs as many edges as it has rows."""
    on = on or []
    own = df.where(F.col(value).isNotNull()).select(*on, F.col(key).alias("v"), F.col(value).alias("h"))
    least = own.groupBy(*on, "h").agg(F.min("v").alias("u"))
    star = own.join(least, [*on, "h"]).where(F.col("v") != F.col("u")).select("u", "v", F.lit(0).alias("distance"))
    pairs = hamming_join(least, "u", "h", radius, bits, on)
    return star.unionByName(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "distance"))


def band_join(left: DataFrame, right: DataFrame, by: str, width: float, on: list[str] | None = None) -> DataFrame:
    """left x right where ``|left.by - right.by_r| <= width`` and ``on`` are equal, by buckets of ``width``.

    Columns of ``right`` come back with the suffix ``_r``. Each right row is in one bucket, each left row
    looks in three; no nested loop."""
    on = on or []
    bucket = F.floor(F.col(by) / F.lit(width))
    names = [c for c in right.columns if c not in on]
    r = right.select(*on, *[F.col(c).alias(f"{c}_r") for c in names]).withColumn("_bucket", F.floor(F.col(f"{by}_r") / F.lit(width)))
    probe = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    met = probe.join(r, [*on, "_bucket"]).where(F.abs(F.col(by) - F.col(f"{by}_r")) <= width).drop("_bucket")
    return met


def nearest_by_time(rows: DataFrame, anchors: DataFrame, time: str, carried: list[str], on: list[str] | None = None) -> DataFrame:
    """Each row with the anchor that is nearest in ``time`` within ``on``: columns ``a_<time>``, ``a_<carried>`` and ``gap``.

    Rows and anchors are merged once and sorted; the last anchor before and the first one after come from windows that
    skip nulls. The earlier one wins ties. Among anchors of one time the one that sorts first by ``carried`` wins.
    ``on`` is the unit of parallelism."""
    on = on or []
    distinct = anchors.groupBy(*on, time).agg(F.min(F.struct(*carried)).alias("_c"))
    a = distinct.select(*on, time, F.struct(F.col(time).alias("t"), *[F.col(f"_c.{c}").alias(c) for c in carried]).alias("_anchor"))
    merged = rows.withColumn("_row", F.lit(True)).unionByName(a.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(time)
    back = merged.withColumn("_before", F.last("_anchor", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    back = back.withColumn("_after", F.first("_anchor", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))).where("_row")
    before, after = F.abs(F.col(time) - F.col("_before.t")), F.abs(F.col("_after.t") - F.col(time))
    pick = F.when(F.col("_before").isNull() | (after < before), F.col("_after")).otherwise(F.col("_before"))
    out = back.withColumn("_pick", pick)
    return out.select(*rows.columns, F.col("_pick.t").alias(f"a_{time}"), *[F.col(f"_pick.{c}").alias(f"a_{c}") for c in carried], F.abs(F.col(time) - F.col("_pick.t")).alias("gap"))
