"""Dealing rows out by ranges of a key, so that neighbours in its order meet, without one global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys kept per range, at most, to choose where ranges are cut. It only balances the work.
PER_RANGE = 16
LEAST = -(2**63)


def range_cuts(keys: DataFrame, column: str, ranges: int) -> list[int]:
    """Ascending long keys at which ranges start, from the key with the least hash of each hash bucket."""
    hashed = keys.select(F.coalesce(F.col(column), F.lit(LEAST)).alias("k")).withColumn("h", F.xxhash64("k"))
    rows = hashed.groupBy(F.pmod("h", F.lit(PER_RANGE * ranges)).alias("b")).agg(F.min(F.struct("h", "k")).alias("x")).select("x.k").collect()  # at most the buckets
    seen = sorted(r["k"] for r in rows)
    return sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []


def range_number(key: Column, cuts: list, kind: str = "long") -> Column:
    """How many cuts are at or below the key, found in two steps of about a square root each. Null longs are least."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    key = F.coalesce(key, F.lit(LEAST)) if kind == "long" else key
    blocks = F.array(*[F.lit(x).cast(kind) for x in cuts[::step]])
    block = F.size(F.filter(blocks, lambda c: c <= key))  # blocks that start at or below the key
    inner = F.slice(F.array(*[F.lit(x).cast(kind) for x in cuts]), F.greatest(block - 1, F.lit(0)) * step + 1, F.lit(step))
    return F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(inner, lambda c: c <= key))).cast("int")
