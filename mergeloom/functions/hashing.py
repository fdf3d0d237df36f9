"""Hashes of records as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIM_BITS = 60


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two longs; the sign bit is a bit like any other."""
    return F.bit_count(a.bitwiseXOR(b))


def loose_hash(text: Column) -> Column:
    """Hash that ignores case and white space: copies that were only reformatted share it."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def hex_prefix(hexed: Column, digits: int = 15) -> Column:
    """The first hexadecimal digits of a digest as a non-negative long."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): per bit the majority over the text's distinct lower-cased words.

    One counter per bit is pre-aggregated where the words are; a row of counters per text is shuffled."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != ""))
    bits = df.select(key, F.explode(words).alias("w")).select(key, hex_prefix(F.md5("w")).alias("h"))
    sums = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"b{b}") for b in range(SIM_BITS)]
    counted = bits.groupBy(key).agg(*sums)
    total = F.lit(0).cast("long")
    for b in range(SIM_BITS):
        total = total + F.when(F.col(f"b{b}") > 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return counted.select(key, total.alias("simhash"))


def sign_hash(values: Column, n: int) -> Column:
    """Bit i is set if value i + 1 exceeds value i, for the first ``n`` neighbours of an array; a neighbour that is null or missing sets no bit.

    The array is an argument of the functions, not a name within them: in a new session, where columns have the numbers by which Spark compares variables of
    functions, 4.1 moves a filter on such a name to where its column isn't, and the query fails."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rises = F.zip_with(F.slice(values, 2, n), F.slice(values, 1, n), lambda after, before: after > before)
    return F.coalesce(F.aggregate(F.reverse(rises), zero, lambda acc, rise: F.shiftleft(acc, 1).bitwiseOR(F.when(rise, one).otherwise(zero))), zero)


def frequency_hash(grid: Column) -> Column:
    """256 bits of a 32 x 32 grid (an array of 1,024 numbers): which of the 16 x 16 lowest frequencies exceed their median.

    The cosine transform is two matrix products over whole batches; the constant term isn't part of the median."""
    k, x = np.arange(16)[:, None], np.arange(32)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / 64)

    @F.pandas_udf("binary")
    def run(grids: pd.Series) -> pd.Series:
        out = []
        for g in grids:
            if g is None or len(g) != 1024:
                out.append(None)
                continue
            low = (basis @ np.asarray(g, float).reshape(32, 32) @ basis.T).ravel()
            out.append(np.packbits(low > np.median(low[1:])).tobytes())
        return pd.Series(out)

    return run(grid)
