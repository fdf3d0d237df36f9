"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates beyond the bound that the first cut leaves room for, as a share, and in all.
ROOM, MORE = 0.25, 200


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``."""
    return F.crc32(key.cast("string").cast("binary")) % n


def share_to_cut(distinct: float, bound: int) -> float:
    """The share of the range of hashes below which at least ``bound`` of so many rows are to be expected."""
    return 1.0 if distinct <= bound else min(1.0, ((1 + ROOM) * bound + MORE) / distinct)


def hash_cut(share: float) -> int:
    """The largest 64-bit hash, as a signed long, within a share of the range."""
    return min(2**63 - 1, -(2**63) + int(share * 2**64))


def fitting_sample(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` different rows with the least hashes, or all different ones if there are no more.

    A first cut, from an estimate of how many different rows there are, leaves about the bound; the exact one is made
    among those. So the sample has ``bound`` rows at any size of the table, repeated rows count once, and neither the
    driver nor a task holds more than about the bound."""
    names = rows.columns
    hashed = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    n = hashed.agg(F.approx_count_distinct("_hash", 0.03)).first()[0]
    share = share_to_cut(n, bound)
    while True:
        some = hashed if share >= 1 else hashed.where(F.col("_hash") <= hash_cut(share))
        some = some.dropDuplicates(names)
        if share >= 1 or some.count() >= bound:  # the estimate was good, as it nearly always is
            return some.orderBy("_hash", *names).limit(bound).drop("_hash")
        share = min(1.0, 4 * share)


@contextmanager
def handed_back() -> Iterator[None]:
    """Returns what fitting took from the system when it is over.

    A model is fitted once and small; the allocators of the driver's process would keep the sample's and its features' memory
    for as long as the session runs."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)
