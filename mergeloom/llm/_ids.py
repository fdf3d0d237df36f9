"""A bitmap of ids that lets most rows pass by without a shuffle. It may name rows that aren't meant, never miss one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits, at most: 16 MB.
MOST_BITS = 1 << 27
#: What a null id counts as.
NULL = -(2**63)


class IdFilter:
    """Of the non-null ids in ``column`` of ``ids``; null ids count as NULL."""

    def __init__(self, ids: DataFrame, column: str) -> None:
        key = F.coalesce(F.col(column), F.lit(NULL))
        n = ids.count()
        self.bits = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
        bit = F.pmod(key, F.lit(self.bits))
        # at most bits / 64 rows
        words = ids.groupBy(F.floor(bit / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("x")).toArrow()
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words.column("w").to_numpy()] = words.column("x").to_numpy()

    def __call__(self, ids: pa.Array) -> np.ndarray:
        at = np.mod(ids.cast(pa.int64()).fill_null(NULL).to_numpy(zero_copy_only=False), self.bits)
        return (self.words[at // 64] >> (at % 64)) & 1 > 0
