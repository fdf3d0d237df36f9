"""The bitmap of ids never misses one, null ones included, and lets most others pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from mergeloom.llm._ids import IdFilter


def test_names_all_that_are_meant(spark):
    ids = [None, 0, 1, 63, 64, -5, 2**62, *range(1_000, 9_000, 7)]
    named = IdFilter(spark.createDataFrame([(x,) for x in ids], "id long"), "id")
    assert named(pa.array(ids, pa.int64())).all()
    assert named(pa.array(np.arange(100_000, 200_000))).mean() < 0.2


def test_no_ids(spark):
    named = IdFilter(spark.createDataFrame([], "id long"), "id")
    assert not named(pa.array([None, 0, 7], pa.int64())).any()
