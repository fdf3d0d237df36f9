"""Bounded samples at any size, and feature tables without collisions."""

import numpy as np
import pytest

from mergeloom.llm import _sample, _text


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 10**6, 10**10, 10**13])
def test_share_never_leaves_too_few(n):
    share = _sample.share_to_cut(n, 100)
    kept = (_sample.hash_cut(share) + 2**63) / 2**64 * n
    assert kept >= min(n, 100) and (n <= 200 or kept <= 400)


def test_sample_is_exact(spark):
    rows = spark.range(5_000).selectExpr("id as doc_id", "concat('t', id) as text")
    one = _sample.fitting_sample(rows, 100).collect()
    assert len(one) == 100 and one == _sample.fitting_sample(rows.repartition(7), 100).collect()
    assert _sample.fitting_sample(rows.limit(60), 100).count() == 60 and _sample.fitting_sample(rows.limit(0), 100).count() == 0


@pytest.mark.parametrize("key", ["1", "7", "12", "cast(null as bigint)"])
def test_sample_of_one_id(spark, key):
    rows = spark.range(5_000).selectExpr(f"{key} as doc_id", "concat('t', id) as text")
    assert _sample.fitting_sample(rows, 100).count() == 100
    assert _sample.fitting_sample(rows.selectExpr("doc_id", "'same' as text"), 100).count() == 1  # repeated rows count once


def test_sample_when_the_estimate_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(_sample, "share_to_cut", lambda n, bound: 1e-6)  # as if of 1e10 rows
    rows = spark.range(3_000).selectExpr("id as doc_id", "concat('t', id) as text")
    assert _sample.fitting_sample(rows, 100).count() == 100


def test_weights_keep_all():
    r = np.random.default_rng(4)
    h = np.unique(r.integers(1, 2**63, 5_000).astype(np.uint64) * np.uint64(2))
    t = _text.Weights(h, np.arange(len(h), dtype=float), bits=10)  # five hashes a slot
    assert (t(h) == np.arange(len(h))).all() and (t.rows(h + np.uint64(1)) == 0).all() and (t.rows(np.zeros(3, np.uint64)) == 0).all()


def test_memory_is_handed_back():
    import pyarrow as pa

    from mergeloom.llm._sample import handed_back

    with handed_back():
        held = pa.array(range(1000))
        del held
    with pytest.raises(ValueError), handed_back():
        raise ValueError
