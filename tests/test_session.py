"""Checkpoints are right while the driver is swept, which happens at most once in a while."""

from __future__ import annotations

from mergeloom.functions import session


def test_cut_sweeps_once_in_a_while(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(session, "_swept", 0.0)
    monkeypatch.setattr(session.gc, "collect", lambda: seen.append(1))
    rows = spark.range(7)
    for _ in range(3):
        rows = session.cut(rows.selectExpr("id + 1 AS id"))
    assert sorted(r.id for r in rows.collect()) == list(range(3, 10))
    assert len(seen) == 1


def test_sweep_trims_the_native_heap(spark, monkeypatch):
    seen, trim = [], session.trim
    monkeypatch.setattr(session, "_swept", 0.0)
    monkeypatch.setattr(session, "trim", lambda sc: seen.append(trim(sc)))
    session.sweep(spark.sparkContext)
    assert len(seen) == 1
    version = [int(x) for x in spark.sparkContext._jvm.System.getProperty("java.version").split("_")[0].split("-")[0].split(".")]
    assert seen == [True] or version < [17, 0, 9] or not spark.sparkContext._jvm.System.getProperty("os.name").startswith("Linux")
