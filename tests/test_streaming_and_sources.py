import os

from pyspark.sql import functions as F

from mergeloom.sources import files, sinks
from mergeloom.streaming import claims


def test_listing_and_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jpg").write_bytes(b"\xff\xd8\xff\xe0data")
    (tmp_path / "a/empty.jpg").write_bytes(b"")
    (tmp_path / "a/odd.bin").write_bytes(b"zzzz")
    got = {r["name"]: (r["status"], r["reason"], r["kind"]) for r in files.listing(spark, [str(tmp_path)]).collect()}
    assert got == {"x.jpg": ("scanned", None, "image"), "odd.bin": ("skipped", "unknown type", None)}
    js = '{"photoTakenTime":{"timestamp":"1500000000"},"creationTime":{"timestamp":"-5"},"geoDataExif":{"latitude":0.0,"longitude":0.0},"geoData":{"latitude":1.5,"longitude":2.5},"title":"a.jpg","people":[{"name":"A"},{"name":"B"}]}'
    df = spark.createDataFrame([(1, js), (2, "not json"), (3, None)], "id long, j string")
    assert {(r.id, r.field, r.value, r.confidence) for r in files.sidecar_claims(df, "id", "j").collect()} == {(1, "datetime_utc", "1500000000", 0.9), (1, "gps", "1.5000000,2.5000000", 0.85), (1, "original_filename", "a.jpg", 1.0), (1, "people", "A, B", 1.0)}


def test_places(spark, tmp_path):
    rows = ["# comment", "Paris\tFR\tIDF\t48.8\t2.3\t2000000\tEurope/Paris\tparis", "Parisot\tFR\tOcc\t44.2\t1.8\t500\tEurope/Paris\tparisot", "Évry\tFR\tIDF\t48.6\t2.4\t50000\tEurope/Paris\tevry"]
    (tmp_path / "p.tsv").write_text("\n".join(rows))
    g = files.places(spark, str(tmp_path / "p.tsv"))
    assert [r.place for r in files.search_places(g, "paris").collect()] == ["Paris", "Parisot"]
    assert [r.place for r in files.search_places(g, "EVRY").collect()] == ["Évry"] and files.search_places(g, "p").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "canonical", "/a"), (1, "duplicate", "/c"), (1, "duplicate", "/b")], "group_id long, role string, path string")
    assert sinks.manifest(df).first().manifest == '{"keep":"/a","companions":[],"drop":["/b","/c"],"review":[]}'
    sinks.write_report(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
    sinks.save_version(df, str(tmp_path / "v"), 1)
    assert sinks.changed_rows(df, df.where("path <> '/b'")).collect()[0].side == "before"


def write_events(spark, folder, batches):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(folder)
        del i


def test_streams_give_what_batches_give(spark, tmp_path):
    folder = str(tmp_path / "in")
    one = [(1, "2024-01-01 00:00:00", 1, "a", 1.0, ""), (2, "2024-01-01 00:00:30", 1, "a", 1.0, ""), (3, "2024-01-01 00:05:00", 1, "a", 1.0, "")]
    write_events(spark, folder, [one, [(3, "2024-01-01 00:05:00", 1, "a", 1.0, ""), (4, "2024-01-01 00:00:10", 1, "b", 1.0, "")], [(5, "2024-01-02 00:00:00", 2, "b", 1.0, "")]])
    got = []
    claims.drain(claims.ingest(claims.event_stream(spark, folder), "event_id", "ts"), str(tmp_path / "c1"), lambda b, n: got.extend(r.event_id for r in b.collect()))
    assert sorted(got) == [1, 2, 3, 4, 5]
    # a restart takes nothing twice
    claims.drain(claims.ingest(claims.event_stream(spark, folder), "event_id", "ts"), str(tmp_path / "c1"), lambda b, n: got.extend(r.event_id for r in b.collect()))
    assert len(got) == 5
    best = {}
    claims.drain(claims.earliest(claims.event_stream(spark, folder), "user_id", "ts", "event_type"), str(tmp_path / "c2"), lambda b, n: best.update({r.user_id: (r.t, r.source) for r in b.collect()}), "update")
    assert best[1][1] == "a" and set(best) == {1, 2}
    state, out = str(tmp_path / "s"), str(tmp_path / "o")
    claims.regroup(claims.event_stream(spark, folder), str(tmp_path / "c3"), state, lambda d: d.groupBy("user_id").agg(F.count_distinct("event_id").alias("n")), out)
    assert {r.user_id: r.n for r in spark.read.parquet(out).collect()} == {1: 4, 2: 1}
    batch = spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in claims.sessions(batch.dropDuplicates(["event_id"]), ["user_id"], "ts").collect()) == [1, 1, 3]
    assert claims.interval_join(batch, batch.withColumnRenamed("event_id", "other"), "user_id", "ts", 30).where("event_id < other").count() == 3
