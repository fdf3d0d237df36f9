"""Queries that must read all rows of their tables: against their SQL, which has no filters, and by counts."""

import random
import subprocess
import sys
from itertools import combinations

import duckdb
import pytest

from mergeloom.operators.fusion import resolve_time, time_pool
from mergeloom.operators.similarity import hamming_edges
from mergeloom.plans import dedup, fusion, places

from .test_operators import exploded_broadcasts
from .test_queries import norm


def agree(query, sql, spark, sf, oracle):
    got, rel = query(spark, sf), oracle.sql(sql)
    assert sorted(rel.columns) == sorted(got.columns)
    names = sorted(got.columns)
    have = sorted(tuple(norm(r[c]) for c in names) for r in got.collect())
    assert have == sorted(tuple(norm(v) for v in (r[rel.columns.index(c)] for c in names)) for r in rel.fetchall())


def test_tag_claims_of_all_orders(spark, sf, oracle):
    agree(fusion.tag_claims, fusion.SQL["tag_claims"], spark, sf, oracle)
    assert fusion.tag_claims(spark, sf).select("o_orderkey").distinct().count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_json_claims_of_all_events(spark, sf, oracle):
    agree(fusion.json_claims, fusion.SQL["json_claims"], spark, sf, oracle)
    assert fusion.json_claims(spark, sf).select("event_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_zone_from_place_of_all_placed_events(spark, sf, oracle):
    """The SQL is brute force: every point against every observation."""
    agree(places.zone_from_place, places.SQL["zone_from_place"], spark, sf, oracle)


def test_frame_match_of_all_equal_durations(spark, sf, oracle):
    agree(dedup.frame_match, dedup.SQL["frame_match"], spark, sf, oracle)


def test_equal_durations_is_brute_force(spark):
    rows = [(i, i % 3 if i % 4 else 7) for i in range(60)]
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and x == y)
    table = spark.createDataFrame(rows, "conv_id long, duration long")
    for block in (1, 4, 1000):
        assert sorted((r.conv_id_a, r.conv_id_b) for r in dedup.equal_durations(table, block).collect()) == want


def test_exact_tiers_of_whole_texts(spark, sf, oracle):
    agree(dedup.exact_tiers, dedup.SQL["exact_tiers"], spark, sf, oracle)


def test_exact_tiers_of_a_common_opening(spark, tmp_path):
    opening = "The same first forty characters of every text: "
    texts = [opening + "one", opening + "two", opening + "  ONE", opening + "two", "other"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.group_id for r in dedup.exact_tiers(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}


def test_claim_time_choice_of_all_items(spark, sf, oracle):
    agree(fusion.claim_time_choice, fusion.SQL["claim_time_choice"], spark, sf, oracle)
    assert fusion.claim_time_choice(spark, sf).count() == fusion._claims(spark, sf).select("item").distinct().count()


def test_time_pool(spark):
    t, h = 1_500_000_000, 3600
    rows = [
        ("only fs", "datetime_utc", t, "fs", 0.1),
        ("with fs", "datetime_utc", t, "exif", 0.8), ("with fs", "datetime_utc", t - 9, "fs", 0.9),
        ("anchored", "datetime_local", t + 2 * h, "exif", 0.5), ("anchored", "utc_offset", 2 * h, "quicktime", 0.9), ("anchored", "utc_offset", h, "xmp", 1.0), ("anchored", "utc_offset", None, "exif", 1.0), ("anchored", "datetime_utc", t + 5, "fs", 0.9),
        ("unanchored", "datetime_local", t, "filename", 0.5),
        ("has instant", "datetime_utc", t + 600, "exif", 0.8), ("has instant", "datetime_local", t, "exif", 0.8),
        ("manual", "datetime_utc", t + 7200, "manual", 1.0), ("manual", "datetime_utc", t + 7200, "exif", 0.8), ("manual", "datetime_local", t, "filename", 0.5),
        ("batch a", "datetime_utc", t + 90_000, "exif", 0.8), ("batch a", "datetime_utc", t + 90_001, "filename", 0.3), ("batch b", "datetime_utc", t + 90_002, "google_json", 0.8),
        ("null atom", "datetime_utc", 0, "exif", 0.8), ("null atom", "datetime_utc", t, "fs", 0.1), ("unread", "datetime_utc", None, "exif", 0.8), ("unread local", "datetime_local", None, "exif", 0.8), ("unread local", "datetime_utc", t, "fs", 0.1),
    ]
    pool = time_pool(spark.createDataFrame(rows, "item string, field string, t long, source string, confidence double"), "item", "field", "t", "source", "confidence", 2)
    got = sorted((r.item, r.t, r.source, round(r.confidence, 6), r.unanchored) for r in pool.collect())
    assert got == sorted([
        ("only fs", t, "fs", 0.1, False), ("with fs", t, "exif", 0.8, False), ("anchored", t, "exif", 0.5, False), ("unanchored", t, "filename", 0.45, True), ("has instant", t + 600, "exif", 0.8, False),
        ("manual", t + 7200, "manual", 1.0, False), ("manual", t, "filename", 0.45, True), ("batch a", t + 90_000, "exif", 0.2, False), ("batch a", t + 90_001, "filename", 0.3, False), ("batch b", t + 90_002, "google_json", 0.2, False),
        ("unread local", t, "fs", 0.1, False),
    ])
    chosen = {r["item"]: r for r in resolve_time(pool, "item", "t", "source", "confidence").collect()}
    assert chosen["only fs"].source == "fs" and chosen["batch a"].source == "filename" and chosen["anchored"].t == t


@pytest.mark.parametrize("name", ["cascade_outcomes", "review_samples", "embedding_hamming"])
def test_vectors_meet_without_a_broadcast_of_keys(spark, sf, name):
    assert not exploded_broadcasts(dedup.QUERIES[name](spark, sf))


def test_radius_sweep_meets_without_a_broadcast_of_keys(spark, sf, monkeypatch):
    met = []
    monkeypatch.setattr(dedup, "hamming_edges", lambda *args: met.append(hamming_edges(*args)) or met[-1])
    assert dedup.radius_sweep(spark, sf).count() == len(dedup.RADII)
    # words of texts are multiplied below a broadcast as well, but added up again: only the keys count
    assert len(met) == 1 and not [line for line in exploded_broadcasts(met[0]) if "struct(own" in line]


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    """Pairs 12 bits apart that agree on two of 14 bands only, each two of them; copies; vectors that are short, empty, null or have nulls."""
    rnd, edges, hashes = random.Random(5), [i * 63 // 14 for i in range(15)], []
    for chosen in combinations(range(14), 2):
        h = rnd.getrandbits(63)
        hashes += [h, h ^ sum(1 << rnd.randrange(edges[i], edges[i + 1]) for i in range(14) if i not in chosen)]
    vectors = []
    for h in hashes + hashes[:6]:
        v = [0.0]
        for i in range(63):
            v.append(v[-1] + (1.0 if h >> i & 1 else -1.0))
        vectors.append(v)
    vectors += [vectors[0][:n] for n in range(0, 65, 4)] + [None, [None] * 64, [None if i % 9 == 0 else x for i, x in enumerate(vectors[1])]]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, db


def test_embedding_hamming_of_odd_vectors(spark, odd_vectors):
    folder, db = odd_vectors
    agree(dedup.embedding_hamming, dedup.SQL["embedding_hamming"], spark, folder, db)
    assert db.sql(f"SELECT count(*) FROM ({dedup.SQL['embedding_hamming']}) WHERE distance = 12").fetchall()[0][0] >= 91


def test_embedding_hamming_in_a_new_session(sf, oracle):
    """The table was read once before, so the query's column is the session's fifth."""
    code = f"""
from pyspark.sql import SparkSession
from mergeloom.plans.dedup import embedding_hamming
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.read.parquet("{sf}/embeddings.parquet")
print("pairs", sorted(tuple(r) for r in embedding_hamming(spark, "{sf}").collect()))
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert f"pairs {sorted(oracle.sql(dedup.SQL['embedding_hamming']).fetchall())}\n" in run.stdout, run.stderr[-2000:]
