"""Operators on small inputs: brute force, boundaries and known answers."""

import random

import pytest
from pyspark.sql import functions as F

from mergeloom.functions.components import connected_components
from mergeloom.functions.geo import absent, haversine_km
from mergeloom.functions.hashing import frequency_hash, sign_hash
from mergeloom.operators import ballot, cascade, evidence, fusion, places, planning
from mergeloom.operators.similarity import hamming_edges, hamming_join, nearest_by_time
from mergeloom.operators.survivors import guarded_edges


@pytest.fixture(scope="module")
def hashes(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(8)] + base[:3]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    return rows, spark.createDataFrame(rows, "id long, h long").cache()


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 8, 12])
def test_hamming_join_is_brute_force(hashes, radius):
    rows, df = hashes
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {(a, b, bits(x, y)) for a, x in rows for b, y in rows if a < b and bits(x, y) <= radius}
    assert {tuple(r) for r in hamming_join(df, "id", "h", radius).collect()} == want
    edges = hamming_edges(df, "id", "h", radius).collect()
    assert len({(r.u, r.v) for r in edges}) == len(edges) and roots([(r.u, r.v) for r in edges]) == roots([(a, b) for a, b, _ in want])


def exploded_broadcasts(df):
    """Lines below a broadcast in the plan that ``df`` ran with, or began with, where rows are multiplied."""
    df.collect()
    found, within = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if within is not None and depth <= within:
            within = None
        if "BroadcastExchange" in line and within is None:
            within = depth
        if within is not None and "Generate explode" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("make", [hamming_join, hamming_edges])
def test_hamming_join_broadcasts_no_keys(hashes, make):
    assert not exploded_broadcasts(make(hashes[1], "id", "h", 12))


def test_hamming_join_with_nothing(spark):
    assert hamming_join(spark.createDataFrame([], "id long, h long"), "id", "h", 4).count() == 0
    assert hamming_join(spark.createDataFrame([(1, None), (2, None)], "id long, h long"), "id", "h", 4).count() == 0


def roots(edges):
    p = {}
    find = lambda x: x if p.setdefault(x, x) == x else find(p[x])
    for a, b in edges:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(p)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], [(1, i) for i in range(2, 60)] + [(100, i) for i in range(30, 90)], [(i, i + 1) for i in range(100)] + [(3, None)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = {k: v for k, v in roots([e for e in edges if None not in e]).items() if k != v}
    assert {r.node: r.root for r in got.collect()} == want


def test_guard_keeps_undated_from_bridging(spark):
    rows = [(1, "h", "mon"), (2, "h", None), (3, "h", "tue"), (4, "h", "mon"), (5, None, "mon"), (6, "k", None), (7, "k", "x")]
    got = guarded_edges(spark.createDataFrame(rows, "id long, h string, m string"), "id", "h", "m")
    assert {(r.u, r.v) for r in got.collect()} == {(1, 2), (2, 3), (1, 4), (6, 7)}


def test_strict_outcome_order(spark):
    rows = [("a", "b", 1.0, 1.0, False, 1.0, 1.0), ("a", "a", 1.0, 1.5, False, 0.0, 0.0), ("a", None, 1.0, 1.0, True, 0.0, 0.0), ("a", None, None, 1.0, False, None, None), ("a", "a", 1.0, 1.0, False, 5.0, 1.0), ("a", "a", 1.0, 1.0, False, 4.0, 4.0), (None, None, 1.0, 1.02, False, 12.0, 12.0)]
    df = spark.createDataFrame(rows, "ma string, mb string, sa double, sb double, flat boolean, hi double, lo double")
    out = df.select(cascade.strict_outcome(*[F.col(c) for c in df.columns], 2.0, 4.0).alias("o"))
    assert [r.o for r in out.collect()] == ["burst", "reject", "unverifiable", "unverifiable", "reject", "confirm", "review"]


def test_lenient_outcome(spark):
    shape = "gh double, km double, cam boolean, gs double, sh boolean, like double, flat boolean, tile double, near boolean, inl int"
    rows = [
        (25.0, None, None, None, True, 1.0, False, None, True, 99), (1.0, 6.0, None, None, True, 1.0, False, None, True, 99), (0.0, 0.0, True, 2.0, True, 0.99, False, None, True, 0), (0.0, 0.0, True, 1.0, True, 0.5, False, None, True, 0),
        (None, None, False, None, True, 0.99, True, 11.0, True, 0), (None, None, False, None, True, 0.99, True, 9.0, True, 0), (None, None, None, None, True, 0.95, False, None, True, 0), (None, None, None, None, False, 0.5, False, None, False, 30),
        (None, None, None, None, True, 0.5, False, None, True, 30), (None, None, None, None, False, 0.96, False, None, False, 3), (None, None, None, None, None, 0.1, None, None, False, None),
    ]
    df = spark.createDataFrame(rows, shape)
    out = [r.o for r in df.select(cascade.lenient_outcome(*[F.col(c) for c in df.columns]).alias("o")).collect()]
    assert out == ["REJECT", "REJECT", "CONFIRM", "BURST", "REJECT", "CONFIRM", "CONFIRM", "REVIEW", "CONFIRM", "REVIEW", "REJECT"]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0, 5.0], [2.0, 2.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(cascade.mean_difference(F.col("a"), F.col("b")).alias("m"), cascade.shrink(F.col("a"), 2, 2).alias("s"), cascade.worst_tile(F.col("a"), F.col("b"), 2, 2).alias("w"), cascade.deviation(F.col("b")).alias("d"), sign_hash(F.col("a"), 3).alias("h")).first()
    assert (r.m, r.s, r.w, r.d, r.h) == (1.25, [1.5, 3.0], 2.0, 0.5, 0b101)


def test_frequency_hash_is_stable_under_brightness(spark):
    rnd = random.Random(3)
    grid = [float(rnd.randrange(256)) for _ in range(1024)]
    df = spark.createDataFrame([(grid,), ([x + 9 for x in grid],), ([1.0],), (None,)], "g array<double>")
    a, b, c, d = [r.h for r in df.select(frequency_hash(F.col("g")).alias("h")).collect()]
    assert len(a) == 32 and a[1:] == b[1:] and c is None and d is None


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        ([(1000, "exif", 0.9), (1060, "filename", 0.5)], (1000, "exif", "agreed", 0)),
        ([(0, "filename", 0.5), (3600 * 8, "exif", 0.9)], (3600 * 8, "exif", "tz_resolved", 1)),
        ([(0, "filename", 0.5), (75, "exif", 0.9)], (75, "exif", "tz_resolved", 1)),
        ([(0, "filename", 0.5), (3600 + 91, "exif", 0.9)], (0, "filename", "soft_conflict", 1)),
        ([(0, "filename", 0.5), (3600 * 15, "exif", 0.9)], (0, "filename", "soft_conflict", 1)),
        ([(0, "filename", 0.5), (3600 * 25, "exif", 0.9), (3600 * 26, "google_json", 0.9)], (0, "filename", "date_conflict", 2)),
        ([(0, "exif", 0.9), (10, "quicktime", 0.9), (20, "xmp", 0.95)], (20, "xmp", "agreed", 0)),
    ],
)
def test_resolve_time(spark, claims, want):
    df = spark.createDataFrame([("x", *c) for c in claims], "item string, t long, source string, confidence double")
    r = fusion.resolve_time(df, "item", "t", "source", "confidence").first()
    assert (r.t, r.source, r.note, r.competing) == want


def test_nearest_by_time_prefers_earlier(spark):
    rows = spark.createDataFrame([(1, "u", 10), (2, "u", 0), (3, "v", 5)], "id long, u string, t long")
    anchors = spark.createDataFrame([("u", 5, "b"), ("u", 15, "a"), ("u", 5, "a")], "u string, t long, z string")
    got = {r.id: (r.a_t, r.a_z, r.gap) for r in nearest_by_time(rows, anchors, "t", ["z"], ["u"]).collect()}
    assert got == {1: (5, "a", 5), 2: (5, "a", 5), 3: (None, None, None)}


def test_nearest_place_wraps_around(spark):
    p = spark.createDataFrame([("east", 0.0, 179.9, 5), ("far", 0.0, 178.0, 50)], "place string, lat double, lon double, population long")
    got = places.nearest_place(spark.createDataFrame([(1, 0.0, -179.9), (2, 50.0, 0.0)], "id long, lat double, lon double"), p, "id").collect()
    assert {r.id: r.place for r in got} == {1: "east", 2: None}


def test_distances(spark):
    df = spark.createDataFrame([(1.35, 103.99, 2.74, 101.7)], "a double, b double, c double, d double")
    assert abs(df.select(haversine_km(*[F.col(c) for c in "abcd"]).alias("k")).first().k - 298) < 3
    gone = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (91.0, 1.0), (1.0, 0.0)], "a double, b double").select(absent(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in gone.collect()] == [True, True, True, False]


def test_centre_crosses_the_date_line(spark):
    df = spark.createDataFrame([(1, 0.0, 179.5), (1, 0.0, -179.5)], "k long, lat double, lon double")
    r = places.centres(df, ["k"], 100.0).first()
    assert abs(abs(r.c_lon) - 180) < 1e-6 and r.fixes == 2


@pytest.mark.parametrize(("wall", "instant", "want"), [(7200, 0, 7200), (7319, 0, 7200), (7321, 0, None), (-50400, 0, None), (50400, 0, 50400), (20700 - 120, 0, 20700)])
def test_rounded_offset(spark, wall, instant, want):
    assert spark.range(1).select(places.rounded_offset(F.lit(wall), F.lit(instant)).alias("o")).first().o == want


def test_names(spark):
    names = {
        "IMG_20180601_101112.jpg": ("datetime_local", 1527847872), "IMG-20180601-WA0007.jpg": ("datetime_local", 1527811200), "2018-06-01 10.11.12.png": ("datetime_local", 1527847872), "FB_IMG_1527847932000.jpg": ("datetime_utc", 1527847932),
        "IMG_19001301_999999.jpg": None, "DSC_0042.jpg": None, "notes 20199999.txt": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", evidence.filename_time(F.col("n"), 2025).alias("t"))
    assert {r.n: r.t and (r.t.kind, r.t.t) for r in df.collect()} == names
    stems = {
        "original_0b3e7c1a-1111-2222-3333-444455556666_IMG_1-edited(2).JPG": "img_1-edited", "a-EFFECTS-edited.jpg": "a", "b~3.mp.jpg": "b~3", "c.mp.jpg": "c",
        "a-edited-EFFECTS-edited.jpg": "a-edited", "IMG_1 (2).jpg": "img_1", "x-edited-edited.png": "x-edited",
    }
    got = spark.createDataFrame([(n,) for n in stems], "n string").select("n", evidence.capture_stem(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == stems


def test_coordinates(spark):
    texts = {"48.5, -2.25": (48.5, -2.25), "48.5°N 2.25°W": (48.5, -2.25), "10°30'0\"S 20°15'36\"E": (-10.5, 20.26), "0, 0": None, "95, 3": None, "here": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", evidence.coordinate(F.col("t")).alias("p")).collect()
    assert {r.t: r.p and (round(r.p.lat, 6), round(r.p.lon, 6)) for r in got} == texts


def test_ballot_ties_and_margin(spark):
    df = ballot.candidates(spark.createDataFrame([("d",)], "day string")).withColumn("s", F.when(F.col("cand") == 2.0, 0.9).when(F.col("cand").isin(3.0, 1.0), 0.5)).withColumn("n", F.lit(None).cast("double"))
    got = [(r.cand, r.place, r.clear) for r in ballot.rank(df, ["day"], ["s", "n"]).orderBy("place").collect()]
    assert got == [(2.0, 1, True), (1.0, 2, True), (3.0, 3, True)]


def test_plans(spark):
    df = spark.createDataFrame([("/a/./b//c/../d/", "=1", 'x,"y"')], "p string, q string, r string")
    r = df.select(planning.canonical_root(F.col("p")).alias("p"), planning.csv_field(F.col("q"), True).alias("q"), planning.csv_field(F.col("r")).alias("r")).first()
    assert tuple(r) == ("/a/b/d", "'=1", '"x,""y"""')
