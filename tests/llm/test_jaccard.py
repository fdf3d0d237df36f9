import re
from collections import Counter, defaultdict

import pytest

from mergeloom.llm import jaccard

from .conftest import prose


def shingle_set(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(set size, class) by all pairs that share a shingle."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    p = list(range(len(sets)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    inv = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inv[x].append(k)
    for k, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in inv[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                p[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def check(df):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_tables(docs):
    check(docs)


def test_odd(odd, empty):
    check(odd)
    assert jaccard.jaccard_join(empty).count() == 0


@pytest.mark.parametrize("crowd", [2, 64])
def test_near_copies(spark, monkeypatch, crowd):
    """A family of edited copies around one text, a passage that many share, and equal sets; with blocks as small as can be."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    import random

    r = random.Random(5)
    base, passage = prose(9, 120).split(), prose(10, 30)
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + prose(50 + i, r.randrange(6, 40))) for i in range(15)]
    rows += [(200, rows[3][1].upper()), (201, " ".join(base[:100]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_one_of_each(spark, odd, docs, empty):
    keep = jaccard.one_of_each(odd)
    assert keep.columns == odd.columns
    # blank texts stay; of each class the least id, once
    assert sorted((r.doc_id for r in keep.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 8, 10, 11], key=str)
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()])}
    assert {r.doc_id for r in jaccard.one_of_each(docs).collect()} == want
    assert jaccard.one_of_each(empty).count() == 0


def test_summaries_never_exclude_a_link():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (3, 40, 600, 5000):
        a = np.sort(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.sort(np.concatenate([a[n // 10 :], r.integers(0, 2**63, n // 12 + 1).astype(np.uint64)]))
        d = len(np.setxor1d(a, b))
        assert jaccard.apart(jaccard.summary(a), jaccard.summary(b)) <= d
        both = len(np.intersect1d(a, b))
        assert bool(jaccard.enough(d, len(a), len(b), 80)) == jaccard.similar(both, len(a), len(b), 80)


def test_filter_that_lets_copies_through(spark, monkeypatch):
    """Copies of a candidate that come before the one that was asked for must not hide it."""

    class All(jaccard.IdFilter):
        def __call__(self, ids):
            import numpy as np

            return np.ones(len(ids), bool)

    monkeypatch.setattr(jaccard, "IdFilter", All)
    a, b = prose(1, 60), prose(1, 60) + " more words"
    rows = [(9, a), (8, b), (7, a), (6, b), (5, a), (4, b), (3, prose(2, 60))]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))


def test_sets_with_one_half_signature(spark, docs):
    """With four bits of the first half nearly all sets clash and are named by their whole signatures."""
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, bits=4).collect())
    assert got == sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs).collect())
    assert len(jaccard.Join(docs, bits=4).clash) == 16 and not jaccard.Join(docs).clash


def test_a_hot_column_is_linear(spark, docs):
    """20,000 rows of a column: those of one great component meet the others only, not each other."""
    join = jaccard.Join(docs.limit(5))
    rows = spark.range(20_000).selectExpr("7L as token", "id as node", "cast(200 + id % 40 as int) as n", "cast(id % 20 as int) as place", "case when id % 200 = 0 then id else -1 end as comp", "20000L as rows")
    dealt = join.blocks(rows)
    assert dealt.count() < 6 * 20_000  # about five size classes, one or two blocks each
    assert dealt.groupBy("token", "lo", "hi", "i", "j").count().agg({"count": "max"}).first()[0] <= 3 * jaccard.BLOCK
    assert join.blocks(rows.withColumn("comp", rows.comp * 0)).count() == 0
    assert join.blocks(rows.where("node < 2000").drop("rows").selectExpr("*", "2000L as rows")).count() == 2000  # one block


def test_blocks_lose_no_pair(spark, docs, monkeypatch):
    """Of rows in different components that leave room for enough overlap, all pairs meet, whatever the blocks."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    join, r = jaccard.Join(docs.limit(5)), random.Random(2)
    rows = [(1, i, n, r.randrange(0, n - jaccard.required(n, 80) + 1), r.choice([-1, -2, i])) for i, n in enumerate(r.randrange(20, 60) for _ in range(70))]
    rows = [(*x[:4], x[4] if x[4] < 0 else 1000 + x[1]) for x in rows]
    want = {
        (a[1], b[1]) for a in rows for b in rows
        if a[1] < b[1] and a[4] != b[4] and min(a[2] - a[3], b[2] - b[3]) * 180 >= 80 * (a[2] + b[2])
    }
    met = {}
    for x in join.blocks(spark.createDataFrame([(*x, len(rows)) for x in rows], "token long, node long, n int, place int, comp long, rows long")).collect():
        met.setdefault((x.lo, x.hi, x.i, x.j), []).append(x)
    got = Counter(
        (min(x.node, y.node), max(x.node, y.node)) for (lo, hi, i, j), xs in met.items() for k, x in enumerate(xs) for y in xs[:k]
        if x.comp != y.comp and (i == j or (x.own == i) != (y.own == i)) and (lo == hi or x.side != y.side)
    )
    assert want <= set(got) and all(got[p] == 1 for p in want)


def test_frequent_shingles_are_dealt_out(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SPREAD", 2)
    monkeypatch.setattr(jaccard, "LOCAL_LEAST", 1)
    passage = prose(10, 40)
    check(spark.createDataFrame([(i, " ".join(passage.split()[:36]) + f" w{i} x{i}") for i in range(30)] + [(99, passage)], "doc_id long, text string"))


def test_one_of_each_with_clashing_columns(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = spark.createDataFrame([(3, a, 1, 1, 1, 1), (1, a, 2, 2, 2, 2), (2, b, 3, 3, 3, 3), (2, b, 3, 3, 3, 3), (None, b, 4, 4, 4, 4)], "doc_id long, text string, keeps int, rep int, shingle_set int, node int")
    keep = jaccard.one_of_each(rows)
    assert keep.columns == rows.columns and sorted(r.doc_id for r in keep.collect()) == [1, 2]
