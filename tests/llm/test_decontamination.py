import random
from collections import Counter

from mergeloom.llm import decontamination as d

from .conftest import prose

ITEM = "Tom has 3 apples and gives 2 kg of rice to Anna. How many apples does Tom have after that, if each weighs 10 g?"


CASES = [
    ("Some words first. " + ITEM + " And then more.", "exact"),
    (ITEM.upper(), "exact"),
    ("Ben has 5 apples and gives 4 kg of rice to Kate. How many apples does Ben have after that, if each weighs 20 g?", "reparameterised"),
    ("Ben has 5 apples and gives 4 kg of rice to Kate. Why many pears do you want before this, when all cost 20 g?", None),
    ("Tom has apples", None), ("", None), (None, None),
]


def kinds(spark, texts, items):
    """(document, item) -> kind, by the classes' members."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    members = [(r.item_id, r.plain_class, r.template_class) for r in d.item_classes(bench).collect()]
    out = {}
    for r in d.decontaminate(docs, bench).collect():
        for item, plain, template in members:
            if r.item_id == (plain if r.kind == "exact" else template):
                out.setdefault((r.doc_id, item), r.kind)
    return out


def test_item(spark):
    got = kinds(spark, [t for t, _ in CASES], [ITEM])
    assert [got.get((i, 0)) for i in range(len(CASES))] == [k for _, k in CASES]


def test_slots_must_be_consistent(spark):
    item = "Tom paid 5 for it and 5 for that and then 5 more for those which Tom and Anna liked when Tom saw 5 of them there"
    good, bad = item.replace("5", "8").replace("Tom", "Ben"), item
    for v in ("11", "12", "13", "14"):
        bad = bad.replace("5", v, 1)
    for v in ("Kim", "Lee", "Zed"):
        bad = bad.replace("Tom", v, 1)
    assert kinds(spark, [good, bad], [item]) == {(0, 0): "reparameterised"}


def test_exchanges_are_one_to_one(spark):
    """Two values of an item don't both become one value of the document."""
    item = "first we add 3 to the sum and then take 4 from the sum and at last we add 3 to it and take 4 from it"
    assert kinds(spark, [item.replace("3", "7").replace("4", "9"), item.replace("3", "7").replace("4", "7")], [item]) == {(0, 0): "reparameterised"}


def test_reparameterised_is_brute_force(spark):
    """Word templates with numbers: every item against every document, in plain Python."""
    r = random.Random(4)
    vocabulary = "take add the sum of pears and then cut it by last from which each shop sold for all".split()
    forms = [[r.choice(vocabulary) if r.random() < 0.8 else f"<{r.randrange(3)}>" for _ in range(24)] for _ in range(6)]
    fill = lambda form, v: " ".join(str(v[int(w[1])]) if w[0] == "<" else w for w in form)
    numbers = lambda: r.sample(range(10, 99), 3)
    items = [fill(f, numbers()) for f in forms for _ in range(3)]
    texts = [fill(f, v) for f in forms for v in (numbers(), numbers(), [7, 7, 7])] + ["so " + fill(f, numbers()) + " thus" for f in forms]
    texts += [fill([w if r.random() < 0.93 else "else" for w in f], numbers()) for f in forms for _ in range(3)]

    def template(text):
        out = []
        for w in text.split():
            if w.isdigit():
                if out and out[-1][0] == "#":
                    out[-1] = ("#", out[-1][1] + " " + w)
                else:
                    out.append(("#", w))
            else:
                out.append((w, None))
        return out

    def holds(text, item):
        t, i = template(text), template(item)
        words = lambda x, a: sum(w != "#" for w, _ in x[a : a + 5])
        shape = lambda x, a: tuple(w for w, _ in x[a : a + 5])
        need = min(3, max(words(i, a) for a in range(len(i) - 4)))
        own = [a for a in range(len(i) - 4) if words(i, a) >= need]
        at = {(a, b) for a in own for b in range(len(t) - 4) if shape(i, a) == shape(t, b)}
        if not at:
            return False
        shift = min({b - a for a, b in at}, key=lambda x: (-len({a for a, b in at if b - a == x}), x))
        line = [(a, b) for a, b in at if abs(b - a - shift) <= 5]
        if len({shape(i, a) for a, _ in line}) < 0.8 * len({shape(i, a) for a in own}):
            return False
        places = {}
        for a, b in sorted(line, key=lambda x: -abs(x[1] - x[0] - shift)):
            for p in range(5):
                if i[a + p][0] == "#":
                    places[a + p] = (i[a + p][1], t[b + p][1])
        n = Counter(places.values())
        best = [{}, {}]
        for k in (0, 1):
            for v in {x[k] for x in n}:
                top = max(c for x, c in n.items() if x[k] == v)
                winners = [x for x, c in n.items() if x[k] == v and c == top]
                if len(winners) > 1:
                    return None  # which of the two is kept may matter
                best[k][v] = winners[0]
        return not n or sum(c for x, c in n.items() if best[0][x[0]] == x == best[1][x[1]]) >= 0.8 * len(places)

    plain = brute(list(enumerate(texts)), list(enumerate(items)))
    want = {(k, i): holds(t, x) for k, t in enumerate(texts) for i, x in enumerate(items) if (k, i) not in plain}
    got = kinds(spark, texts, items)
    assert {p for p, kind in got.items() if kind == "exact"} == plain
    assert {p for p, kind in got.items() if kind == "reparameterised" and want[p] is not None} == {p for p, w in want.items() if w}
    assert sum(w is True for w in want.values()) > 40 and sum(w is None for w in want.values()) < 0.2 * len(want)


def test_many_items_of_one_template(spark):
    """Thousands of items of one form are one class, which gives a document one row."""
    import time

    docs = spark.range(300).selectExpr("id as doc_id", "concat('Ben has ', id + 5, ' apples and gives ', id % 9 + 2, ' kg of rice to Kate. How many apples does Ben have after that, if each weighs ', id * 7 + 20000, ' g?') as text")
    bench = spark.range(20_000).selectExpr("id as item_id", "concat('Tom has ', id + 1000, ' apples and gives ', id + 30000, ' kg of rice to Anna. How many apples does Tom have after that, if each weighs ', id + 60000, ' g?') as text")
    began = time.time()
    got = d.decontaminate(docs, bench).collect()
    assert len(got) == 300 and {(r.kind, r.item_id, r.items) for r in got} == {("reparameterised", 0, 20_000)}
    assert time.time() - began < 120


def test_a_window_that_many_items_share(spark):
    """Items that begin alike and go on differently: the common beginning finds no candidates."""
    words = lambda k: " ".join(f"w{k}q{i}" .replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d").replace("4", "e").replace("5", "f").replace("6", "g").replace("7", "h").replace("8", "i").replace("9", "j") for i in range(12))  # noqa: E731, E501
    items = [f"which of the following answers is right {words(k)}" for k in range(400)]
    texts = [f"which of the following answers is right {prose(k, 30)}" for k in range(40)] + items[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    search = d.Search(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), 0.8)
    assert search.found.where("which < 0").count() == 3 and search.windows.where("lead").join(search.windows.where("lead").groupBy("which", "h").count().where("count > 1"), ["which", "h"]).count() == 0


def brute(docs, items):
    import re

    tok = lambda t: re.findall(r"[0-9]+|[^\W\d_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    own = {i: grams(tok(t)) for i, t in items}
    return {(k, i) for k, t in docs for i, g in own.items() if g and len(g & grams(tok(t))) >= 0.8 * len(g)}


def test_tables(spark, docs, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = d.decontaminate(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.kind == "exact"} == want
    clean = d.without_items(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {r.doc_id for r in got}
    assert d.decontaminate(empty, bench).count() == 0 and d.decontaminate(docs, bench.limit(0)).count() == 0
    marks = spark.createDataFrame([(1, prose(2, 60), 3), (1, prose(2, 60), 3), (2, None, 1), (3, "", 1), (None, "one two three", 0)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in d.decontaminate(odd, marks).collect()}
    assert got == {(5, 1), (6, 1), (7, 1), (4, None)}
    strange = odd.withColumnsRenamed({"node": "text_key0", "rank": "k1"})
    clean = d.without_items(strange, marks)
    assert clean.columns == strange.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, [0, 1, 2, 3, 8, 9, 10, 11, None]))
    assert d.without_items(odd, marks.limit(0)).count() == odd.count() and d.without_items(empty, marks).count() == 0
