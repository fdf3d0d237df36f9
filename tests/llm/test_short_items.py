"""Benchmark items of fewer tokens than a window, inside longer documents."""

import re

from .test_decontamination import kinds


CASES = [
    ("capital of France", "He asked for the capital of France and got no answer.", "exact"),
    ("capital of France", "the capital of a country other than France", None),
    ("capital of France", "capital of", None),
    ("capital of France", "Capital of France", "exact"),
    ("photosynthesis", "How photosynthesis works in plants is shown below.", "exact"),
    ("Solve 3x + 5 = 20", "The task was: solve 3x + 5 = 20 for x.", "exact"),
    ("Solve 3x + 5 = 20", "The task was: solve 7x + 9 = 30 for x.", "reparameterised"),
    ("add 3 and 3", "First add 4 and 5, afterwards add 6 and 6 to that.", "reparameterised"),
    ("add 3 and 3", "First add 4 and 5 to that.", None),
]


def test_short_item(spark):
    got = kinds(spark, [t for _, t, _ in CASES], [i for i, _, _ in CASES])
    assert [got.get((i, i)) for i in range(len(CASES))] == [k for _, _, k in CASES]


def test_short_items_among_long_ones_is_brute_force(spark, docs):
    texts = [r.text for r in docs.limit(60).collect()]
    tok = lambda t: re.findall(r"[0-9]+|[^\W\d_]+", t.lower())
    items = [" ".join(tok(t)[5 : 5 + n]) for t in texts[:20] for n in (1, 2, 3, 4, 9)]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, item in enumerate(items):
        w = tok(item)
        own = grams(w, min(5, len(w))) if w else set()
        want |= {(k, i) for k, t in enumerate(texts) if own and len(own & grams(tok(t), min(5, len(w)))) >= 0.8 * len(own)}
    assert {p for p, kind in kinds(spark, texts, items).items() if kind == "exact"} == want
