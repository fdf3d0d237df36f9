import hashlib

import numpy as np

from mergeloom.llm import fingerprints as fp

from .test_jaccard import shingle_set


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def verify(df, ranges=None):
    rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    got = {}
    for r in fp.fingerprint(df, ranges).collect():
        got.setdefault(r.doc_id, []).append(r)
    errors = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        sha = hashlib.sha256(new.encode()).hexdigest()
        r = next(x for x in got[key] if x.edited_sha256 == sha)
        got[key].remove(r)
        assert r.n_chars == len(text) and r.fingerprint == fp.packed(fp.sketches([text])[0]) and r.edited_fingerprint == fp.packed(fp.sketches([new])[0])
        errors += [r.near_edited - jaccard(text, new), r.near_next - jaccard(text, after)]
    assert not any(got.values())
    return np.array(errors)


def test_documents(docs):
    e = verify(docs)
    assert abs(e.mean()) < 0.01 and np.abs(e).max() < 0.2


def test_odd(odd, empty):
    verify(odd, 3)
    verify(odd.where("doc_id = 3"))
    assert fp.fingerprint(empty).count() == 0


def test_estimate_is_unbiased():
    r = np.random.default_rng(4)
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        n, got = 400, []
        for _ in range(30):
            both = int(n * 2 * share / (1 + share))
            x = r.integers(0, 2**63, 2 * n).astype(np.uint64) * np.uint64(2)
            got.append(fp.likeness(fp.sketch(x[:n]), fp.sketch(np.concatenate([x[:both], x[n : 2 * n - both]]))))
        assert abs(np.mean(got) - share) < 0.02
    assert fp.likeness(None, None) == 1.0 and fp.likeness(None, fp.sketch(np.ones(1, np.uint64))) == 0.0


def test_few_shingles_fill_all_bins():
    one, two = (fp.sketch(np.array([x], np.uint64)) for x in (5, 6))
    assert fp.likeness(one, one) == 1.0 and fp.likeness(one, two) < 0.1 and (fp.unpacked(fp.packed(one)) == one).all()
