import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mergeloom.llm import _text


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\tZ😀", max_size=40), max_size=6))
def test_shingles_tell_sequences_apart(texts):
    got, want = [], []
    for _, _, raw, at in _text.chunks(pa.array(texts, pa.large_string()), 32):
        h, first = _text.shingles(raw, at)
        got += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    for t in texts:
        w = words(t)
        want.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    assert [len(g) for g in got] == [len(w) for w in want]
    flat = [(g, w) for a, b in zip(got, want, strict=True) for g, w in zip(a, b, strict=True)]
    assert len({g for g, _ in flat}) == len({w for _, w in flat}) == len(set(flat))


def test_chunks_cover_slices_and_nulls():
    a = pa.array(["x", None, "yy", "", "zzz"]).slice(1, 4)
    out = [bytes(raw[s:e]).decode() for _, _, raw, at in _text.chunks(a, 2) for s, e in zip(at[:-1], at[1:], strict=True)]
    assert out == ["", "yy", "", "zzz"]


def test_affixes_and_weights():
    raw = np.frombuffer("Hello help held".encode(), np.uint8)
    start, end, _ = _text.words(raw, np.array([0, len(raw)]))
    whole, pre, suf = _text.affixes(raw, start, end, (3,), (2,))
    assert pre[0] == pre[1] == pre[2] != 0 and len(set(whole)) == 3 and len(set(suf)) == 3
    table = _text.Weights(whole[:2], np.array([1.0, 2.0]))
    assert table(whole).tolist() == [1.0, 2.0, 0.0] and table(np.zeros(1, np.uint64)).tolist() == [0.0]
