import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from mergeloom.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def verify(rows, texts, tokenizer, capacity):
    """Every document comes back whole, and every sequence is full from 0 without gaps or overlaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for key, text in texts.items():
        ids = np.append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4"), np.array([2], "<u4"))
        parts, at = sorted(by_doc[key], key=lambda r: r.piece), 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids) and (len(parts) == 1) == (len(ids) <= capacity)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_documents(spark, docs, tokenizer):
    texts = {r.doc_id: r.text for r in docs.collect()}
    used, total = verify(packing.pack(docs).collect(), texts, tokenizer, 1024)
    assert used <= -(-total // 1024) * 1.02 + 1


def test_odd(spark, odd, empty, tokenizer):
    rows = packing.pack(odd).collect()
    assert packing.pack(empty).count() == 0
    n = Counter(r.doc_id for r in rows if r.piece == 0)
    assert n[5] == 2 and n[None] == 1 and n[0] == 1
    assert [(r.length, r.start) for r in rows if r.doc_id == 0] == [(1, 0)]
    once = [r for r in rows if r.doc_id not in (5, None)]
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (5, None)}
    for key in texts:
        assert sum(r.length for r in once if r.doc_id == key) == len(tokenizer.encode(texts[key] or "", add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("capacity", [16, 100])
def test_small_capacity(spark, docs, tokenizer, capacity):
    some = docs.where("doc_id < 30")
    verify(packing.pack(some, capacity=capacity, groups=8).collect(), {r.doc_id: r.text for r in some.collect()}, tokenizer, capacity)


def test_encoder_is_the_tokenizer(tokenizer):
    encode = packing._encoder(packing.vocabulary())
    texts = ["", " ", "a  b\n\n c\t", "It's 12,345.67 o'clock — “quoted”", "<|endoftext|> x", "日本語 😀 é", "x" * 3000, "ÀÉ ñ\r\nß\xa0y", "\x1c\x85 z", "don't  we'll I'M", "a" * 399 + "1" * 399]
    assert encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_exactly_the_histogram(seed):
    r = random.Random(seed)
    h = {r.randrange(1, 1025): r.randrange(1, 400) for _ in range(r.randrange(1, 300))}
    got = Counter()
    classes = packing.plan(dict(h))
    for lengths, n in classes:
        assert sum(lengths) <= 1024 and n > 0
        for s in lengths:
            got[s] += n
    assert got == h
    rooms, best = Counter(), 0  # best fit decreasing, one by one
    for s in sorted(h, reverse=True):
        for _ in range(h[s]):
            room = min((r for r in rooms if r >= s and rooms[r]), default=None)
            if room is None:
                best, room = best + 1, 1024
            else:
                rooms[room] -= 1
            rooms[room - s] += 1
    assert sum(n for _, n in classes) <= best * 1.02 + 2


def test_plan_of_nothing():
    assert packing.plan({}) == [] and packing.slots([]).shape == (0, 4)
