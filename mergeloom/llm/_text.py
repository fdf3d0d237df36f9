"""Whole Arrow batches of text as numpy arrays: words, shingles and their hashes.

A batch's UTF-8 bytes are handled in one go, in chunks of whole rows of about
``CHUNK`` bytes, so that memory stays bounded and no Python code runs per word.
A single longer text is a chunk of its own; its bytes are hashed in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
SHINGLE = 5

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words, in which every bit matters to every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's base, modulo 2 ** 64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _BASE))])[:n]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes) of slices of whole rows. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and one past the last) of maximal runs of bytes that aren't space.

    A run ends at the end of its row."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = ~space[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span's bytes after the byte table ``fold``. Spans ascend and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    table = _BYTE[fold]
    k = 0
    while k < len(start):  # blocks of about CHUNK bytes
        to = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, "right")))
        s, size = start[k:to], end[k:to] - start[k:to]
        full = size > 0
        ss, ll = s[full], size[full]
        if len(ss):
            begin = np.concatenate([[0], np.cumsum(ll)[:-1]])
            place = np.arange(int(ll.sum()), dtype=np.int64) - np.repeat(begin, ll)
            where = place + np.repeat(ss, ll)
            value = table[raw[where]] * powers(int(ll.max()))[place]
            got = np.add.reduceat(value, begin)
            out[k:to][full] = got + ll.astype(np.uint64) * _PLACE[63]
        k = to
    return mix(out)


def sequences(h: np.ndarray, row: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``n`` words in a row, and each row's first one (and one past the last).

    ``row`` has each row's first word. A row of fewer words has one hash, of all of them; without words none."""
    count = np.diff(row)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(first[-1]), np.uint64)
    if len(out):
        begin = np.repeat(row[:-1] - first[:-1], per) + np.arange(len(out))
        size = np.repeat(np.minimum(count, n), per)
        for k in range(n):
            inside = k < size
            where = np.minimum(begin + k, len(h) - 1)
            out += np.where(inside, mix(h[where] + _PLACE[k]) * _PLACE[k + 8], np.uint64(0))
        out = mix(out + size.astype(np.uint64))
    return out, first


def shingles(raw: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) word ``n``-shingles of each row, repeated ones too, and each row's first."""
    start, end, row = words(raw, at)
    return sequences(hash_spans(raw, start, end), row, n)


#: All ASCII bytes that aren't letters part words of letters; bytes of other characters belong to words.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: A-Z, and the second bytes of Latin-1 capitals, to lower case. Other scripts are only hashed, so a rare clash is harmless.
FOLD = LOWER.copy()
FOLD[0x80:0x9F] += 0x20
FOLD[0x97] = 0x97


def affixes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: tuple[int, ...] = (), suffix: tuple[int, ...] = (), fold: np.ndarray = FOLD) -> list[np.ndarray]:
    """Hashes of the whole words, then of their first and last so many bytes; 0 for words that aren't longer than that."""
    parts, k = [], 0
    while k < len(start):  # blocks of about CHUNK bytes
        to = max(k + 1, int(np.searchsorted(end, start[k] + CHUNK, "right")))
        parts.append(_affixes(raw, start[k:to], end[k:to], prefix, suffix, fold))
        k = to
    if len(parts) == 1:
        return parts[0]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(1 + len(prefix) + len(suffix))]


def _affixes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: tuple[int, ...], suffix: tuple[int, ...], fold: np.ndarray) -> list[np.ndarray]:
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(int(first[-1]), dtype=np.int64) - np.repeat(first[:-1], size)
    letters = _BYTE[fold][raw[place + np.repeat(start, size)]]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers(int(size.max()))[place])])
    out = [mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * _PLACE[63])]
    for k in prefix:
        got = mix(total[first[:-1] + np.minimum(size, k)] - total[first[:-1]] + _PLACE[40 + k])
        out.append(np.where(size > k, got, np.uint64(0)))
    for k in suffix:
        got = np.full(len(size), _PLACE[50 + k])
        for j in range(1, k + 1):
            got = (got ^ letters[np.maximum(first[1:] - j, 0)]) * _PLACE[20 + j]
        out.append(np.where(size > k, mix(got), np.uint64(0)))
    return out


class Weights:
    """Hash -> row of weights: a table of slots, each of which names its hash.

    Hashes that share a slot with an earlier one are found in a sorted list, which is only searched for slots that have such."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bits: int = 18) -> None:
        self.shift = np.uint64(64 - bits)
        slot = (hashes >> self.shift).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.tag = np.zeros(1 << bits, np.uint64)
        self.tag[slot[first]] = hashes[first]
        self.row = np.zeros(1 << bits, np.int32)
        self.row[slot[first]] = first + 1
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        rest = rest[np.argsort(hashes[rest], kind="stable")]
        self.rest, self.rest_row = hashes[rest], (rest + 1).astype(np.int32)
        self.full = np.zeros(1 << bits, bool)
        self.full[slot[rest]] = True
        self.weights = np.concatenate([np.zeros((1, *weights.shape[1:]), weights.dtype), weights])

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the number of each hash, 0 for unknown ones."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = np.where(self.tag[slot] == hashes, self.row[slot], 0) * (hashes != 0)
        if len(self.rest):
            miss = np.flatnonzero(self.full[slot] & (out == 0))
            h = hashes[miss]
            k = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            out[miss] = np.where((self.rest[k] == h) & (h != 0), self.rest_row[k], 0)
        return out

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights[self.rows(hashes)]


def code_points(raw: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
