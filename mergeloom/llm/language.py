"""Language identification by a linear-chain conditional random field over words.

Each word's emission score per language sums the weights of its identity (the lexicon), its first and last bytes (affixes)
and its byte trigrams; a matrix of learned transitions ties neighbours together. Forward-backward gives every
word's distribution, so code-switched text is labelled word by word; a document's language is the one with the
largest share. A text's words are one chain, however long. All chains of a chunk advance together, in blocks of
``BLOCK`` words: each block's steps are first multiplied into one matrix, the products of these give what
comes before and after each block, and from there its words follow.

Labels for training are those of whole documents. As these hardly ever switch, part of the
training chains is joined from halves of two documents, from which the transitions learn what switching costs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._sample import crc_mod, fitting_sample

#: Labelled documents that the model is fitted on, at most, passages taken from each, and words of a passage.
FIT_ROWS = 1_500
FIT_CHAINS = 6
CHAIN = 32
#: Words that advance together, one after the other.
BLOCK = 32
#: Parts of the training passages, of which each round takes one.
PARTS = 4
AFFIX = (2, 3, 4)
TRIGRAM_BITS = 14
ROUNDS = 40
FOLDS = 3
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    hashes: np.ndarray
    weights: np.ndarray  # of the hashes, by label
    trigrams: np.ndarray  # by slot and label
    transitions: np.ndarray
    start: np.ndarray


def trigram_slots(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slot of the three bytes that begin at each byte, lower-cased, with other bytes than letters, and what follows a row, as one."""
    b = np.where(_text.NOT_LETTER, 0, _text.FOLD.astype(np.uint32) + 1).astype(np.uint32)[raw]
    last = at[1:] - 1
    one, two = np.zeros(len(b), np.uint32), np.zeros(len(b), np.uint32)
    one[:-1], two[:-2] = b[1:], b[2:]
    one[last[last >= 0]] = two[last[last >= 0]] = two[last[last >= 1] - 1] = 0
    h = b * np.uint32(2654435761) + one * np.uint32(2246822519) + two * np.uint32(3266489917)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(668265263)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64)


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and lengths of the blocks of rows whose first words are ``row``, and each block's number in its row."""
    n = np.diff(row)
    per = -(-n // BLOCK)
    number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(row[:-1], per) + number * BLOCK
    return first, np.minimum(BLOCK, np.repeat(row[1:], per) - first), number


def emissions(raw: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model, known: _text.Weights) -> np.ndarray:
    """Scores of each word by label."""
    out = np.zeros((len(start), len(model.labels)), np.float32)
    if not len(start):
        return out
    for h in _text.affixes(raw, start, end, AFFIX, AFFIX):
        out += known(h)
    slots = trigram_slots(raw, at)
    size = end - start
    k = 0
    while k < len(start):  # blocks of about a chunk of bytes
        to = max(k + 1, int(np.searchsorted(end, start[k] + _text.CHUNK, "right")))
        ll = size[k:to]
        begin = np.concatenate([[0], np.cumsum(ll)[:-1]])
        where = np.arange(int(ll.sum())) - np.repeat(begin, ll) + np.repeat(start[k:to], ll)
        out[k:to] += np.add.reduceat(model.trigrams[slots[where]], begin, axis=0)
        k = to
    return out


def _times(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The vectors (..., i) times the matrix (i, j), or matrices (..., i, j) each. Sums are in one order, whatever the number of rows."""
    out = a[..., 0, None] * m[..., 0, :]
    for i in range(1, m.shape[-2]):
        out += a[..., i, None] * m[..., i, :]
    return out


def _norm(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(a.sum(axis=-1, keepdims=True), 1e-300)


def forward_backward(e: np.ndarray, row: np.ndarray, model: Model, transitions: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(marginals of each word, expected transitions if asked for, log-partition) of the chains that the rows (first words ``row``) are.

    A row's numbers depend on the row alone, to the last bit."""
    k = e.shape[1]
    if not len(e):
        return np.zeros((0, k)), np.zeros((k, k)) if transitions else None, 0.0
    first, size, number = chains(row)
    top = e.max(axis=1, keepdims=True)
    pot = np.exp((e - top).astype(np.float64))
    trans, begin = np.exp(model.transitions), np.exp(model.start)
    order = np.argsort(-size, kind="stable")
    sizes, firsts = size[order], first[order]
    active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(int(sizes[0]))]  # blocks longer than t
    before, after = np.repeat(begin[None, :], len(first), 0), np.ones((len(first), k))
    deep = int(number.max())
    if deep:  # each block's matrix, then what its neighbours hand on
        m = np.repeat(np.eye(k)[None], len(first), 0)
        lead = number[order] == 0
        for t, n in enumerate(active):
            step = m[:n] if t == 0 else _times(m[:n], trans[None, None])
            if t == 0:
                step = np.where(lead[:n, None, None], step, trans[None])
            step = step * pot[firsts[:n] + t][:, None, :]
            m[:n] = step / np.maximum(step.sum(axis=(1, 2), keepdims=True), 1e-300)
        whole = np.empty_like(m)
        whole[order] = m
        by = np.argsort(number, kind="stable")
        cut = np.searchsorted(number[by], np.arange(deep + 2))
        for d in range(1, deep + 1):
            at = by[cut[d] : cut[d + 1]]
            before[at] = _norm(_times(before[at - 1], whole[at - 1]))
        for d in range(deep, 0, -1):
            at = by[cut[d] : cut[d + 1]]
            after[at - 1] = _norm((whole[at] * after[at][:, None, :]).sum(axis=2))
    alpha, scale = np.zeros((len(e), k)), np.ones(len(e))
    lead, into = (number == 0)[order], before[order]
    for t, n in enumerate(active):
        at = firsts[:n] + t
        a = np.where(lead[:n, None], into[:n], _times(into[:n], trans[None])) if t == 0 else _times(alpha[at - 1], trans[None])
        a = a * pot[at]
        s = a.sum(axis=1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    beta = np.ones((len(e), k))
    beta[first + size - 1] = after
    back = trans.T
    for t in range(len(active) - 2, -1, -1):
        at = firsts[: active[t + 1]] + t
        beta[at] = _times(beta[at + 1] * pot[at + 1] / scale[at + 1][:, None], back[None])
    gamma = _norm(alpha * beta)
    if not transitions:
        return gamma, None, float(np.log(scale).sum() + top.sum())
    inner = np.ones(len(e), bool)
    inner[row[:-1][np.diff(row) > 0]] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * trans[None] * (pot[at] * beta[at])[:, None, :]
    return gamma, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0), float(np.log(scale).sum() + top.sum())


class _words_of:
    """Training passages as words with their features: flat pairs of a word and a feature, by word and by feature."""

    def __init__(self, passages: list[list[str]], gold: np.ndarray) -> None:
        column = pa.array([" ".join(w) for w in passages], pa.large_string())
        rows, kinds, slots, sizes, words = [np.zeros(1, np.int64)], [], [], [], 0
        for _, _, raw, at in _text.chunks(column, 1 << 24):
            start, end, row = _text.words(raw, at, _text.NOT_LETTER)
            kinds.append(_text.affixes(raw, start, end, AFFIX, AFFIX))
            size = end - start
            where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            slots.append(trigram_slots(raw, at)[where])
            sizes.append(size)
            rows.append(row[1:] + words)
            words += len(start)
        self.gold, self.row = gold, np.concatenate(rows)
        self.kinds = [np.concatenate([h[i] for h in kinds]) for i in range(len(kinds[0]))]
        self.slots, self.sizes = np.concatenate(slots), np.concatenate(sizes)

    def index(self, known: _text.Weights, named: int) -> None:
        """Affix features first, then trigram slots."""
        word, feature = [], []
        for h in self.kinds:
            f = known.rows(h)
            word.append(np.flatnonzero(f))
            feature.append(f[f > 0] - 1)
        w = np.concatenate([*word, np.repeat(np.arange(len(self.gold)), self.sizes)])
        f = np.concatenate([*feature, named + self.slots])
        order = np.argsort(w, kind="stable")
        self.word, self.feature = w[order], f[order]
        self.word_cut = np.flatnonzero(np.concatenate([[True], self.word[1:] != self.word[:-1]]))
        by = np.argsort(self.feature, kind="stable")
        f = self.feature[by]
        self.feature_cut = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        self.feature_ids, self.word_of_feature = f[self.feature_cut], self.word[by]
        del self.kinds, self.slots


def fit(texts: list[str], languages: list[str], seed: int = 1) -> Model | None:
    """Maximises the conditional likelihood of training chains by Adam; None without texts."""
    labels = sorted(set(languages))
    if not labels:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    # chains at even distances over each text; some are joined from halves of two documents
    picked: list[tuple[list[str], int]] = []
    for text, language in zip(texts, languages, strict=True):
        words = "".join(c if c.isalpha() else " " for c in text).split()
        n = -(-len(words) // CHAIN)
        for j in sorted({int(i * n / FIT_CHAINS) for i in range(FIT_CHAINS)}) if n else []:
            picked.append((words[j * CHAIN : (j + 1) * CHAIN], labels.index(language)))
    if not picked:
        return None
    sequences, golds = [], []
    for i, (words, label) in enumerate(picked):
        if i % 4 == 3:
            other, second = picked[int(rng.integers(len(picked)))]
            half = int(rng.integers(1, max(2, len(words))))
            tail = other[: CHAIN - half]
            sequences.append(words[:half] + tail)
            golds.append([label] * len(words[:half]) + [second] * len(tail))
        else:
            sequences.append(words)
            golds.append([label] * len(words))
    k = len(labels)
    parts = []
    for part in range(PARTS):
        texts_ = sequences[part::PARTS]
        if texts_:
            parts.append(_words_of(texts_, np.concatenate([golds[i] for i in range(part, len(golds), PARTS)])))
    every, n = np.unique(np.concatenate([h for p in parts for h in p.kinds]), return_counts=True)
    every = every[(n >= 3) & (every != 0)]
    model = Model(labels, every, np.zeros((len(every), k), np.float32), np.zeros((1 << TRIGRAM_BITS, k), np.float32), np.zeros((k, k)), np.zeros(k))
    rows_of = _text.Weights(every, np.arange(len(every)), bits=20)
    for p in parts:
        p.index(rows_of, len(every))
    theta = np.zeros((len(every) + (1 << TRIGRAM_BITS), k), np.float32)
    state = [[np.zeros_like(x, dtype=np.float64) for x in (theta, model.transitions, model.start)] for _ in range(2)]
    for step in range(1, ROUNDS + 1):
        p = parts[step % len(parts)]
        target = np.eye(k)[p.gold]
        first = p.row[:-1][np.diff(p.row) > 0]
        inner = np.ones(len(p.gold), bool)
        inner[first] = False
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (p.gold[np.flatnonzero(inner) - 1], p.gold[inner]), 1)
        e = np.zeros((len(p.gold), k), np.float32)
        e[p.word[p.word_cut]] = np.add.reduceat(theta[p.feature], p.word_cut, axis=0)
        gamma, pairs, _ = forward_backward(e, p.row, model, transitions=True)
        miss = (gamma - target).astype(np.float32)
        grad = np.zeros(theta.shape)
        grad[p.feature_ids] = np.add.reduceat(miss[p.word_of_feature], p.feature_cut, axis=0)
        grads = [grad / len(p.gold) + 1e-7 * theta, (pairs - gold_pairs) / len(p.gold) + 1e-6 * model.transitions, (gamma[first].sum(0) - target[first].sum(0)) / len(first) + 1e-4 * model.start]
        for i, g in enumerate(grads):
            state[0][i] = 0.9 * state[0][i] + 0.1 * g
            state[1][i] = 0.99 * state[1][i] + 0.01 * g**2
            move = 0.1 * (state[0][i] / (1 - 0.9**step)) / (np.sqrt(state[1][i] / (1 - 0.99**step)) + 1e-8)
            if i == 0:
                theta -= move.astype(np.float32)
            elif i == 1:
                model.transitions -= move
            else:
                model.start -= move
    model.weights, model.trigrams = theta[: len(every)], theta[len(every) :]
    live = np.abs(model.weights).max(axis=1) > 1e-3
    model.hashes, model.weights = model.hashes[live], model.weights[live]
    return model


def word_languages(text: str, model: Model) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text."""
    known = _text.Weights(model.hashes, model.weights, bits=20)
    out = []
    for _, _, raw, at in _text.chunks(pa.array([text], pa.large_string())):
        start, end, row = _text.words(raw, at, _text.NOT_LETTER)
        if len(start):
            gamma, _, _ = forward_backward(emissions(raw, at, start, end, model, known), row, model)
            out += [(bytes(raw[s:e]).decode(), model.labels[int(g.argmax())], float(g.max())) for s, e, g in zip(start, end, gamma, strict=True)]
    return out


def shares(column: pa.Array, model: Model, known: _text.Weights) -> np.ndarray:
    """Per row, the share of each label among its words; zeros without words."""
    out = []
    for _, _, raw, at in _text.chunks(column):
        start, end, row = _text.words(raw, at, _text.NOT_LETTER)
        sums = np.zeros((len(row) - 1, len(model.labels)))
        if len(start):
            gamma, _, _ = forward_backward(emissions(raw, at, start, end, model, known), row, model)
            full = np.flatnonzero(np.diff(row))
            sums[full] = np.add.reduceat(gamma, row[full], axis=0) / np.diff(row)[full, None]
        out.append(sums)
    return np.concatenate(out) if out else np.zeros((0, len(model.labels)))


def train(docs: DataFrame, bound: int = FIT_ROWS) -> Model | None:
    """Fits on about ``bound`` documents, at most, that have a text and a lang."""
    rows = fitting_sample(docs.where("text is not null and lang is not null").select("doc_id", "text", "lang"), bound).toArrow()  # at most `bound` rows
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the words, 0 to 1). Rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _text.Weights(model.hashes, model.weights, bits=20) if model else None
        for batch in batches:
            text = batch.column(1)
            share = shares(text, model, known) if model else np.zeros((len(text), 1))
            best, score = share.argmax(axis=1), share.max(axis=1, initial=0.0)
            names = [model.labels[i] if model and s > 0 else UNKNOWN for i, s in zip(best, score, strict=True)]
            for i in np.flatnonzero(score > 0):  # bytes of other symbols pass as letters
                x = text[i].as_py() if _plain(text[i]) else ""
                if x and not any(c.isalpha() for c in x):
                    names[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def _plain(text: pa.Scalar) -> bool:
    """Whether a text has no ASCII letter, so that its letters, if any, are of another script."""
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    return not ((raw | 32) - 97 < 26).any()


def language(docs: DataFrame) -> DataFrame:
    """Predicts the language of each whole text, from its text alone.

    docs: doc_id, text, lang; further columns are ignored. Learns from texts with a lang whose crc32(doc_id as text) modulo 3 isn't
    1 (a null doc_id isn't learned from). Returns doc_id, held_out (that remainder is 1), lang_pred (``und`` if the text is null or has no
    letter, or nothing could be learned) and score. Repeated rows are judged each; ties go to the first label by name.
    An empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(own.where(crc_mod(F.col("doc_id"), FOLDS) != 1))
    return identify(own, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
