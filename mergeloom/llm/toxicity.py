"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence's score is a logistic function of its words and their beginnings; a document is toxic
if any sentence is, so its probability is the noisy-or of theirs. Weights are trained on document labels through
that function: a toxic document only has to explain itself by some sentence, a clean one must have none.
So the sentences that make a document toxic come out as well."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import small_batches, sweep, table
from mergeloom.llm import _text
from mergeloom.llm._sample import crc_mod, fitting_sample, handed_back

#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 10_000
#: Features that the model keeps, at most.
FEATURES = 16_384
PREFIXES = (4, 5, 6, 7, 8)
ROUNDS = 300
FOLDS = 5

_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?\n"]] = 1


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def instances(column: pa.Array) -> Iterator[tuple]:
    """Per chunk: bytes, row offsets, word starts and ends, first word of each row, first word of each sentence,
    first sentence of each row, feature hashes of the words."""
    for _, _, raw, at in _text.chunks(column):
        start, end, row = _text.words(raw, at, _text.NOT_LETTER)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        new = np.zeros(len(start), bool)
        if len(start):
            new[1:] = stops[start[1:]] > stops[end[:-1]]
            new[row[:-1][np.diff(row) > 0]] = True
        first = np.flatnonzero(new)
        yield raw, at, start, end, row, first, np.searchsorted(first, row), _text.affixes(raw, start, end, prefix=PREFIXES)


def telling(texts: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Hashes of the features that toxic documents have most beyond what chance explains, best first."""
    known, counts, done = np.zeros(0, np.uint64), np.zeros((0, 2)), 0
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([known, *[p[0] for p in pending]])
        n = np.concatenate([counts, *[p[1] for p in pending]])
        u, back = np.unique(h, return_inverse=True)
        return u, np.stack([np.bincount(back, n[:, c], len(u)) for c in (0, 1)], 1)

    for _, _, _, _, row, _, _, hashes in instances(texts):
        doc = np.repeat(np.arange(len(row) - 1), np.diff(row))
        h, d = np.concatenate(hashes), np.tile(doc, len(hashes))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, y = h[new], labels[done + d[new]]
        u, back = np.unique(h, return_inverse=True)
        pending.append((u, np.stack([np.bincount(back, y == c, len(u)) for c in (0, 1)], 1)))
        done += len(row) - 1
        if len(pending) == 8:
            known, counts = merge()
            pending = []
    known, counts = merge()
    total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    share = counts.sum(1) / total.sum()
    z = (counts[:, 1] / total[1] - counts[:, 0] / total[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / total).sum())
    good = np.flatnonzero((known != 0) & (counts.sum(1) >= max(3, total[1] / 200)) & (z > 4))
    return known[good[np.argsort(-z[good], kind="stable")][:FEATURES]]


def fit(texts: pa.Array, labels: np.ndarray) -> Model | None:
    """Trains on documents with labels 0 or 1; None unless both occur."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return None
    hashes = telling(texts, labels)
    rows = _text.Weights(hashes, np.arange(len(hashes), dtype=np.float64))
    feature, sentence, doc, sentences = [], [], [], 0
    docs = 0
    for _, _, _, _, row, first, first_of_row, found in instances(texts):
        of_word = np.repeat(np.arange(len(first)), np.diff(np.append(first, row[-1])))
        for h in found:
            k = rows.rows(h)
            feature.append(k[k > 0] - 1)
            sentence.append(sentences + of_word[k > 0])
        doc.append(docs + np.repeat(np.arange(len(row) - 1), np.diff(first_of_row)))
        sentences += len(first)
        docs += len(row) - 1
    f, s, d = np.concatenate(feature), np.concatenate(sentence), np.concatenate(doc)
    w, b = np.full(len(hashes), 0.5), -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):  # Adam on the whole sample
        z = np.bincount(s, w[f], sentences) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(d, -np.logaddexp(0, np.clip(z, -30, 30)), docs)  # log-probability that no sentence is toxic
        pull = np.where(labels == 1, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), -1.0)
        grad_z = -p * pull[d] / docs
        grad = np.append(np.bincount(f, grad_z[s], len(w)) + 1e-5 * w, grad_z.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(hashes, w, float(b))


def sentence_scores(column: pa.Array, model: Model, least: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Noisy-or of each row's sentences, and the sentences whose own score is at least ``least``."""
    table_ = _text.Weights(model.hashes, model.weights)
    scores, spans = [], []
    for raw, at, start, end, row, first, first_of_row, found in instances(column):
        per_word = sum(table_(h) for h in found)
        z = np.add.reduceat(per_word, first) + model.bias if len(first) else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
        scores.append(-np.expm1(-(total[first_of_row[1:]] - total[first_of_row[:-1]])))
        p = 1 / (1 + np.exp(-z))
        bad = np.flatnonzero(p >= least)
        points = _text.code_points(raw) if len(bad) else None
        own: list[list[dict]] = [[] for _ in range(len(row) - 1)]
        last = np.append(first[1:], row[-1]) - 1 if len(first) else first
        for k in bad:
            r = int(np.searchsorted(first_of_row, k, "right")) - 1
            zero = points[at[r]]
            own[r].append({"start": int(points[start[first[k]]] - zero), "end": int(points[end[last[k]]] - zero), "score": float(p[k])})
        spans += own
    return np.concatenate([*scores, np.zeros(0)]), spans


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model | None:
    """Fits on ``bound`` different labelled documents, at most. docs: doc_id, text; labels: doc_id, toxic."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(fitting_sample(own, bound)), "doc_id")  # at most `bound` labels
    return _fitted(labelled, bound)


def _fitted(labelled: DataFrame, bound: int) -> Model | None:
    """Fits in one task, so that the driver gets only the model: neither the sample's texts nor their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with handed_back():
            model = _fitted_here(list(batches))
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (model.hashes, model.weights)] + [pa.array([model.bias])], names=["hashes", "weights", "bias"])

    sample = fitting_sample(labelled.select("doc_id", "text", "toxic"), bound)  # at most `bound` rows
    sweep(labelled.sparkSession.sparkContext)
    rows = small_batches(sample.coalesce(1)).mapInArrow(run, "hashes binary, weights binary, bias double").collect()
    return Model(np.frombuffer(rows[0].hashes, np.uint64), np.frombuffer(rows[0].weights), rows[0].bias) if rows else None


def _fitted_here(batches: list[pa.RecordBatch]) -> Model | None:
    if not batches:
        return None
    rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    batches.clear()
    return fit(rows.column("text").combine_chunks(), rows.column("toxic").to_numpy() > 0)


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1) and offending (sentences of at least ``least``: start and end in code points, score).

    Columns of these names that ``docs`` has are replaced. Repeated rows score alike; an empty table stays empty.
    A null or empty text has no sentences and scores 0; without a model everything does. Rows stay where they are."""
    docs = docs.drop("score", "offending")
    kinds = "score double, offending array<struct<start: long, end: long, score: double>>"
    schema = docs.schema
    names = [f.name for f in schema.fields]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            p, spans = sentence_scores(text, model, least) if model else (np.zeros(len(text)), [[]] * len(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(spans, kind)], names=[*names, "score", "offending"])

    out = type(schema)([*schema.fields])
    for f in type(schema).fromDDL(kinds).fields:
        out = out.add(f)
    return small_batches(docs).mapInArrow(run, out)


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score at least ``threshold``. Rows stay where they are.

    Null and empty texts score 0. Repeated rows go or stay together; without a model, or rows, nothing changes. Other columns may have any name."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sentence_scores(batch.column(at), model, 2.0)[0] < threshold)) if model else batch

    return small_batches(docs).mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: bool = True, threshold: float = 0.5) -> DataFrame:
    """Scores each whole text for toxicity.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; null: none; of repeated ones the largest). Further columns are ignored.
    With ``held_out``, labels of documents whose crc32(doc_id as text) modulo 5 is 0 aren't learned from, and are marked. Returns
    doc_id, held_out, score, predicted and offending (sentence spans). Null and empty texts score 0. A null doc_id is
    scored too and isn't held out. Repeated rows are scored each. Without labels of both kinds all score 0. An
    empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    if held_out:
        marks = marks.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    model = train(own, marks)
    return score(own, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "offending"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
