"""Document quality by hierarchical empirical Bayes.

A document classifier, trained on labels, turns the shape of a text into evidence: a logit relative to the
overall rate. Sites add a prior: labels are counted by host and by path within a host, hosts shrink toward the global rate
and paths toward their host, by as much as the spread between them says (moments, from grouped sums). So a site
with few labels says nearly nothing and one with many says what it shows. A document's own
label is left out of its site's counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import cut, small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._sample import crc_mod, fitting_sample

#: Labelled documents that the classifier is fitted on, at most.
FIT_ROWS = 10_000
BINS = 12
FOLDS = 5

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in ",.;:!?'\"-()" else 5 if _c in " \t\r\n\f\v" else 6
NAMES = ["words", "mean word", "long words", "short words", "capital letters", "digits", "punctuation", "symbols", "punctuated words", "distinct words", "distinct lines", "words a line", "stops", "common words"]


def shape(column: pa.Array) -> np.ndarray:
    """A row of numbers per text (NAMES); all but the first are shares or means. Zeros for empty texts."""
    out = []
    for _, _, raw, at in _text.chunks(column):
        n = len(at) - 1
        start, end, row = _text.words(raw, at)
        words = np.diff(row)
        size = end - start
        per = np.maximum(words, 1)
        total = np.maximum(np.diff(at), 1)
        kinds = np.zeros((n, 7))
        for k in range(7):
            c = np.concatenate([[0], np.cumsum(_CLASS[raw] == k)])
            kinds[:, k] = c[at[1:]] - c[at[:-1]]

        def summed(x: np.ndarray, row: np.ndarray = row) -> np.ndarray:
            c = np.concatenate([[0.0], np.cumsum(x)])
            return c[row[1:]] - c[row[:-1]]

        last = _CLASS[raw[end - 1]] if len(end) else np.zeros(0, np.int64)
        h = _text.hash_spans(raw, start, end)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)], float)
        newline = np.zeros(256, bool)
        newline[10] = True
        ls, le, lrow = _text.words(raw, at, newline)
        lh = _text.hash_spans(raw, ls, le)
        lines = np.maximum(np.diff(lrow), 1)
        dlines = np.array([len(np.unique(lh[a:b])) for a, b in zip(lrow[:-1].tolist(), lrow[1:].tolist(), strict=True)], float)
        # the share of words that are among the row's most repeated tenth or so: running text repeats short words
        stops = summed(((raw[end - 1] == 46) | (raw[end - 1] == 33) | (raw[end - 1] == 63)).astype(float)) if len(end) else np.zeros(n)
        out.append(
            np.stack(
                [
                    np.log1p(words), summed(size) / per, summed(size > 9) / per, summed(size < 4) / per, kinds[:, 2] / total, kinds[:, 3] / total, kinds[:, 4] / total, kinds[:, 6] / total,
                    summed(last >= 4) / per, distinct / per, dlines / lines, np.log1p(words / lines), stops / per, summed((size >= 2) & (size <= 3)) / per,
                ],
                1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    rate: float


def _cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], "right") + i * (BINS + 1) for i, e in enumerate(edges)], 1)


def fit(x: np.ndarray, labels: np.ndarray) -> Model | None:
    """A logistic regression on quantile bins of the shape; None unless both labels occur."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    cells = _cells(x, edges)
    one = np.zeros((len(y), x.shape[1] * (BINS + 1) + 1))
    one[np.arange(len(y))[:, None], cells] = 1
    one[:, -1] = 1
    w = np.zeros(one.shape[1])
    ridge = np.full(len(w), 1.0)
    ridge[-1] = 1e-6
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag(ridge), one.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(edges, w[:-1], float(w[-1]), float(y.mean()))


def evidence(column: pa.Array, model: Model | None) -> np.ndarray:
    """Logit of each text's chance to be good, less that of the overall rate."""
    if model is None:
        return np.zeros(len(column))
    z = model.weights[_cells(shape(column), model.edges)].sum(1) + model.bias
    return z - np.log(model.rate / (1 - model.rate))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many labels the prior of a level is worth: from the spread of the group rates (n, k) around ``mean``.

    By moments: the weighted squares of the deviations exceed what binomial noise explains by the variance between groups."""
    n, rate = F.col("n"), F.col("k") / F.col("n")
    r = groups.where("n > 0").agg(
        F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count(F.lit(1)).alias("g"), F.sum(n * (rate - mean) * (rate - mean)).alias("q"), F.sum(n * mean * (1 - mean)).alias("v")
    ).first()
    if not r["n"] or r["g"] < 2 or not r["v"]:
        return 100.0
    noise = r["v"] / r["n"]
    between = max((r["q"] - r["g"] * noise) / max(r["n"] - r["nn"] / r["n"], 1e-9), 1e-6)
    return min(max(noise / between - 1, 1.0), 10_000.0)


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", held_out: bool = True, threshold: float = 0.5, bound: int = FIT_ROWS) -> DataFrame:
    """Each document's chance to be of good quality, and whether to keep it.

    docs: doc_id, text, and the columns named by ``host`` and ``path``; labels: doc_id, quality (0 or 1; null: none; of repeated ones
    the largest). Further columns are ignored. With ``held_out``, labels of documents whose crc32(doc_id as text) modulo 5 is 0
    aren't learned from. Returns doc_id, host, path, held_out, evidence, site (the prior that the site gives), score and keep.
    A null or empty text is judged by its shape, like others; null hosts or paths are sites of their own. Without labels of both kinds
    all evidence is 0 and the prior is the rate, or a half. Repeated rows are scored each. An empty table gives no rows."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    if held_out:
        marks = marks.where(crc_mod(F.col("doc_id"), FOLDS) != 0)
    labelled = own.select("doc_id", "text").join(F.broadcast(fitting_sample(marks, bound)), "doc_id")  # at most `bound` labels
    sample = fitting_sample(labelled, bound).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])  # at most `bound` rows
    y = sample.column("y").to_numpy() > 0
    model = fit(shape(sample.column("text").combine_chunks()), y) if len(y) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(evidence(batch.column(1), model), pa.float64())], names=["doc_id", "host", "path", "evidence"])

    rows = own.mapInArrow(run, "doc_id long, host string, path string, evidence double")
    counted = own.select("doc_id", "host", "path").join(marks, "doc_id")
    paths = cut(counted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")))  # read four times below
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (whole["k"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    s0 = _strength(hosts, F.lit(rate))
    up = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("k").alias("hk"))
    sites = paths.join(up, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    s1 = _strength(sites, (F.lit(s0 * rate) + F.col("hk")) / (s0 + F.col("hn")))

    # every site of the documents, with its counts: those of paths without labels come from the host alone
    every = own.select("host", "path").distinct()
    h, p = up.withColumnRenamed("h", "host_"), paths.select(F.col("host").alias("h2"), F.col("path").alias("p2"), F.col("n").alias("pn"), F.col("k").alias("pk"))
    site = (
        every.join(h, F.col("host").eqNullSafe(F.col("host_")), "left").join(p, F.col("host").eqNullSafe(F.col("h2")) & F.col("path").eqNullSafe(F.col("p2")), "left")
        .select(F.col("host").alias("sh"), F.col("path").alias("sp"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hn", "hk", "pn", "pk")])
    )
    full = rows.join(marks.withColumnRenamed("doc_id", "marked"), F.col("doc_id") == F.col("marked"), "left").join(site, F.col("host").eqNullSafe(F.col("sh")) & F.col("path").eqNullSafe(F.col("sp")), "left")
    mine, label = F.col("y").isNotNull().cast("int"), F.coalesce("y", F.lit(0))
    at_host = (F.lit(s0 * rate) + F.col("hk") - label) / (F.lit(s0) + F.col("hn") - mine)
    at_site = (F.lit(s1) * at_host + F.col("pk") - label) / (F.lit(s1) + F.col("pn") - mine)
    clipped = F.least(F.greatest(at_site, F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = full.withColumn("site", clipped).withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("site"))))))
    return scored.select(
        "doc_id", "host", "path", F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "evidence", "site", "score", (F.col("score") >= threshold).alias("keep")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
