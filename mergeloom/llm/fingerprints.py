"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle is hashed once; the hash's leading bits name a bin, and a
bin keeps its least hash. An empty bin takes over the value of the bin that comes
first in a random order of its own (optimal densification: each filled bin is as likely, and any two
documents that choose alike agree). Of each value the ``BITS`` low-order bits are kept,
packed into hexadecimal text; the share of agreeing bins is corrected for chance agreement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._order import range_cuts, range_number

BINS = 256
BITS = 8

_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_rng = np.random.Generator(np.random.PCG64(7))
#: _RANK[i, j]: when bin i, being empty, asks bin j for its value.
_RANK = np.argsort(_rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.int16)
#: Per bin, so that bins which took over the same value agree by chance independently.
_SALT = _rng.integers(0, 2**63, BINS, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """The low-order bits of every bin; None without shingles."""
    if not len(hashes):
        return None
    hashes = np.sort(hashes)
    bins = (hashes >> _SHIFT).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    full = bins[first]
    value = np.zeros(BINS, np.uint64)
    value[full] = least = hashes[first]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        value[empty] = least[_RANK[np.ix_(empty, full)].argmin(axis=1)]
    return (_text.mix(value ^ _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, 0 to 1. Two documents without shingles are alike, one without is unlike any other."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def packed(a: np.ndarray | None) -> str:
    return "" if a is None else a.tobytes().hex()


def unpacked(text: str) -> np.ndarray | None:
    return np.frombuffer(bytes.fromhex(text), np.uint8) if text else None


def sketches(texts: list[str]) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for _, _, raw, at in _text.chunks(pa.array(texts, pa.large_string())):
        h, first = _text.shingles(raw, at)
        out += [sketch(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def edited(text: str, after: str) -> str:
    """``text`` with its last half (rounded down, in code points) replaced by as many of the next text's first ones."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints each text and its edited text, and compares it with that and the next text.

    docs: doc_id, text; further columns are ignored. The next document is the one that follows by
    ascending doc_id (null first, then equal doc_ids by text); after the last comes the first, which may be the
    same row. A null text is empty. Texts of fewer than five words are one shingle; without words the
    fingerprint is an empty string. An empty table gives no rows. The text is shuffled once, by ranges of
    doc_id; the first document of each range is also sent to the range before it."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = own.select("doc_id")
    cuts = range_cuts(ids, "doc_id", ranges or 4 * parts)
    heads = {r["part"]: r["head"] for r in ids.groupBy(range_number(F.col("doc_id"), cuts).alias("part")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("head")).collect()}  # one row per range
    order = sorted(heads)
    before = [(heads[p], order[k - 1]) for k, p in enumerate(order)]
    head = spark.createDataFrame(before or [(0, 0)], "head long, before int").limit(len(before))
    keyed = own.withColumn("part", range_number(F.col("doc_id"), cuts)).withColumn("k", F.coalesce("doc_id", F.lit(-(2**63))))
    sent = keyed.join(F.broadcast(head), F.col("k") == F.col("head"), "left").select(  # as many rows as ranges
        "doc_id", "text",
        F.explode(F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(0).alias("late")))).otherwise(F.array(F.struct("part", F.lit(0).alias("late")), F.struct(F.col("before").alias("part"), F.lit(1).alias("late"))))).alias("to"),
    ).select("doc_id", "text", "to.part", "to.late")
    dealt = sent.repartition(parts, "part").sortWithinPartitions("part", "late", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of its range so far: (part, doc_id, text, sketch)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                doc_ids, texts, part, late = (some.column(some.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "late"))
                rows = held + list(zip(part, doc_ids, texts, sketches(texts), late, strict=True))
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[4] and a[0] == b[0]]
                held = rows[-1:]
                new = [edited(a[2], b[2]) for a, b in pairs]
                made = sketches(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[1] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                        pa.array([packed(a[3]) for a, _ in pairs], pa.string()),
                        pa.array([packed(x) for x in made], pa.string()),
                        pa.array([likeness(a[3], x) for (a, _), x in zip(pairs, made, strict=True)], pa.float64()),
                        pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    ],
                    names=[x.split()[0] for x in COLUMNS.split(", ")],
                )

    return dealt.mapInArrow(run, COLUMNS)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


QUERIES = {"op5_document_fingerprints": op5_document_fingerprints}
SQL: dict[str, str] = {}
