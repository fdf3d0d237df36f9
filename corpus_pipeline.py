"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, whatever else those are named. Repeated rows, ties,
texts of any length and empty tables are defined for each stage below; none of them fails on nulls in any column."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import cut, table
from mergeloom.llm import decontamination, jaccard, packing, pii, toxicity

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, trained on the labels of the others in its folds, rejects.

    Null and empty texts stay, and so do rows with a null doc_id unless their text is toxic. Equal texts are judged alike, each row on its
    own. A score of exactly the threshold rejects. Without labels of both kinds, or documents, nothing is rejected."""
    labels = table(spark, sf_dir, "labels").where(toxicity.crc_mod(F.col("doc_id"), toxicity.FOLDS) != 0)
    model = toxicity.train(docs, labels.select("doc_id", "toxic"))
    return toxicity.without_toxic(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that the Jaccard join links stays: the one with the least doc_id.

    Texts without words, null ones too, are in no class and all stay. A null doc_id counts as the greatest. Of repeated rows (and of
    rows with one doc_id and one set of shingles) one stays. An empty table stays empty."""
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null, empty and wordless texts hold none and stay; equal texts go or stay together, whatever their doc_id. Null, empty or repeated items
    change nothing; without items everything stays. An empty table stays empty."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and n_chars brought up to date.

    Null texts stay null and empty ones empty, with their n_chars as they were (0 for empty ones). Of overlapping finds the first names the place. Repeated
    rows change alike. An empty table stays empty."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: which sequence it is in, and where.

    A null or empty text is one piece, the end mark. Repeated rows are packed each; a null doc_id is packed as such. Texts beyond a
    sequence's length are cut into pieces. Ties of length go by a hash of the piece. An empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet below the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    cut(spark.range(1).toDF("x"))  # names the checkpoint folder where none is set
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
