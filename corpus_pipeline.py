"""A corpus pipeline of five stages over ``documents``.

Each stage works on all rows its predecessor kept, is written as Parquet and read again. All but
the last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables
are treated as the operators' docstrings say; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import jaccard, mixing, packing, quality, secrets
from tallywright.llm.storage import new_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours vote against go; so do texts without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_quality(docs, labels)
    return scored.filter(F.col(quality.SCORE) >= 0.5).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their five-word shingles, the one with
    the smallest id stays."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars is the length of the text again, where one was given."""
    clean = secrets.redact(secrets.scan(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)
        clean = clean.withColumn("n_chars", length)
    return clean.select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's quota takes it: not at all, once or twice."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, connected components and packing by search cannot be put as SQL; the stages are
#: tested against brute-force versions and planted cases instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
