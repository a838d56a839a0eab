"""A training corpus from documents: quality, near copies, benchmark leaks and secrets are dealt with, then the rest is packed.

Every stage takes (spark, docs, sf_dir); docs has the columns of documents.
Each result is written and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grafloom.llm import classifier, decontaminate, neardup, packing, secrets
from grafloom.llm.hashed import fold
from grafloom.llm.queries import table, tokenizer_path
from grafloom.llm.store import written

QUALITY_THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Learned from the labels' folds 1 to 4, as the query of this operator."""
    labels = table(spark, sf_dir, "labels")
    learn = labels.filter(fold(labels["doc_id"], 5) != 0)
    model = classifier.fit(table(spark, sf_dir, "documents"), learn)
    scored = classifier.score(docs, model, name="quality_score_")
    return scored.filter(scored["quality_score_"] >= QUALITY_THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that of the least doc_id."""
    return neardup.keep_first(docs, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced."""
    return secrets.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece, with its ids and its place."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_removal),
    ("best_fit_packing", packed),
]

#: SQL has no trained classifier, MinHash classes or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
