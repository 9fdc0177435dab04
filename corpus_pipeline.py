"""A corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Toxic documents go, one document of each class of near copies stays, documents that hold benchmark items go,
secrets are redacted, and sources are mixed to target weights. Every stage but the last returns the columns of
``documents``; the last adds ``copy``, the number of a document's copy in the mix.

All stages carry further columns under any names, read whole texts of any length, and give an empty table for an empty one.
Documents with a null, empty or wordless text are neither toxic nor copies nor contaminated and hold no secret; as their size is
0, they are mixed in as often as any other. Null ids are copies like others and lose to any id; null sources are one source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm.decontamination import Decontamination
from rillflow.llm.mixing import SourceMix
from rillflow.llm.ngram_join import NgramJoin, keep_one
from rillflow.llm.runtime import Stash
from rillflow.llm.secrets import SecretScan
from rillflow.llm.toxicity import categories_of, standard_chain

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on labelled documents among them, does not reject; without labels, all.

    A probability equal to the limit rejects. Repeated rows score alike, so they stay or go together.
    """
    chain = standard_chain()
    return chain.clean(docs, chain.fit(docs, categories_of(_table(spark, sf_dir, "labels"))))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class that n-gram Jaccard similarity links: that with the smallest id; of repeated rows, one.

    All documents with an empty set stay.
    """
    return keep_one(docs, NgramJoin(size=5, threshold=75))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than half of each benchmark item; with an empty benchmark, all. Repeated rows stay or go together."""
    return Decontamination().clean(docs, _table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted and ``n_chars`` recounted where that changes a text; a null text stays null."""
    scan = SecretScan()
    return scan.redact(docs, scan.learn(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by size and then a hash of id and text; of equal rows, so many as their number in the order says."""
    return SourceMix((3, 1, 2), 1.5, 2.0).emit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the classifier, the automata and the tiling; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's result written to the shared folder and read again."""
    docs, stash = _table(spark, sf_dir, "documents"), Stash(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stash.put(name, stage(spark, docs, sf_dir))
        if k:
            stash.drop(STAGES[k - 1][0])
    return docs
