"""Queries that apply each operator to its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import LanguageId

    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))
    model = LanguageId().learn(docs.where(remainder != 2))
    return LanguageId().predict(docs, model, keep=("held_out",))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import PATTERNS, UrlFilter, address_rule

    addresses = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    return UrlFilter((*[address_rule(*a) for a in addresses], *PATTERNS)).judge(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import Decontamination

    return Decontamination().matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import categories_of, standard_chain

    docs, chain = table(spark, sf_dir, "documents"), standard_chain()
    return chain.scores(docs, chain.fit(docs, categories_of(table(spark, sf_dir, "labels"))))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import NgramJoin

    return NgramJoin(size=5, threshold=75).classes(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import HtmlExtraction

    return HtmlExtraction().extract(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import QualityClassifier, ratings_of

    docs, classifier = table(spark, sf_dir, "documents"), QualityClassifier()
    return classifier.grade(docs, classifier.fit(docs, ratings_of(table(spark, sf_dir, "labels"))))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression_rules import QualityRules

    return QualityRules().judge(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import SourceMix

    size, source_size, target, copies = (F.col(f"__mix_{c}") for c in ("size", "source_size", "target", "copies"))
    rows = SourceMix((3, 1, 2), 1.5, 2.0).sizes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", size.alias("size"), source_size.alias("source_size"), target.alias("target"), (size * copies).alias("taken"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import SecretScan

    docs, scan = table(spark, sf_dir, "documents"), SecretScan()
    rows = scan.scan(docs, scan.learn(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import NGRAM_JOIN, SOURCE_MIXING, URL_FILTERS

    return {"op2_url_filters": URL_FILTERS, "op5_ngram_jaccard_join": NGRAM_JOIN, "op9_source_mixing": SOURCE_MIXING}
