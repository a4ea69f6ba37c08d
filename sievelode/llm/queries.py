"""The queries of this package: name -> function of (session, directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.llm import function_docs, generated, leakage, mixing, natural_language, secrets, sentences, shared_spans
from sievelode.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.credentials(load(spark, sf_dir, "review"))
    return found.select("review_id", "field", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(load(spark, sf_dir, "review"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.not_handwritten(load(spark, sf_dir, "dep_audit")).select("file_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = generated.not_handwritten(load(spark, sf_dir, "dep_audit"))
    return kinds.groupBy("category", "reason").agg(F.count("*").alias("n_files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(load(spark, sf_dir, "review"))


def p3_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_amounts(load(spark, sf_dir, "review"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.documented(load(spark, sf_dir, "review")).drop("doc")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_docs.function_pairs(load(spark, sf_dir, "review"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = natural_language.train_languages(load(spark, sf_dir, "documents"))
    return natural_language.languages_in(load(spark, sf_dir, "review"), model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("review_id", "nl_lang")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.where("distance = 0").select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("distance") == 0).alias("n_exact"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir, "mix_targets")
    return mixing.mix_shares(mixing.mix(load(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(load(spark, sf_dir, "documents")).select("doc_id", "sent_start").distinct()


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        p1_found, p1_redacted, p2_found, p2_kinds, p3_found, p3_amounts, p4_found, p4_pairs, p5_found, p5_shares,
        p6_found, p6_items, p7_mix, p7_shares, p8_found, p8_sentences,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
