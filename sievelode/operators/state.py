"""State over time: upserts with counters, retention, snapshots, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.functions.scalar import keywords


def upsert_counts(df: DataFrame, keys: list[Column], verified: Column, evidence: str, order: list[str]) -> DataFrame:
    """Keys, ``times``, ``verified`` (whether any row is), ``evidence`` (the last one that is not blank, by ``order``)."""
    there = F.col(evidence).isNotNull() & (F.trim(evidence) != "")
    return df.groupBy(*keys).agg(
        F.count("*").alias("times"), F.coalesce(F.bool_or(verified), F.lit(False)).alias("verified"), F.max_by(evidence, F.when(there, F.struct(*order))).alias("evidence")
    )


def last_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Retention: the first ``n`` rows of each group in ``order``, with their ``place``."""
    return df.withColumn("place", F.row_number().over(W.Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= n)


def snapshot(df: DataFrame, keys: list[str], content: str, by: list[str]) -> DataFrame:
    """Keys and ``digest`` (16 hex digits of SHA-256) of the latest content by ``by``; a null content counts as empty."""
    digests = df.select(*keys, *by, F.substring(F.sha2(F.coalesce(F.col(content), F.lit("")), 256), 1, 16).alias("digest"))  # texts end here
    return digests.groupBy(*keys).agg(F.max_by("digest", F.struct(*by, "digest")).alias("digest"))


def compare_snapshots(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``status``: ``new``, ``same``, ``changed`` or ``gone``."""
    both = old.withColumnRenamed("digest", "a").join(new.withColumnRenamed("digest", "b"), keys, "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(*keys, status.alias("status"))


def kept_or_rolled_back(df: DataFrame, keys: list[str], order: list[str], score: str) -> DataFrame:
    """The rows with ``kept``: whether the score is above the one before in its group; the first row is kept, a null score not."""
    before = F.lag(score).over(W.Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("kept", F.coalesce(first | (F.col(score) > before), F.lit(False)))


def sediment(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """``skill_key`` (first 8 hex digits of the text's MD5), ``times``, ``first_place`` (least of the first order column)."""
    return (
        df.where(F.col(text).isNotNull() & (F.col(text) != ""))
        .groupBy(F.substring(F.md5(text), 1, 8).alias("skill_key"))
        .agg(F.count("*").alias("times"), F.min(order[0]).alias("first_place"))
    )


def lessons(df: DataFrame, keys: list[str], title: str, text: str, limit: int = 12) -> DataFrame:
    """Keys, ``prediction`` (the text, else the title; rows without either are left out) and ``keywords``: the first ``limit`` keywords of both."""
    prediction = F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(title))
    kept = F.concat_ws(" ", keywords(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))), limit))
    return df.select(*keys, prediction.alias("prediction"), kept.alias("keywords")).where("prediction is not null and prediction <> ''")
