"""Expectations and classifiers over rows: predicates as data, evaluated in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rule``, ``n_failed``, ``n_rows``: how many rows break each SQL predicate; a null outcome breaks it. One scan for all."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(f"r{i}") for i, p in enumerate(rules.values())))
    parts = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_failed")) for i, name in enumerate(rules)))
    return counts.select("n_rows", F.explode(parts).alias("x")).select("x.rule", "x.n_failed", "n_rows")


def violations(df: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """``key``, ``rule`` of every predicate that a row breaks or that cannot be told for it."""
    broken = F.array(*(F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(name)) for name, p in rules.items()))
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def first_bucket(df: DataFrame, text: str, buckets: list[tuple[str, str]], default: str) -> DataFrame:
    """The rows with ``bucket``: the first whose pattern occurs in the text."""
    out = F.lit(default)
    for name, pattern in reversed(buckets):
        out = F.when(F.col(text).rlike(pattern), name).otherwise(out)
    return df.withColumn("bucket", out)


LITERAL = "[\"']([A-Za-z_/-]{6,})[\"']"


def repeated_literals(df: DataFrame, key: str, text: str, least: int = 3, top: int = 3, pattern: str = LITERAL) -> DataFrame:
    """``key``, ``literal``, ``n``: the ``top`` matches of the pattern's group (quoted literals) that stand ``least`` times or more; ties by text.

    Of several deliveries of a key the one with most counts. Literals are counted in their row; no text is shuffled.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), 1)
    numbered = df.select(key, F.monotonically_increasing_id().alias("row"), found.alias("found"))
    rows = numbered.select(key, "row", F.explode("found").alias("literal"))
    counts = rows.groupBy(key, "row", "literal").agg(F.count("*").alias("n")).where(F.col("n") >= least).groupBy(key, "literal").agg(F.max("n").alias("n"))
    best = counts.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "literal"))), 1, top).alias("x"))
    return best.select(key, F.explode("x").alias("x")).select(key, "x.literal", (-F.col("x.m")).alias("n"))
