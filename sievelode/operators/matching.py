"""Matching: requirement lines, version ranges, policies, broken references, data quality."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelode.functions.scalar import normal_path, version_key

REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9_.-]*)\s*(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([0-9A-Za-z_.*+-]+))?"


def parse_requirements(df: DataFrame, line: str = "line") -> DataFrame:
    """The rows whose line names a package, with ``name`` (lower case), ``op`` and ``version`` (``*`` where unpinned).

    Comments, flags (lines that begin with ``-``), blank and null lines give no rows.
    """
    part = lambda i: F.regexp_extract(F.col(line), REQUIREMENT, i)
    return (
        df.where(F.col(line).isNotNull() & F.col(line).rlike(r"^\s*[A-Za-z0-9]"))
        .withColumn("name", F.lower(part(1)))
        .withColumn("op", part(2))
        .withColumn("version", F.when(part(3) == "", "*").otherwise(part(3)))
    )


def merge_requirements(parsed: DataFrame) -> DataFrame:
    """One row per repo and name: the first pinned version by ``line_id`` (``*`` without one), sources and how many lines."""
    pinned = F.col("version") != "*"
    return parsed.groupBy("repo", "name").agg(
        F.coalesce(F.min_by("version", F.when(pinned, F.col("line_id"))), F.lit("*")).alias("version"),
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"),
        F.count_distinct("line_id").alias("n_lines"),
    )


def vulnerable(merged: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pinned packages whose version lies in a signature's range (both ends belong to it, a null end is open).

    Signatures are joined by name; Spark broadcasts them while its threshold allows, and shuffles by name beyond it.
    """
    sig = signatures.select("sig_id", F.lower("package").alias("name"), version_key(F.col("lo")).alias("lo_key"), version_key(F.col("hi")).alias("hi_key"), "severity")
    at = version_key(F.col("version"))
    return merged.where("version <> '*'").join(sig, "name").where(
        (F.col("lo_key").isNull() | (at >= F.col("lo_key"))) & (F.col("hi_key").isNull() | (at <= F.col("hi_key")))
    ).select("repo", "name", "version", "sig_id", "severity")


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell pattern with ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def decide(df: DataFrame, path: str, rules: list[tuple[str, str]], order: tuple[str, ...], default: str) -> DataFrame:
    """The rows with ``decision`` and ``rule``: of all rules (action, glob) that fit the cleaned path, the first action of ``order`` wins, by its first glob; null ``rule`` for the default."""
    clean = normal_path(F.col(path))
    found = F.struct(F.lit(default).alias("decision"), F.lit(None).cast("string").alias("rule"))
    for action in reversed(order):
        for a, glob in reversed(rules):
            if a == action:
                found = F.when(clean.rlike(glob_pattern(glob)), F.struct(F.lit(action).alias("decision"), F.lit(glob).alias("rule"))).otherwise(found)
    return df.withColumn("_found", found).withColumn("decision", F.col("_found.decision")).withColumn("rule", F.col("_found.rule")).drop("_found")


def escalated(df: DataFrame, text: Column, words: tuple[str, ...], decision: str = "decision", to: str = "ask", final: str = "deny") -> DataFrame:
    """The rows, their decision raised to ``to`` where the text has one of the words (in lower case); what is ``final`` stays, null texts raise nothing."""
    risky = F.lit(False)
    for word in words:
        risky = risky | F.contains(F.lower(text), F.lit(word))
    raised = F.when(F.coalesce(risky, F.lit(False)) & (F.col(decision) != final), to).otherwise(F.col(decision))
    return df.withColumn(decision, raised)


def missing_references(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """The rows whose reference is not null and not known (anti join)."""
    keys = known.select(F.col(known_column).alias(column)).where(F.col(column).isNotNull()).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def quality(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per column: ``column``, ``n_null``, ``n_blank``, and for the table ``n_rows``, ``n_keys``."""
    aggregates = [F.count("*").alias("n_rows"), F.count_distinct(*key).alias("n_keys")]
    for c in columns:
        aggregates += [F.count_if(F.col(c).isNull()).alias(f"{c}_null"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}_blank")]
    row = df.agg(*aggregates)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_null").alias("n_null"), F.col(f"{c}_blank").alias("n_blank")) for c in columns))
    return row.select("n_rows", "n_keys", F.explode(parts).alias("x")).select("x.column", "x.n_null", "x.n_blank", "n_rows", "n_keys")


def mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key``, ``name`` of every known name that stands in a text as a word; names are lower case. Texts end in the scan, words are joined."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9_-]*"), 0))
    known = names.select(F.lower(name).alias("name")).where("name is not null").distinct()
    return df.select(key, F.explode(words).alias("name")).join(known, "name", "left_semi").distinct().select(key, "name")
