"""Scores, tiers, roll-ups and verdicts over finding rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.functions.scalar import clean_severity, severity_weight, tier


def latest(df: DataFrame, keys: list[str], by: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``by``; ties are settled by the other columns, so the result is stable.

    Only ``columns`` (all, if not given) are read and shuffled. The rows are aggregated before the shuffle, so that a
    key delivered very often is no hot group.
    """
    rest = [c for c in (df.columns if columns is None else columns) if c not in keys]
    order = F.struct(F.col(by), *[F.col(c) for c in rest if c != by])
    return df.groupBy(*keys).agg(F.max(order).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def scores(findings: DataFrame, group: list[str], severity: str = "severity") -> DataFrame:
    """``group``, ``score`` (100 less the weights, at least 0), ``n_findings``."""
    return findings.groupBy(*group).agg(
        F.greatest(F.lit(0), F.lit(100) - F.sum(severity_weight(F.col(severity)))).cast("bigint").alias("score"), F.count("*").alias("n_findings")
    )


def tier_counts(findings: DataFrame, group: list[str], severity: str = "severity") -> DataFrame:
    """``group`` and the counts ``p0``, ``p1``, ``p2``; zeros are kept."""
    t = tier(F.col(severity))
    return findings.groupBy(*group).agg(*(F.count_if(t == label).alias(label.lower()) for label in ("P0", "P1", "P2")))


def governed(findings: DataFrame) -> DataFrame:
    """False-positive governance: of equal titles on one line of a review the first by ``ord`` stays; low confidence becomes P2.

    Columns ``review_id``, ``title``, ``line``, ``ord``, ``tier``, ``denoised``. Null lines are equal to each other.
    """
    first = findings.groupBy("review_id", "title", "line").agg(F.min_by(F.struct("ord", "severity", "confidence"), F.struct("ord", "loaded_at")).alias("x"))
    low = F.coalesce(F.col("x.confidence"), F.lit("")) == "low"
    return first.select("review_id", "title", "line", "x.ord", F.when(low, "P2").otherwise(tier(F.col("x.severity"))).alias("tier"), low.alias("denoised"))


def verdict(rank: Column) -> Column:
    """Name of a verdict's rank: 2 fail, 1 warn, else pass."""
    return F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("pass")


def guard_verdicts(findings: DataFrame, group: list[str]) -> DataFrame:
    """``group``, ``verdict``, ``n_blocking``: fail with a critical or high finding, warn with any other, pass without."""
    severe = clean_severity(F.col("severity")).isin("critical", "high")
    rank = F.when(F.coalesce(severe, F.lit(False)), 2).otherwise(1)
    return findings.groupBy(*group).agg(verdict(F.max(rank)).alias("verdict"), F.count_if(severe).alias("n_blocking"))


def rollup_counts(findings: DataFrame, outer: str, inner: Column, name: str) -> DataFrame:
    """Counts by two levels with subtotals and the grand total; ``level`` is 0, 1 or 3 as ``grouping_id`` gives it."""
    rows = findings.select(F.col(outer), inner.alias(name))
    return rows.rollup(outer, name).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def error_rates(findings: DataFrame, group: list[str]) -> DataFrame:
    """``group``, ``reported``, ``doubtful`` (low confidence), ``missed`` (no confidence) and their shares in percent."""
    low, none = F.count_if(F.col("confidence") == "low"), F.count_if(F.col("confidence").isNull())
    n = F.count("*")
    return findings.groupBy(*group).agg(
        n.alias("reported"), low.alias("doubtful"), none.alias("missed"),
        F.round(low / F.greatest(n, F.lit(1)) * 100, 1).alias("doubtful_pct"), F.round(none / F.greatest(n, F.lit(1)) * 100, 1).alias("missed_pct"),
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given total order, with their ``rank``. Spark limits groups before the shuffle."""
    w = W.Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def merged_verdicts(parts: list[DataFrame], group: list[str]) -> DataFrame:
    """``group``, ``verdict``, ``n_guards``: the worst verdict (fail, warn, pass) of several guards (``group``, ``verdict``) and how many spoke."""
    rows = None
    for part in parts:
        one = part.select(*group, F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "warn", 1).otherwise(0).alias("_rank"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*group).agg(verdict(F.max("_rank")).alias("verdict"), F.count("*").alias("n_guards"))


def delivery(steps: DataFrame, group: list[str], ok: Column, artifact: Column) -> DataFrame:
    """``group``, ``n_ok``, ``n_steps``, ``verdict``, ``n_artifacts`` over rows of steps: ``passed`` if all are ok (null is not), else ``passed k/n``; artifacts count once."""
    rows = steps.groupBy(*group).agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("n_ok"), F.count("*").alias("n_steps"), F.count_distinct(artifact).alias("n_artifacts"))
    some = F.concat(F.lit("passed "), F.col("n_ok").cast("string"), F.lit("/"), F.col("n_steps").cast("string"))
    return rows.withColumn("verdict", F.when(F.col("n_ok") == F.col("n_steps"), "passed").otherwise(some))


def mutation_scores(results: DataFrame, group: list[str], outcome: str = "outcome") -> DataFrame:
    """``group``, ``killed``, ``survived``, ``score`` in percent over rows of mutants; other outcomes (skipped, null) count in neither; null score without any."""
    killed, survived = F.count_if(F.col(outcome) == "killed"), F.count_if(F.col(outcome) == "survived")
    return results.groupBy(*group).agg(killed.alias("killed"), survived.alias("survived"), F.when(killed + survived > 0, F.round(100 * killed / (killed + survived), 1)).alias("score"))


def coverage_gate(lines: DataFrame, group: list[str], covered: str = "covered", threshold: float = 80.0) -> DataFrame:
    """``group``, ``lines``, ``hit``, ``pct`` and ``passed`` over rows of lines with a boolean ``covered`` (null counts as not); nothing to cover passes."""
    n, hit = F.count("*"), F.count_if(F.coalesce(F.col(covered), F.lit(False)))
    return lines.groupBy(*group).agg(n.alias("lines"), hit.alias("hit"), F.round(100 * hit / n, 1).alias("pct")).withColumn("passed", F.col("pct") >= threshold)
