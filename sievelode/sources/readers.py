"""Readers of source trees, triples, delimited rows and front matter, and sinks with retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.operators.state import last_n

TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py", skip: tuple[str, ...] = (".venv", "node_modules", ".git")) -> DataFrame:
    """``path``, ``src`` of every file below ``root`` whose name fits; folders of ``skip`` are left out. No cap on their number."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("src"))
    for folder in skip:
        rows = rows.where(~F.contains("path", F.lit(f"/{folder}/")))
    return rows


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``s``, ``p``, ``o`` of N-Triples files; blank lines and comments are passed over, lines that are no triple too."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", TRIPLE, i)
    return lines.where(F.col("value").rlike(TRIPLE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))


def dangling_objects(triples: DataFrame) -> DataFrame:
    """Triples whose object is a resource that is no subject of any triple (anti join)."""
    known = triples.select(F.col("s").alias("o")).distinct()
    return triples.where(F.col("o").startswith("<")).join(known, "o", "left_anti").select("s", "p", "o")


def string_rows(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Delimited rows with every column a string; quotes, quoted line breaks and doubled quotes are read as usual."""
    return spark.read.csv(path, header=header, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents or arrays with an explicit schema; broken ones give rows of nulls."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between two ``---`` lines at the start of a text; empty without them."""
    block = F.regexp_extract(text, r"^﻿?---\r?\n([\s\S]*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    distinct = F.filter(entries, lambda e: e["k"] != "")
    return F.map_from_entries(F.aggregate(distinct, F.array().cast("array<struct<k:string,v:string>>"), lambda acc, e: F.when(F.exists(acc, lambda a: a["k"] == e["k"]), acc).otherwise(F.concat(acc, F.array(e)))))


def declared_packages(text: Column) -> Column:
    """Package names of all ``dependencies = [...]`` and ``install_requires=[...]`` blocks, in order."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?:dependencies|install_requires)\s*=\s*\[([^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*)\]"), 1)
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"['\"]\s*([A-Za-z0-9_.-]+)"), 1)))


# ---- fixed values: names of files that declare dependencies ----
DEPENDENCY_FILES = (
    ("requirements", r"(^|/)requirements[\w.-]*\.txt$"), ("pyproject", r"(^|/)pyproject\.toml$"), ("setup", r"(^|/)setup\.(py|cfg)$"), ("pipfile", r"(^|/)Pipfile$"),
    ("package", r"(^|/)package\.json$"), ("go", r"(^|/)go\.mod$"), ("maven", r"(^|/)pom\.xml$"), ("gradle", r"(^|/)build\.gradle(\.kts)?$"),
    ("lock", r"(^|/)([\w.-]+\.lock|package-lock\.json|pnpm-lock\.yaml|go\.sum)$"),
)


def dependency_file(path: Column) -> Column:
    """Kind of dependency file that a clean path names; null for any other file."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(DEPENDENCY_FILES):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def write_capped(df: DataFrame, path: str, group: list[str], order: list[Column], cap: int) -> None:
    """Overwrites ``path`` with the first ``cap`` rows of each group in ``order``, parted by group."""
    kept = last_n(df, group, order, cap).drop("place")
    kept.repartition(*group).write.mode("overwrite").partitionBy(*group).parquet(path)


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrites ``path`` with one row per key; repeated keys are an error, so that a baseline stays unambiguous."""
    repeated = df.groupBy(*keys).count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"keys {keys} are repeated")
    df.write.mode("overwrite").parquet(path)
