"""Loading of the Parquet tables and of plain text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per line: ``key``, ``line_no`` (1-based, counts ``\\n``), ``line``.

    A null text has no lines; an empty text has one empty line.
    """
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("line_no"), "line"
    )
