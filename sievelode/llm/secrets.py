"""Problem 1: credentials in source code, configuration and evidence lines.

Method: literals are decoded recursively (base64, hex, percent, escapes), key containers are parsed by their
binary grammar, decoded layers are scanned again, and the enclosing encoded literal is what is redacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelode.llm.secret_rules import find_credentials, redact


def _blanks(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Key and fields under fixed names, so that other columns of the table can't clash."""
    return df.select(F.col(key).cast("long").alias("k"), *(F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(fields)))


def credentials(df: DataFrame, key: str = "review_id", fields: tuple[str, ...] = ("content", "security")) -> DataFrame:
    """One row per credential: ``key``, ``field``, ``line_no`` (1-based), ``start_pos``, ``end_pos``, ``kind``.

    Offsets count code points. Null and empty texts give no rows, an empty table gives none; rows with a null
    key keep it. Rows delivered twice under one key give their credentials once. No text is shuffled: each row
    is scanned where it is read, and only found places are brought together.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for i, field in enumerate(fields):
                for k, text in zip(keys, batch.column(i + 1).to_pylist(), strict=True):
                    line, last = 1, 0
                    for s, e, kind in find_credentials(text):
                        line += text.count("\n", last, s)
                        last = s
                        out.append((k, field, line, s, e, kind))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["k", "field", "line_no", "start_pos", "end_pos", "kind"],
            )

    found = _blanks(df, key, fields).mapInArrow(
        scan, "k long, field string, line_no int, start_pos int, end_pos int, kind string"
    )
    return found.withColumnRenamed("k", key).distinct()


def redacted(df: DataFrame, key: str = "review_id", fields: tuple[str, ...] = ("content", "security")) -> DataFrame:
    """One row per key and field that holds a credential: ``key``, ``field``, ``n_redacted``, ``redacted_text``.

    Everything but the credentials stays as it was, line numbers, quotes and escapes included: each piece of a value is
    replaced within its own quotes by one word, so that code and configuration stay valid; for an encoded credential
    the whole encoded literal is replaced. Fields without credentials give no row: their text is the original one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for i, field in enumerate(fields):
                for k, text in zip(keys, batch.column(i + 1).to_pylist(), strict=True):
                    found = find_credentials(text)
                    if found:
                        out.append((k, field, len(found), redact(text, found)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["k", "field", "n_redacted", "redacted_text"]
            )

    found = _blanks(df, key, fields).mapInArrow(scan, "k long, field string, n_redacted int, redacted_text string")
    return found.withColumnRenamed("k", key).dropDuplicates([key, "field"])
