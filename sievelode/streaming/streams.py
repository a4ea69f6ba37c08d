"""Structured Streaming jobs: each reads a table's files as a stream up to what is there and stops."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelode.session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, sf_dir: str, table: str, files: int = 1000) -> DataFrame:
    """The table's files as a stream of at most ``files`` a batch; times get the session's zone, since watermarks need it."""
    path = f"{sf_dir}/{table}.parquet"
    known = spark.read.parquet(path)
    source = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files)
    stream = source.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if not _is_folder(spark, path) else source.parquet(path)
    return stream.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in known.dtypes))


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything that is there now, into a new table, and reads that table."""
    spark = stream.sparkSession
    out = _folder(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def fold(stream: DataFrame, name: str, schema: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Folds a stream's batches into one table: each batch makes a new version of it from the last one, ``step(table, batch)``.

    Versions are numbered by batch and overwritten where a batch runs again, so that a failed batch leaves no trace; the
    last one is read. Without any batch the table is empty.
    """
    spark = stream.sparkSession
    out = _folder(spark, name)
    done: list[int] = []

    def version(n: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{out}/v{n}")

    def on_batch(batch: DataFrame, n: int) -> None:
        old = version(done[-1]) if done else spark.createDataFrame([], schema)
        step(old, batch).write.mode("overwrite").parquet(f"{out}/v{n}")
        done.append(n)

    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return version(done[-1]) if done else spark.createDataFrame([], schema)


def latest_by_key(rows: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """``key``, ``n``, ``last``: rows so far of each key and the value of its last one by ``ts`` and ``tie``, given anew for every batch that has rows of the key.

    The state of a key is its count and the place and value of its last row, whatever order the rows come in.
    """

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, at, order, last = state.get if state.exists else (0, -1, -1, None)
        for frame in frames:
            n += len(frame)
            for a, b, v in zip(frame["at"], frame["tie"], frame["value"], strict=True):
                if (a, b) > (at, order):
                    at, order, last = int(a), int(b), v
        state.update((n, at, order, last))
        yield pd.DataFrame({"key": [group[0]], "n": [n], "last": [last]})

    slim = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("string").alias("value"))
    kept = "n long, at long, tie long, last string"
    return slim.groupBy("key").applyInPandasWithState(advance, "key long, n long, last string", kept, "append", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def windowed_counts(events: DataFrame, size: str = "1 day", delay: str = "2 hours", slide: str | None = None) -> DataFrame:
    """``window_start``, ``event_type``, ``n``, ``total`` of each closed window, tumbling or (with ``slide``) sliding; rows later than the watermark are left out."""
    w = F.window("ts", size, slide)
    return (
        events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def once_per_key(rows: DataFrame, keys: list[str], ts: str, delay: str = "30 days") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
