"""Retrieval: postings, boolean search, BM25, rank fusion and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.functions.scalar import search_terms


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``term``, ``key``, ``tf``. Null and empty texts have none."""
    return df.select(key, F.explode(search_terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def index_terms(post: DataFrame) -> DataFrame:
    """``term``, ``df`` (documents that have it), ``cf`` (its occurrences)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def all_terms(post: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys of the documents that have every term; none for an empty list or with a term that no document has."""
    wanted = sorted(set(terms))
    return post.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)


def bm25(df: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_key``, ``key``, ``score``, ``hits`` of every document that has a term of the query.

    Only postings of query terms are kept, before anything is shuffled, each with its document's length; the number of
    documents and their average length take a pass of their own before, since every weight needs them.
    Queries are a stated set; their terms are joined by hash, broadcast only under Spark's size threshold.
    """
    terms = queries.select(query_key, F.explode(F.array_distinct(search_terms(F.col(query_text)))).alias("term"))
    tokens = df.select(key, search_terms(F.col(text)).alias("terms")).where(F.col("terms").isNotNull()).withColumn("dl", F.size("terms"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, average = stats["n"], stats["avgdl"] or 1.0
    used = terms.select("term").distinct()
    post = tokens.select(key, "dl", F.explode("terms").alias("term")).join(used, "term", "left_semi").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    counts = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(average))))
    return post.join(counts, "term").join(terms, "term").groupBy(query_key, key).agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("hits"))


def ranked(scored: DataFrame, group: str, key: str, score: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group with ``rank`` from 0; equal scores go by key."""
    w = W.Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < n)


def fuse(lists: list[DataFrame], group: str, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``group``, ``key``, ``rank`` from 0): ``score`` is the sum of 1/(k+rank+1)."""
    rows = None
    for one in lists:
        part = one.select(group, key, "rank")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(group, key).agg(F.round(F.sum(1.0 / (k + F.col("rank") + 1)), 9).alias("score"))


def suggestions(names: DataFrame, library: DataFrame, query_key: str, key: str, text: str, n: int = 3, shown: int = 4) -> DataFrame:
    """``query_key``, ``key``, ``matched``, ``n_matched``, ``rank``: the ``n`` library texts that contain most of a query's names.

    ``names`` has ``query_key`` and ``name`` (letters, digits, underscores); case does not matter, and a name may stand
    inside a longer word. ``matched`` are the first ``shown`` by name. Ties go by ``key``. Null texts and names match nothing.

    A name that a text contains lies within one of its words, so the parts of the library's distinct words, no longer
    than the longest name, are joined to the names by equality. The library is bounded (a stated collection of
    snippets), queries are not: each gives at most one row a library text before the ranking.
    """
    wanted = names.select(query_key, F.lower("name").alias("name")).where(F.length("name") > 0).distinct()
    longest = wanted.agg(F.max(F.length("name")).alias("n")).first()["n"] or 0
    words = library.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0))).alias("word"))
    begins = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    room = F.least(F.lit(longest), F.length("word") - F.col("at") + 1)
    parts = begins.where(room > 0).select("word", F.explode(F.transform(F.sequence(F.lit(1), room), lambda m: F.substr("word", F.col("at"), m))).alias("name")).distinct()
    held = parts.join(wanted.select("name").distinct(), "name").join(words, "word").select("name", key).distinct()
    hits = wanted.join(held, "name").groupBy(query_key, key).agg(F.count("*").alias("n_matched"), F.concat_ws(" ", F.slice(F.array_sort(F.collect_list("name")), 1, shown)).alias("matched"))
    return ranked(hits, query_key, key, "n_matched", n)


def nearest(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = 5, block: int = 2048) -> DataFrame:
    """``query_id``, ``key``, ``cosine`` of the ``n`` nearest rows of each query vector, the query's own row left out.

    Exact: the stated queries go to the tasks in blocks of at most ``block`` vectors, each task keeps its own best
    ``n`` of every query, and those are ranked together. No pair of rows is shuffled.
    """
    session = df.sparkSession
    found, rows = None, []

    def against(some: list) -> DataFrame:
        ids = np.array([r[0] for r in some])
        unit = np.array([r[1] for r in some], dtype=np.float64)
        unit = session.sparkContext.broadcast((ids, unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)))

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, q = unit.value
            best = [pd.DataFrame({"query_id": [], "k": [], "cosine": []}).astype({"query_id": "int64", "k": "int64", "cosine": "float64"})]
            for frame in frames:
                frame = frame.sort_values("k")  # ties go by key
                m = np.array(frame["v"].tolist(), dtype=np.float64)
                if not len(m):
                    continue
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(m), 4096):
                    part, keys = m[at : at + 4096] @ q.T, frame["k"].to_numpy()[at : at + 4096]
                    part[keys[:, None] == query_ids[None, :]] = -np.inf
                    take = np.argsort(-part, axis=0, kind="stable")[: n + 1]
                    near = pd.DataFrame({"query_id": np.tile(query_ids, len(take)), "k": keys[take].ravel(), "cosine": np.take_along_axis(part, take, 0).ravel()})
                    best = [pd.concat([*best, near[np.isfinite(near["cosine"])]]).sort_values(["query_id", "cosine", "k"], ascending=[True, False, True]).groupby("query_id").head(n)]
            yield best[0]

        vectors = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
        return vectors.mapInPandas(scan, "query_id long, k long, cosine double")

    stated = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    for row in stated.toLocalIterator():
        rows.append(row)
        if len(rows) == block:
            found = against(rows) if found is None else found.unionByName(against(rows))
            rows = []
    if rows:
        found = against(rows) if found is None else found.unionByName(against(rows))
    if found is None:
        found = session.createDataFrame([], "query_id long, k long, cosine double")
    w = W.Window.partitionBy("query_id").orderBy(F.desc("cosine"), F.asc("k"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", F.col("k").alias(key), F.round("cosine", 4).alias("cosine"), "rank")
