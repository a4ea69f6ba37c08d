"""Vector operators on array columns, and two small learners."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_norm(df: DataFrame, key: str, vector: str, eps: float = 1e-5) -> DataFrame:
    """``key``, ``dim`` (from 0), ``value``: each dimension with mean 0 and population variance 1 over all rows."""
    long = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", (F.round((F.col("x") - F.col("m")) / F.sqrt(F.col("v") + eps), 4) + 0.0).alias("value"))


def dense_relu(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One layer: max(0, w·x + b) for each row of the weights."""
    rows = []
    for w, b in zip(weights, bias, strict=True):
        literal = F.array(*(F.lit(float(x)) for x in w))
        dot = F.aggregate(F.zip_with(vector, literal, lambda a, c: a * c), F.lit(float(b)), lambda s, x: s + x)
        rows.append(F.greatest(F.lit(0.0), dot))
    return F.array(*rows)


def _labelled(df: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, Column]:
    """Rows with a vector and a label, and which third of them (by hash of the key) is held out."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return rows, F.pmod(F.xxhash64(key), F.lit(3)) == 0


def forest_importances(df: DataFrame, key: str, vector: str, label: str, trees: int = 20, seed: int = 1) -> DataFrame:
    """``dim``, ``importance`` (their sum is 1) of each dimension in the forest that ``random_forest`` fits; one row a dimension."""
    rows, held = _labelled(df, key, vector, label)
    model = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed).fit(rows.where(~held))
    values = [(i, round(float(x), 6)) for i, x in enumerate(model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(values, "dim int, importance double")


def random_forest(df: DataFrame, key: str, vector: str, label: str, trees: int = 20, seed: int = 1) -> DataFrame:
    """``key``, ``label``, ``prediction``, ``confidence`` of a forest fitted on two thirds of the rows (by hash of the key) for the rest."""
    rows, held = _labelled(df, key, vector, label)
    model = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed).fit(rows.where(~held))
    out = model.transform(rows.where(held))
    return out.select(key, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), F.round(F.array_max(vector_to_array("probability")), 6).alias("confidence"))


def _path(n: float) -> float:
    """Mean depth at which a value is told apart in a random tree over ``n`` rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator) -> tuple:
    """A random tree: ``(column, cut, left, right)`` or ``(depth,)``."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else np.array([], dtype=int)
    if depth >= limit or not len(spread):
        return (depth + _path(len(x)),)
    c = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
    return c, cut, _grow(x[x[:, c] < cut], depth + 1, limit, rng), _grow(x[x[:, c] >= cut], depth + 1, limit, rng)


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 50, sample: int = 256, seed: int = 1) -> DataFrame:
    """``key``, ``score`` in (0, 1) of an isolation forest; higher is stranger. Null values count as 0.

    Each tree is grown in a task of its own on ``sample`` rows (a documented bound) that are drawn for it over the whole
    table by a hash of tree and key: of the rows below a bound that about four samples pass, those with the least hash.
    Every row is scored where it lies.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns))
    n = rows.count()
    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(2, size))))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "tree", "k"), F.lit(1 << 40)))
    drawn = drawn.where(F.col("h") <= int(min(1.0, 4 * sample / max(n, 1)) * (1 << 40)))

    def grown(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        x = frame.sort_values(["h", "k"])[columns].head(sample).to_numpy(dtype=float)
        return pd.DataFrame({"tree": [tree], "model": [pickle.dumps(_grow(x, 0, limit, np.random.default_rng([seed, tree])))]})

    models = drawn.groupBy("tree").applyInPandas(grown, "tree int, model binary").collect()  # one row a tree
    forest = [pickle.loads(r.model) for r in sorted(models)]

    def depths(tree: tuple, x: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
        out[left], out[~left] = depths(tree[2], x[left]), depths(tree[3], x[~left])
        return out

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[columns].to_numpy(dtype=float)
            mean = np.mean([depths(t, x) for t in forest], axis=0) if forest else np.zeros(len(x))
            yield pd.DataFrame({"k": frame["k"], "score": np.round(2 ** (-mean / max(_path(size), 1e-9)), 6)})

    return rows.mapInPandas(score, "k long, score double").withColumnRenamed("k", key)
