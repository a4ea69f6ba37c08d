"""Problem 7: mixing sources so that each has its target share of the tokens.

Method (subset-sum budget fitting): documents are counted by exact token length; whole repetitions and an even draw
from all lengths use up most of a source's budget, a bounded-knapsack dynamic program over the counts fits the rest (it
may give back what was drawn evenly), and seeded documents are then selected by length and count.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.session import written

#: Where the public vocabulary lies by default; a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pattern that parts a text before the merges of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_name(column: str) -> F.Column:
    """A source's name in lower case with single underscores; null where it is null or blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s_\-]+", "_"), F.lit(""))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``source`` (cleaned), ``n_tokens`` of each row; null and empty texts have 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sizes = [len(x) for x in encoder.encode_ordinary_batch(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["k", "source", "n_tokens"])

    rows = df.select(F.col(key).cast("long").alias("k"), source_name(source).alias("source"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "k long, source string, n_tokens long").withColumnRenamed("k", key)


def _subset_sum(budget: int, lengths: list[int], most: list[int]) -> list[int]:
    """How many of each length, at most ``most``, have the greatest sum that is not over the budget.

    A bit set holds the sums that can be reached; it grows by one bundle (a power of two of equal documents) at a time.
    Every so many bundles one set is kept, those between are made again on the way back: two roots of the number of
    bundles are held at once.
    """
    bundles: list[tuple[int, int]] = []
    for i, length in enumerate(lengths):
        left, size = min(most[i], budget // length), 1
        while left:
            n = min(size, left)
            bundles.append((i, n))
            left -= n
            size *= 2
    mask = (1 << (budget + 1)) - 1
    stride = max(1, math.isqrt(len(bundles)))

    def grown(reach: int, some: list[tuple[int, int]]) -> Iterator[int]:
        yield reach
        for i, n in some:
            reach = (reach | reach << n * lengths[i]) & mask
            yield reach

    kept, reach = [], 1
    for at, reach in enumerate(grown(1, bundles)):
        if at % stride == 0:
            kept.append(reach)
    total = reach.bit_length() - 1
    taken = [0] * len(lengths)
    for block in range(len(kept) - 1, -1, -1):
        some = bundles[block * stride : (block + 1) * stride]
        sets = list(grown(kept[block], some))
        for step in range(len(some), 0, -1):
            if not sets[step - 1] >> total & 1:
                i, n = some[step - 1]
                taken[i] += n
                total -= n * lengths[i]
    return taken


def fit_rest(budget: int, lengths: list[int], counts: list[int], drawn: list[int] | None = None, memory_bits: int = 1 << 31) -> list[int]:
    """How many of each length to take so that their sum comes nearest to the budget without exceeding it.

    ``drawn`` are taken to begin with. A greedy pass from the longest down fills up, then documents are given back, the
    shortest first, and the knapsack over the room that this makes is solved exactly. The room grows until the budget
    is met or all is given back, so that the result is the best there is. Only where bit sets of that room would need more than
    ``memory_bits`` is the result the best within the largest room that fits.
    """
    live = [i for i, n in enumerate(lengths) if n > 0 and counts[i] > 0]
    unit = math.gcd(*(lengths[i] for i in live)) if live else 1
    small, most = [lengths[i] // unit for i in live], [counts[i] for i in live]
    taken = [drawn[i] if drawn else 0 for i in live]
    budget //= unit
    order = sorted(range(len(live)), key=lambda j: -small[j])
    rest = budget - sum(n * t for n, t in zip(small, taken, strict=True))
    for j in order:
        n = min(most[j] - taken[j], rest // small[j])
        taken[j] += n
        rest -= n * small[j]
    bundles = sum(c.bit_length() for c in most)
    widest = memory_bits // max(1, 2 * math.isqrt(max(1, bundles)) + 2)
    room = max(4096, 2 * max(small, default=0))
    while rest:
        limit = min(budget, room, max(widest, rest))
        kept, given = list(taken), rest
        for j in reversed(order):
            n = min(kept[j], max(0, limit - given) // small[j])
            kept[j] -= n
            given += n * small[j]
        more = _subset_sum(given, small, [c - k for c, k in zip(most, kept, strict=True)])
        taken = [a + b for a, b in zip(kept, more, strict=True)]
        rest = given - sum(n * m for n, m in zip(small, more, strict=True))
        if limit < room or not any(kept):
            break
        room *= 8
    out = [0] * len(lengths)
    for i, t in zip(live, taken, strict=True):
        out[i] = t
    return out


def _quotas(frame: pd.DataFrame) -> pd.DataFrame:
    """For one source's histogram of lengths: whole repetitions, and how many documents of each length once more."""
    budget, cap = int(frame["budget"].iloc[0]), int(frame["max_repeat"].iloc[0])
    lengths, counts = frame["n_tokens"].astype(int).tolist(), frame["n_docs"].astype(int).tolist()
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    whole = min(cap, budget // total) if total else 0
    rest = budget - whole * total if whole < cap else 0
    even = [c * rest // total for c in counts] if total and rest else [0] * len(counts)
    extra = fit_rest(rest, lengths, counts, even) if rest else even
    return frame.assign(whole=whole, extra=extra)[["source", "n_tokens", "n_docs", "whole", "extra"]]


def mix(
    df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None,
    seed: int = 7, vocabulary: str = VOCABULARY, buckets: int = 1024,
) -> DataFrame:
    """One row per selected document: ``key``, ``source``, ``n_tokens``, ``copies``.

    ``targets`` has ``source``, ``target_share``, ``max_repeat``. Targets of sources without tokens are spread over the
    others in proportion; sources without a target, rows without a source and texts without tokens are not used. Without
    ``total_tokens`` the mix is as large as the caps allow. No document is used more than ``max_repeat`` times. Which
    documents of a length are drawn depends on a hash of ``seed`` and the key; rows repeated with key and text count once.

    A length of a source may be held by a third of all documents: its drawn part is bounded by a hash bucket, and only
    the documents of that one bucket are ranked.
    """
    tokens = token_counts(df, key, text, source, vocabulary).where("source is not null and n_tokens > 0").groupBy(key, "source").agg(F.max("n_tokens").alias("n_tokens"))
    tokens = tokens.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)))
    tokens = tokens.withColumn("bucket", F.expr(f"cast(h div {(1 << 40) // buckets} as int)"))
    tokens = written(tokens)  # texts are tokenised once
    lengths = tokens.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs"))
    wanted = (
        targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeat").cast("int").alias("max_repeat"))
        .where("source is not null and share > 0 and max_repeat > 0")
        .groupBy("source").agg(F.sum("share").alias("share"), F.max("max_repeat").alias("max_repeat"))
    )
    stock = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens")).join(wanted, "source")
    everything = W.Window.partitionBy(F.lit(0))  # one row per target source
    stock = stock.withColumn("share", F.col("share") / F.sum("share").over(everything))
    size = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(F.col("tokens") * F.col("max_repeat") / F.col("share")).over(everything)
    budgets = stock.withColumn("budget", F.least(F.floor(size * F.col("share") + 1e-9), F.col("tokens") * F.col("max_repeat"))).select("source", "budget", "max_repeat")
    quotas = lengths.join(budgets, "source").groupBy("source").applyInPandas(_quotas, "source string, n_tokens long, n_docs long, whole int, extra long")
    quotas = written(quotas)  # one row per source and length
    filled = tokens.join(quotas.where("extra > 0").select("source", "n_tokens", "extra"), ["source", "n_tokens"], "left_semi").groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("c"))
    upto = W.Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0)
    edges = (
        filled.withColumn("sum", F.sum("c").over(upto)).join(quotas.where("extra > 0"), ["source", "n_tokens"]).where("sum >= extra")
        .groupBy("source", "n_tokens").agg(F.min("bucket").alias("edge"), F.min_by(F.col("extra") - F.col("sum") + F.col("c"), "bucket").alias("of_edge"))
    )
    drawn = tokens.join(quotas, ["source", "n_tokens"]).join(edges, ["source", "n_tokens"], "left")
    last = drawn.where("bucket = edge").withColumn("rank", F.row_number().over(W.Window.partitionBy("source", "n_tokens").orderBy("h", key)))
    parts = last.withColumn("once", (F.col("rank") <= F.col("of_edge")).cast("int")).drop("rank").unionByName(
        drawn.where("edge is null or bucket <> edge").withColumn("once", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    )
    return parts.withColumn("copies", F.col("whole") + F.col("once")).where("copies > 0").select(key, "source", "n_tokens", "copies")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: ``source``, ``target_share``, ``max_repeat``, ``n_docs``, ``n_copies``, ``used_tokens``, ``actual_share``."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    both = targets.select(source_name("source").alias("source"), "target_share", "max_repeat").join(used, "source", "left").fillna(0, ["n_docs", "n_copies", "used_tokens"])
    total = F.sum("used_tokens").over(W.Window.partitionBy(F.lit(0)))  # one row per target source
    return both.withColumn("actual_share", F.round(F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0), 9))
