"""Series operators. ``key`` parts the series, ``ts`` and ``tie`` order them totally.

A series of at most ``most`` rows is one window. A longer one, as of a key that holds a third of all rows, is parted by
time (blocks of ``block`` seconds) or by place, and what a part needs of its neighbours (edge rows, counts, last values)
is brought to it, so that no task gets the whole series. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sievelode.session import cut_lineage

MOST, BLOCK = 1_000_000, 86_400


def _order(key: str, ts: str, tie: str) -> W.WindowSpec:
    return W.Window.partitionBy(key).orderBy(ts, tie)


def _split(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of series of at most ``most`` rows, and those of longer ones (None without any); a null key is a series too."""
    long = cut_lineage(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_long")))
    if long.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_long"))
    return df.join(long, same, "left_anti"), df.join(long, same, "left_semi")


def _block_of(ts: str, block: int) -> Column:
    """Number of the block of time; rows without a time stand before all others."""
    return F.coalesce(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (block * 1_000_000)), F.lit(-(1 << 62)))


def places(df: DataFrame, key: str, ts: str, tie: str, most: int = MOST, block: int = BLOCK, name: str = "place") -> DataFrame:
    """The rows with ``name``: their number in the series, from 1."""
    short, long = _split(df, key, most)
    out = short.withColumn(name, F.row_number().over(_order(key, ts, tie)).cast("long"))
    if long is None:
        return out
    rows = long.withColumn("_block", _block_of(ts, block))
    counts = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    earlier = W.Window.partitionBy(key).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a block
    before = counts.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = rows.withColumn("_row", F.row_number().over(W.Window.partitionBy(key, "_block").orderBy(ts, tie)))
    both = within.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    return out.unionByName(both.withColumn(name, F.col("_before") + F.col("_row")).drop("_block", "_row", "_key", "_at", "_before"))


def _with_neighbours(df: DataFrame, key: str, ts: str, tie: str, before: int, after: int, add: Callable[[DataFrame, W.WindowSpec], DataFrame], most: int, block: int) -> DataFrame:
    """``add(rows, window)`` for a window that looks at most ``before`` rows back and ``after`` rows ahead.

    Long series are cut by place into parts of ``most`` rows; the rows near a cut go to both sides.
    """
    short, long = _split(df, key, most)
    out = add(short, _order(key, ts, tie))
    if long is None:
        return out
    size = max(most, before, after, 1)
    at, part = F.col("_place") % size, F.floor(F.col("_place") / size)
    parts = F.array_compact(F.array(part, F.when(at >= size - before, part + 1), F.when(at < after, part - 1)))
    rows = places(long, key, ts, tie, most, block, "_place").withColumn("_own", part).withColumn("_part", F.explode(parts))
    done = add(rows, W.Window.partitionBy(key, "_part").orderBy("_place"))
    return out.unionByName(done.where("_part = _own").drop("_place", "_own", "_part"))


def _last_known(rows: DataFrame, key: str, order: list[str | Column], x: str, out: str, most: int, block: int, back: bool = False) -> DataFrame:
    """The rows with ``out``: the last ``x`` that is not null up to each, in the ``order`` (``back``: from the end); times are ``at``, ``tie`` parts equal ones."""
    upto = lambda *keys: W.Window.partitionBy(*keys).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    short, long = _split(rows, key, most)
    filled = short.withColumn(out, F.last(x, ignorenulls=True).over(upto(key)))
    if long is None:
        return filled
    parted = long.withColumn("_block", _block_of("at", block))
    pick = F.min_by if back else F.max_by
    ends = parted.groupBy(key, "_block").agg(pick(x, F.when(F.col(x).isNotNull(), F.struct("at", "tie"))).alias("_end"))
    earlier = W.Window.partitionBy(key).orderBy(F.desc("_block") if back else "_block").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a block
    carried = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    within = parted.withColumn(out, F.last(x, ignorenulls=True).over(upto(key, "_block")))
    both = within.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    return filled.unionByName(both.withColumn(out, F.coalesce(out, "_carried")).drop("_block", "_key", "_at", "_carried"))


def rolling(df: DataFrame, key: str, ts: str, tie: str, value: str, n: int = 3, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows with ``roll_mean`` and ``roll_std`` (sample; null for a single row) over the last ``n`` rows."""

    def add(rows: DataFrame, order: W.WindowSpec) -> DataFrame:
        w = order.rowsBetween(1 - n, 0)
        return rows.withColumn("roll_mean", F.round(F.avg(value).over(w), 6)).withColumn("roll_std", F.round(F.stddev_samp(value).over(w), 6))

    return _with_neighbours(df, key, ts, tie, n - 1, 0, add, most, block)


def centred_average(df: DataFrame, key: str, ts: str, tie: str, value: str, width: int = 10, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows with ``smooth``: the sum over ``width`` neighbours, missing ones 0, by ``width`` (convolution of equal length)."""
    before, after = width // 2, width - width // 2 - 1
    add = lambda rows, order: rows.withColumn("smooth", F.sum(value).over(order.rowsBetween(-before, after)) / width)
    return _with_neighbours(df, key, ts, tie, before, after, add, most, block)


def followers(df: DataFrame, key: str, ts: str, tie: str, value: str, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows with ``following``: the value of the next row of the series, null at its end."""
    return _with_neighbours(df, key, ts, tie, 0, 1, lambda rows, order: rows.withColumn("following", F.lead(value).over(order)), most, block)


def peaks(df: DataFrame, key: str, value: str, sigmas: float = 3.0, quantile: float = 0.99) -> DataFrame:
    """The rows whose value lies above mean + ``sigmas`` deviations and above the quantile of its series.

    The limits are aggregated with partial aggregation and joined back, so that a long series is never one window.
    """
    limits = df.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.percentile(value, F.lit(quantile)).alias("q"))
    return df.join(limits, key).where((F.col(value) > F.col("m") + sigmas * F.col("s")) & (F.col(value) > F.col("q"))).drop("m", "s", "q")


def control_alarms(df: DataFrame, key: str, value: str, sigmas: float = 3.0) -> DataFrame:
    """The rows outside mean ± ``sigmas`` population deviations of their series, with ``side`` (``high`` or ``low``)."""
    limits = df.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    high, low = F.col(value) > F.col("m") + sigmas * F.col("s"), F.col(value) < F.col("m") - sigmas * F.col("s")
    return df.join(limits, key).withColumn("side", F.when(high, "high").when(low, "low")).where("side is not null").drop("m", "s")


def xbar(df: DataFrame, key: str, subgroup: Column, value: str) -> DataFrame:
    """X-bar chart: ``key``, ``subgroup``, ``mean``, ``n``, ``centre``, ``ucl``, ``lcl`` and ``out``; the limits are the centre ± 3 times the mean deviation within subgroups by the root of their mean size."""
    groups = df.groupBy(key, subgroup.alias("subgroup")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count("*").alias("n"))
    limits = groups.groupBy(key).agg(F.avg("mean").alias("centre"), (F.avg("sd") / F.sqrt(F.avg("n"))).alias("sigma"))
    both = groups.join(limits, key)
    return both.select(
        key, "subgroup", F.round("mean", 6).alias("mean"), "n", F.round("centre", 6).alias("centre"),
        F.round(F.col("centre") + 3 * F.col("sigma"), 6).alias("ucl"), F.round(F.col("centre") - 3 * F.col("sigma"), 6).alias("lcl"),
        (F.abs(F.col("mean") - F.col("centre")) > 3 * F.col("sigma")).alias("out"),
    )


def ewma(df: DataFrame, key: str, ts: str, tie: str, value: str, weight: float = 0.2, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``key``, ``n``, ``ewma``: the last exponentially weighted average of each series, begun with its first value.

    Written as a weighted sum, so that rows combine before the shuffle order matters only by their position: the first
    value weighs (1-w)^(n-1), the i-th w(1-w)^(n-i).
    """
    placed = places(df.select(key, ts, tie, value), key, ts, tie, most, block).select(key, value, F.col("place").alias("i"))
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    power = F.pow(F.lit(1 - weight), F.col("n") - F.col("i"))
    return placed.join(sizes, key).groupBy(key, "n").agg(F.round(F.sum(F.col(value) * power * F.when(F.col("i") == 1, 1.0).otherwise(weight)), 6).alias("ewma"))


def on_grid(df: DataFrame, key: str, ts: str, tie: str, value: str, step: str, start: str, stop: str, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``key``, ``at``, ``ffill``, ``interp`` at each ``step`` from ``start`` to ``stop``: the last value at or before, and the line between neighbours.

    Grid points and samples are united and filled by two windows that look back, one for each direction of time; both
    are null where a neighbour is missing.
    """
    points = df.select(key).distinct().select(key, F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp"), F.expr(f"interval {step}"))).alias("at"))
    samples = df.select(key, F.col(ts).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v")).alias("x"))
    rows = samples.unionByName(points.select(key, "at", F.lit(None).cast("long").alias("tie"), F.lit(None).cast(samples.schema["x"].dataType).alias("x")))
    # At equal times samples stand before the grid point, the greatest tie last.
    known = _last_known(rows, key, ["at", F.col("x").isNull(), "tie"], "x", "a", most, block)
    filled = _last_known(known, key, [F.desc("at"), F.desc(F.col("x").isNull()), F.desc("tie")], "x", "b", most, block, back=True).where("x is null")
    now = F.unix_micros("at")
    part = (now - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    line = F.when(F.col("a.t") == now, F.col("a.v")).otherwise(F.col("a.v") + part * (F.col("b.v") - F.col("a.v")))
    return filled.select(key, "at", F.col("a.v").alias("ffill"), F.round(line, 4).alias("interp"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, left_id: str, right_id: str, value: str, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``left_id``, ``right_id``, ``value``: for each left row the last right row of its key at or before its time (null without one)."""
    r = right.select(key, F.col(ts).alias("at"), F.lit(0).alias("side"), F.col(right_id).cast("long").alias("tie"), F.struct(F.col(right_id).alias("id"), F.col(value).alias("v")).alias("x"))
    l = left.select(key, F.col(ts).alias("at"), F.lit(1).alias("side"), F.col(left_id).cast("long").alias("tie"), F.lit(None).cast(r.schema["x"].dataType).alias("x"))
    both = _last_known(r.unionByName(l), key, ["at", "side", "tie"], "x", "near", most, block).where("side = 1")
    return both.select(F.col("tie").alias(left_id), F.col("near.id").alias(f"matched_{right_id}"), F.col("near.v").alias(f"matched_{value}"))


def running_budget(df: DataFrame, key: str, place: str, amount: Column, budget: int, block: int = 10_000) -> DataFrame:
    """The rows with ``used`` (sum up to and with the row, by the whole number ``place``) and ``over`` (whether it exceeds the budget); no row is dropped.

    A prefix sum on two levels: the sums of blocks of ``block`` places are run up first, then the rows of each block, so
    that a key with very many rows is many tasks.
    """
    rows = df.withColumn("_block", F.floor(F.col(place) / block)).withColumn("_amount", amount)
    sums = rows.groupBy(key, "_block").agg(F.sum("_amount").alias("_sum"))
    earlier = W.Window.partitionBy(key).orderBy("_block").rowsBetween(W.Window.unboundedPreceding, -1)
    before = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = W.Window.partitionBy(key, "_block").orderBy(place).rowsBetween(W.Window.unboundedPreceding, 0)
    run = rows.withColumn("_run", F.sum("_amount").over(within))
    both = run.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")))
    return both.withColumn("used", F.col("_before") + F.col("_run")).withColumn("over", F.col("used") > budget).drop("_block", "_amount", "_run", "_key", "_at", "_before")
