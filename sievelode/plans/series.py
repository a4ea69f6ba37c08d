"""Queries over the event series, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.operators import packs, state, timeseries
from sievelode.plans.catalog import query
from sievelode.plans.packs import dimension_sql
from sievelode.sources.tables import load
from sievelode.streaming import streams


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


DIMENSIONS = dimension_sql()
W = "partition by user_id order by ts, event_id"


@query(f"select event_id, round(avg(value) over ({W} rows between 2 preceding and current row), 6) as roll_mean, round(stddev_samp(value) over ({W} rows between 2 preceding and current row), 6) as roll_std from events")
def rolling_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.rolling(events(spark, sf_dir), "user_id", "ts", "event_id", "value").select("event_id", "roll_mean", "roll_std")


SMOOTH = f"m as (select event_id, user_id, sum(value) over ({W} rows between 5 preceding and 4 following) / 10 as smooth from events)"


@query(f"with {SMOOTH} select event_id, round(smooth, 6) as smooth from m")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.centred_average(events(spark, sf_dir), "user_id", "ts", "event_id", "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query("with l as (select event_type, avg(value) as m, stddev_pop(value) as s, quantile_cont(value, 0.99) as q from events group by event_type) select event_id, e.event_type, value from events e join l using (event_type) where value > m + 3 * s and value > q")
def power_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.peaks(events(spark, sf_dir), "event_type", "value").select("event_id", "event_type", "value")


@query("with l as (select user_id, avg(value) as m, stddev_pop(value) as s from events group by user_id) select event_id, case when value > m + 3 * s then 'high' else 'low' end as side from events join l using (user_id) where value > m + 3 * s or value < m - 3 * s")
def control_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.control_alarms(events(spark, sf_dir), "user_id", "value").select("event_id", "side")


@query("""with g as (select user_id, cast(ts as date) as subgroup, avg(value) as mean, stddev_pop(value) as sd, count(*) as n from events group by all), l as (select user_id, avg(mean) as centre, avg(sd) / sqrt(avg(n)) as sigma from g group by user_id)
select user_id, subgroup, round(mean, 6) as mean, n, round(centre, 6) as centre, round(centre + 3 * sigma, 6) as ucl, round(centre - 3 * sigma, 6) as lcl, abs(mean - centre) > 3 * sigma as out from g join l using (user_id)""")
def xbar_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.xbar(events(spark, sf_dir), "user_id", F.to_date("ts"), "value")


@query(f"with p as (select user_id, value, row_number() over ({W}) as i, count(*) over (partition by user_id) as n from events) select user_id, n, round(sum(value * pow(0.8, n - i) * case when i = 1 then 1.0 else 0.2 end), 6) as ewma from p group by user_id, n")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.ewma(events(spark, sf_dir), "user_id", "ts", "event_id", "value")


@query("""with u as (select distinct user_id from events), g as (select u.user_id, s.point from u cross join (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-30', interval 12 hours)) as point) s),
f as (select g.user_id, g.point, e.value as ffill, e.ts as ts_a from g asof left join (select user_id, ts, max_by(value, event_id) as value from events group by all) e on e.user_id = g.user_id and e.ts <= g.point),
b as (select g.user_id, g.point, e.value as following, e.ts as ts_b from g asof left join (select user_id, ts, min_by(value, event_id) as value from events group by all) e on e.user_id = g.user_id and e.ts >= g.point)
select f.user_id, f.point as "at", ffill, round(case when ts_a = f.point then ffill else ffill + (epoch_us(f.point) - epoch_us(ts_a)) / (epoch_us(ts_b) - epoch_us(ts_a))::double * (following - ffill) end, 4) as interp from f join b on b.user_id = f.user_id and b.point = f.point""")
def sensor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.on_grid(events(spark, sf_dir), "user_id", "ts", "event_id", "value", "12 hours", "2024-01-02 00:00:00", "2024-01-30 00:00:00")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""with v as (select user_id, ts, max(event_id) as event_id, max_by(value, event_id) as value from events where event_type = 'view' group by all)
select p.event_id, v.event_id as matched_event_id, v.value as matched_value from (select * from events where event_type = 'purchase') p asof left join v on v.user_id = p.user_id and v.ts <= p.ts""")
def last_view_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return timeseries.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", "event_id", "event_id", "value")


@query("""with n as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) select src, dst, count(*) as n, round(count(*) / sum(count(*)) over (partition by src), 6) as share from n where dst is not null group by src, dst""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import window

    followed = timeseries.followers(events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type")
    pairs = followed.select(F.col("event_type").alias("src"), F.col("following").alias("dst")).where("dst is not null")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(window.Window.partitionBy("src")), 6))


@query("""with w as (select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all)
select * from w where window_start + interval 1 day <= (select max(ts) - interval 2 hours from events)""")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = streams.run_to_table(streams.windowed_counts(streams.file_stream(spark, sf_dir, "events")), "daily")
    return closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""with b as (select time_bucket(interval 12 hours, ts) as half, event_type, value from events), w as (select unnest([half, half - interval 12 hours]) as window_start, event_type, value from b),
g as (select window_start, event_type, count(*) as n, round(sum(value), 2) as total from w group by all) select * from g where window_start + interval 1 day <= (select max(ts) - interval 2 hours from events)""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = streams.run_to_table(streams.windowed_counts(streams.file_stream(spark, sf_dir, "events"), slide="12 hours"), "sliding")
    return closed.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select review_id, ord, count(*) > 0 as there from findings where loaded_at is not null group by review_id, ord")
def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding once: within thirty days by the stream's state; what comes later than that is settled by a batch pass over the tables."""
    rows = streams.file_stream(spark, sf_dir, "findings").where("loaded_at is not null").select("review_id", "ord", "loaded_at")
    met = streams.run_to_table(streams.once_per_key(rows, ["review_id", "ord"], "loaded_at", "30 days"), "deliveries").select("review_id", "ord")
    late = load(spark, sf_dir, "findings").where("loaded_at is not null").select("review_id", "ord").join(met, ["review_id", "ord"], "left_anti")
    return met.unionByName(late).distinct().select("review_id", "ord", F.lit(True).alias("there"))


@query("select user_id, count(*) as n, arg_max(event_type, struct_pack(a := ts, b := event_id)) as last from events where user_id is not null group by user_id")
def stream_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and last event of each user, kept as the stream's state; of the states given batch by batch the last one."""
    given = streams.run_to_table(streams.latest_by_key(streams.file_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type"), "tasks")
    return given.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last", "n").alias("last"))


@query("""select regexp_replace(title, ' in .*$', '') as rule, dimension, count(*) as times, coalesce(bool_or(confidence = 'high'), false) as verified from findings group by all""")
def stream_rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules counted over all deliveries, merged into the stored table batch by batch."""

    def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
        seen = batch.select(F.regexp_replace("title", " in .*$", "").alias("rule"), "dimension", F.lit(1).cast("long").alias("times"), F.coalesce(F.col("confidence") == "high", F.lit(False)).alias("verified"))
        return old.unionByName(seen).groupBy("rule", "dimension").agg(F.sum("times").alias("times"), F.bool_or("verified").alias("verified"))

    return streams.fold(streams.file_stream(spark, sf_dir, "findings", 4), "rules", "rule string, dimension string, times long, verified boolean", merge)


@query("""with r as (select repo, review_id, ord, found_at, loaded_at, row_number() over (partition by repo order by found_at desc, review_id desc, ord desc, loaded_at desc) as place from findings where found_at is not null) select repo, review_id, ord, place from r where place <= 5""".replace("select repo, review_id, ord, place", "select repo, review_id, ord, cast(place as int) as place"))
def stream_last_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append with a cap: the last five deliveries of each repository, kept batch by batch."""
    order = [F.desc("found_at"), F.desc("review_id"), F.desc("ord"), F.desc("loaded_at")]

    def append(old: DataFrame, batch: DataFrame) -> DataFrame:
        rows = old.unionByName(batch.where("found_at is not null").select("repo", "review_id", "ord", "found_at", "loaded_at"))
        return state.last_n(rows, ["repo"], order, 5).drop("place")

    kept = streams.fold(streams.file_stream(spark, sf_dir, "findings", 4), "last", "repo string, review_id long, ord int, found_at timestamp, loaded_at timestamp", append)
    return state.last_n(kept, ["repo"], order, 5).select("repo", "review_id", "ord", "place")


@query(DIMENSIONS)
def stream_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security rules over the files of a stream: a batch scans only files whose text was not seen before under their key."""

    def scan(old: DataFrame, batch: DataFrame) -> DataFrame:
        rows = batch.where("content is not null").select("review_id", "content", F.sha2("content", 256).alias("digest"))
        new = rows.join(old.select("review_id", "digest").distinct(), ["review_id", "digest"], "left_anti")
        hits = packs.scan_packs(new, "review_id", "content", packs.DIMENSION_RULES).select("review_id", F.lit(None).cast("string").alias("digest"), "rule", "pack", "severity", "tier")
        none = [F.lit(None).cast("string").alias(c) for c in ("rule", "pack", "severity", "tier")]
        return old.unionByName(new.select("review_id", "digest", *none).distinct()).unionByName(hits).distinct()

    schema = "review_id long, digest string, rule string, pack string, severity string, tier string"
    return streams.fold(streams.file_stream(spark, sf_dir, "review", 4), "changed", schema, scan).where("rule is not null").drop("digest")
