"""Queries over review findings: scores, tiers, governance, verdicts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.functions.scalar import clean_severity, tier
from sievelode.operators import matching, scoring, state
from sievelode.plans.catalog import query
from sievelode.sources.tables import load

#: One row per key: findings delivered twice count once.
ONCE = "one as (select review_id, ord, max_by(struct_pack(repo := repo, file := file, severity := severity, title := title, line := line, dimension := dimension, confidence := confidence, suggestion := suggestion, found_at := found_at, loaded_at := loaded_at), loaded_at) as x from findings group by review_id, ord), f as (select review_id, ord, x.* from one)"
SEVERITY = "nullif(regexp_replace(lower(severity), '[^a-z]', '', 'g'), '')"
WEIGHT = f"(case {SEVERITY} when 'critical' then 20 when 'major' then 10 when 'minor' then 3 when 'info' then 1 else 5 end)"
TIER = f"(case {SEVERITY} when 'critical' then 'P0' when 'major' then 'P1' else 'P2' end)"


def once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of findings, each key once (the delivery loaded last)."""
    return scoring.latest(load(spark, sf_dir, "findings"), ["review_id", "ord"], "loaded_at", list(columns))


@query(f"with {ONCE} select review_id, cast(greatest(0, 100 - sum({WEIGHT})) as bigint) as score, count(*) as n_findings from f group by review_id")
def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(once(spark, sf_dir, "severity"), ["review_id"])


@query(f"with {ONCE} select repo, file, cast(greatest(0, 100 - sum({WEIGHT})) as bigint) as score, count(*) as n_findings from f group by repo, file")
def file_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scores(once(spark, sf_dir, "repo", "file", "severity"), ["repo", "file"])


@query(f"with {ONCE} select repo, count(*) filter (where {TIER}='P0') as p0, count(*) filter (where {TIER}='P1') as p1, count(*) filter (where {TIER}='P2') as p2 from f group by repo")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.tier_counts(once(spark, sf_dir, "repo", "severity"), ["repo"])


@query(f"with {ONCE}, s as (select repo, review_id, greatest(0, 100 - sum({WEIGHT})) as score from f group by repo, review_id) select repo, cast(round_even(avg(score), 0) as bigint) as average, count(*) as n_reviews from s group by repo")
def project_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.scores(once(spark, sf_dir, "repo", "severity"), ["repo", "review_id"])
    return s.groupBy("repo").agg(F.bround(F.avg("score"), 0).cast("bigint").alias("average"), F.count("*").alias("n_reviews"))


@query(f"""with {ONCE}, g as (select *, row_number() over (partition by review_id, title, line order by ord, loaded_at) as rn from f)
select review_id, title, line, ord, case when coalesce(confidence, '') = 'low' then 'P2' else {TIER} end as tier, coalesce(confidence, '') = 'low' as denoised from g where rn = 1""")
def governed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.governed(once(spark, sf_dir, "title", "line", "severity", "confidence", "loaded_at"))


@query(f"with {ONCE} select repo, case when bool_or(coalesce({SEVERITY} in ('critical','high'), false)) then 'fail' else 'warn' end as verdict, count(*) filter (where {SEVERITY} in ('critical','high')) as n_blocking from f group by repo")
def guard_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.guard_verdicts(once(spark, sf_dir, "repo", "severity"), ["repo"])


@query(f"with {ONCE} select dimension, case when bool_or(coalesce({SEVERITY} in ('critical','high'), false)) then 'fail' else 'warn' end as verdict, count(*) filter (where {SEVERITY} in ('critical','high')) as n_blocking from f group by dimension")
def guard_verdict_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.guard_verdicts(once(spark, sf_dir, "dimension", "severity"), ["dimension"])


@query(f"with {ONCE}, t as (select repo, {TIER} as tier from f) select repo, tier, count(*) as n, grouping_id(repo, tier) as level from t group by rollup(repo, tier)")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rollup_counts(once(spark, sf_dir, "repo", "severity"), "repo", tier(F.col("severity")), "tier")


@query(f"""with {ONCE} select dimension, count(*) as reported, count(*) filter (where confidence = 'low') as doubtful, count(*) filter (where confidence is null) as missed,
round(count(*) filter (where confidence = 'low') / greatest(count(*), 1) * 100, 1) as doubtful_pct, round(count(*) filter (where confidence is null) / greatest(count(*), 1) * 100, 1) as missed_pct from f group by dimension""")
def self_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_rates(once(spark, sf_dir, "dimension", "confidence"), ["dimension"])


@query(f"with {ONCE}, r as (select repo, file, review_id, ord, {WEIGHT} as weight, row_number() over (partition by repo, file order by {WEIGHT} desc, review_id, ord) as rank from f) select repo, file, review_id, ord, weight, cast(rank as int) as rank from r where rank <= 5")
def worst_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelode.functions.scalar import severity_weight

    rows = once(spark, sf_dir, "repo", "file", "severity").select("repo", "file", "review_id", "ord", severity_weight(F.col("severity")).alias("weight"))
    return scoring.top_per_group(rows, ["repo", "file"], [F.desc("weight"), F.asc("review_id"), F.asc("ord")], 5)


@query(f"with {ONCE} select dimension, {SEVERITY} as severity_clean, count(*) as n from f where dimension in ('security', 'network') group by all")
def dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "dimension", "severity").where(F.col("dimension").isin("security", "network"))
    return rows.groupBy("dimension", clean_severity(F.col("severity")).alias("severity_clean")).agg(F.count("*").alias("n"))


@query(f"""with {ONCE} select regexp_replace(title, ' in .*$', '') as rule, dimension, count(*) as times, coalesce(bool_or(confidence = 'high'), false) as verified,
max_by(suggestion, struct_pack(a := found_at, b := review_id, c := ord)) filter (where suggestion is not null and trim(suggestion) <> '') as evidence from f group by all""")
def rule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "title", "dimension", "confidence", "suggestion", "found_at").withColumn("rule", F.regexp_replace("title", " in .*$", ""))
    return state.upsert_counts(rows, [F.col("rule"), F.col("dimension")], F.col("confidence") == "high", "suggestion", ["found_at", "review_id", "ord"])


@query(f"with {ONCE}, r as (select repo, review_id, ord, found_at, row_number() over (partition by repo order by found_at desc, review_id desc, ord desc) as place from f) select repo, review_id, ord, found_at, cast(place as int) as place from r where place <= 3")
def last_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "repo", "found_at").select("repo", "review_id", "ord", "found_at")
    return state.last_n(rows, ["repo"], [F.desc("found_at"), F.desc("review_id"), F.desc("ord")], 3)


@query(f"with {ONCE} select substr(md5(suggestion), 1, 8) as skill_key, count(*) as times, min(review_id) as first_place from f where suggestion <> '' group by 1")
def skill_sediment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sediment(once(spark, sf_dir, "suggestion"), "suggestion", ["review_id"])


@query(f"with {ONCE} select repo, file, count(distinct review_id) as n_reviews, string_agg(distinct cast(review_id as varchar), ',' order by cast(review_id as varchar)) as review_ids from f group by repo, file having count(distinct review_id) > 1")
def write_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.collect_set(F.col("review_id").cast("string"))
    return once(spark, sf_dir, "repo", "file").groupBy("repo", "file").agg(ids.alias("ids")).where(F.size("ids") > 1).select(
        "repo", "file", F.size("ids").cast("bigint").alias("n_reviews"), F.concat_ws(",", F.array_sort("ids")).alias("review_ids")
    )


@query("select f.repo, count(*) as n from findings f where not exists (select 1 from review r where r.review_id = f.review_id and r.score is not null) group by f.repo")
def findings_without_scored_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = load(spark, sf_dir, "review").where("score is not null")
    return matching.missing_references(load(spark, sf_dir, "findings"), "review_id", scored, "review_id").groupBy("repo").agg(F.count("*").alias("n"))


@query("""with r as (select review_id, max(repo) as repo, max(score) as score, max(path) as path from review group by review_id)
select repo, count(*) filter (where coalesce(score >= 60, false)) as n_ok, count(*) as n_steps, count(distinct path) as n_artifacts,
case when count(*) filter (where coalesce(score >= 60, false)) = count(*) then 'passed' else 'passed ' || count(*) filter (where coalesce(score >= 60, false)) || '/' || count(*) end as verdict from r group by repo""")
def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reviews of each repository reach 60 points, what that says, and how many files they cover."""
    steps = load(spark, sf_dir, "review").groupBy("review_id").agg(*(F.max(c).alias(c) for c in ("repo", "score", "path")))
    return scoring.delivery(steps, ["repo"], F.col("score") >= 60, F.col("path"))
