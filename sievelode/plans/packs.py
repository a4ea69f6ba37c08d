"""Queries of the rule packs, and reviews put together from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.functions.scalar import severity_weight
from sievelode.operators import packs, rules, scoring
from sievelode.plans.catalog import query
from sievelode.plans.findings import ONCE, SEVERITY, once
from sievelode.session import spread
from sievelode.sources.tables import load

LINES = "l as (select distinct review_id, i as line_no, line from (select review_id, string_split(content, chr(10)) as s from review where content is not null), unnest(s) with ordinality u(line, i))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fires(text: str, rule: packs.PackRule) -> str:
    hit = f"regexp_matches({text}, {_quoted(rule.pattern)})"
    if rule.also:
        hit += f" and regexp_matches({text}, {_quoted(rule.also)})"
    return hit + (f" and not regexp_matches({text}, {_quoted(rule.unless)})" if rule.unless else "")


def _union(rules: tuple[packs.PackRule, ...], table: str = "review") -> str:
    return " union ".join(f"select review_id, '{r.name}' as rule, '{r.pack}' as pack, '{r.severity}' as severity, '{packs.tier_of(r)}' as tier from {table} where {_fires('content', r)}" for r in rules)


def dimension_sql() -> str:
    """The security dimensions over all reviews, for queries that reach the same another way."""
    return _union(packs.DIMENSION_RULES)


def _line(pattern: str, text: str = "content") -> str:
    before = f"regexp_extract({text}, {_quoted('(?s:^(.*?))(?:' + pattern + ')')}, 1)"
    return f"length({before}) - length(replace({before}, chr(10), '')) + 1"


DEFECTS = " union ".join(f"select review_id, '{r.name}' as rule, '{r.severity}' as severity, '{packs.tier_of(r)}' as tier, cast({_line(r.pattern)} as int) as line from review where {_fires('content', r)}" for r in packs.KNOWN_DEFECTS)
SECRET = " ".join(f"when regexp_matches(line, {_quoted(r.pattern)}) then {i}" for i, r in enumerate(packs.SECRET_RULES))
EXCERPT = " ".join(f"when {i} then regexp_extract(line, {_quoted(r.pattern)}, 0)" for i, r in enumerate(packs.SECRET_RULES))
NAMES = ", ".join(f"({i}, '{r.name}', '{r.severity}', '{'P0' if r.severity == 'critical' else 'P1'}')" for i, r in enumerate(packs.SECRET_RULES))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "review"))


@query(_union(packs.DIMENSION_RULES))
def dimension_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.scan_packs(reviews(spark, sf_dir), "review_id", "content", packs.DIMENSION_RULES)


@query(_union(packs.NETWORK_RULES))
def network_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.scan_packs(reviews(spark, sf_dir), "review_id", "content", packs.NETWORK_RULES)


@query(_union(packs.GUARD_RULES))
def command_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.scan_packs(reviews(spark, sf_dir), "review_id", "content", packs.GUARD_RULES)


@query(" union ".join(f"select file_id, '{r.name}' as rule, '{r.severity}' as severity, '{packs.tier_of(r)}' as tier, cast({_line(r.pattern, 'src')} as int) as line from dep_audit where {_fires('src', r)}" for r in packs.KNOWN_DEFECTS))
def known_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.scan_defects(load(spark, sf_dir, "dep_audit"), "file_id", "src")


@query(f"""with {LINES}, m as (select review_id, line_no, line, case {SECRET} end as i from l), n(i, rule, severity, tier) as (values {NAMES})
select review_id, cast(line_no as int) as line_no, rule, severity, tier, substr(case m.i {EXCERPT} end, 1, 24) || '…' as excerpt from m join n on m.i = n.i""")
def secret_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.scan_secrets(reviews(spark, sf_dir), "review_id", "content")


@query(f"select pack, rule, tier, count(*) as n_reviews from ({_union(packs.TEXT_PACKS)}) group by all")
def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many reviews break each rule of all packs, in one scan of the texts."""
    return packs.scan_packs(reviews(spark, sf_dir), "review_id", "content").groupBy("pack", "rule", "tier").agg(F.count("*").alias("n_reviews"))


WEIGHT = "case severity when 'critical' then 20 when 'major' then 10 when 'minor' then 3 else 5 end"
FILE_REVIEW = f"""hits as ({_union(packs.TEXT_PACKS)}), defects as ({DEFECTS}), issues as (select review_id, rule, severity, tier from hits union all select review_id, rule, severity, tier from defects),
s as (select review_id, sum({WEIGHT}) as cost, count(*) as n, count(*) filter (where tier = 'P0') as p0, count(*) filter (where tier = 'P1') as p1, count(*) filter (where tier = 'P2') as p2, count(*) filter (where severity in ('critical', 'major')) as baseline from issues group by review_id)"""
SCORED = """select r.review_id, cast(greatest(0, 100 - coalesce(cost, 0)) as bigint) as score, coalesce(n, 0) as n_issues, coalesce(p0, 0) as p0, coalesce(p1, 0) as p1, coalesce(p2, 0) as p2, coalesce(baseline, 0) as security_baseline"""


def _scored(rows: DataFrame) -> DataFrame:
    """Score, tiers and baseline (critical and major issues) of every row with a text."""
    hits = packs.scan_packs(rows, "review_id", "content").select("review_id", "rule", "severity", "tier")
    issues = hits.unionByName(packs.scan_defects(rows, "review_id", "content").select("review_id", "rule", "severity", "tier"))
    tiers = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("P0", "P1", "P2")]
    sums = issues.groupBy("review_id").agg(F.sum(severity_weight(F.col("severity"))).alias("cost"), F.count("*").alias("n_issues"), *tiers, F.count_if(F.col("severity").isin("critical", "major")).alias("security_baseline"))
    zero = ["n_issues", "p0", "p1", "p2", "security_baseline", "cost"]
    return rows.where("content is not null").select("review_id").distinct().join(sums, "review_id", "left").fillna(0, zero).withColumn("score", F.greatest(F.lit(0), 100 - F.col("cost")).cast("bigint")).drop("cost")


@query(f"with {FILE_REVIEW} {SCORED} from (select distinct review_id from review where content is not null) r left join s using (review_id)")
def file_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static review of every file: all packs and known defects, scored and counted by tier."""
    return _scored(reviews(spark, sf_dir))


MODES = ("code", "design", "layout", "content")
_MARKS = " ".join(f"when contains(lower(content), '{w.lower()}') then '{w}'" for w in rules.UNFINISHED)
MODE_ISSUES = f"""mi as (select review_id, 'design' as mode, 'loose' as issue from review where (length(content) - length(replace(content, chr(10) || chr(10), ''))) / 2 > 30
union select review_id, 'design', 'thin' from review where len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) < 40
union select review_id, 'layout', 'no-media' from review where path like '%.html' and not contains(content, '@media')
union select review_id, 'layout', 'long-line' from review where list_max(list_transform(string_split(content, chr(10)), lambda l: length(l))) > 160
union select review_id, 'content', issue from (select review_id, case {_MARKS} end as issue from review) where issue is not null)"""


@query(f"with {MODE_ISSUES} select * from mi")
def mode_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mode_rules(reviews(spark, sf_dir), "review_id", "content", "path")


@query(f"""with {FILE_REVIEW}, {MODE_ISSUES}, t as ({SCORED} from (select distinct review_id from review where content is not null) r left join s using (review_id)), n as (select review_id, mode, count(*) as k from mi group by all)
select t.review_id, m.mode, greatest(0, score - 3 * coalesce(k, 0)) as score, coalesce(k, 0) as n_mode_issues from t, (select unnest({list(MODES)}) as mode) m left join n on n.review_id = t.review_id and n.mode = m.mode""")
def mode_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every file in each mode of review: that of its static review less three points for each issue of the mode."""
    found = rules.mode_rules(reviews(spark, sf_dir), "review_id", "content", "path").groupBy("review_id", "mode").agg(F.count("*").alias("n_mode_issues"))
    every = file_review(spark, sf_dir).select("review_id", "score", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    both = every.join(found, ["review_id", "mode"], "left").fillna(0, ["n_mode_issues"])
    return both.select("review_id", "mode", F.greatest(F.lit(0), F.col("score") - 3 * F.col("n_mode_issues")).alias("score"), "n_mode_issues")


CHANGED = """seen as (select review_id, repo, path, reviewed_at, sha256(coalesce(content, '')) as h from review where path is not null and reviewed_at is not null),
one as (select distinct review_id, repo, path, reviewed_at, h from seen), w as (select *, lag(h) over (partition by repo, path order by reviewed_at, review_id, h) as before from one), changed as (select distinct review_id from w where before is null or before <> h)"""


def _changed(rows: DataFrame) -> DataFrame:
    """``review_id`` of reviews whose text differs from the path's review before, or that are its first. Only digests are shuffled."""
    from pyspark.sql import window

    one = rows.where("path is not null and reviewed_at is not null").select("review_id", "repo", "path", "reviewed_at", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).distinct()
    before = F.lag("h").over(window.Window.partitionBy("repo", "path").orderBy("reviewed_at", "review_id", "h"))
    return one.withColumn("before", before).where("before is null or before <> h").select("review_id").distinct()


@query(f"with {FILE_REVIEW}, {CHANGED}, t as ({SCORED} from (select distinct review_id from review where content is not null) r join changed using (review_id) left join s using (review_id)) select review_id, score, n_issues, security_baseline, p0, p1, p2 from t")
def light_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static review of the reviews whose file changed since its review before."""
    rows = reviews(spark, sf_dir)
    return _scored(rows).join(_changed(rows), "review_id", "left_semi")


@query(f"""with {FILE_REVIEW}, t as ({SCORED} from (select distinct review_id from review where content is not null) r left join s using (review_id)), home as (select review_id, max(repo) as repo from review group by review_id)
select repo, count(*) as n_files, cast(round_even(avg(score), 0) as bigint) as average, cast(sum(p0) as bigint) as p0, cast(sum(p1) as bigint) as p1, cast(sum(p2) as bigint) as p2, case when sum(security_baseline) > 0 then 'fail' when sum(n_issues) > 0 then 'warn' else 'pass' end as verdict from t join home using (review_id) group by repo""")
def project_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, tiers and verdict of each repository over the static reviews of its files."""
    home = reviews(spark, sf_dir).groupBy("review_id").agg(F.max("repo").alias("repo"))
    verdict = F.when(F.sum("security_baseline") > 0, "fail").when(F.sum("n_issues") > 0, "warn").otherwise("pass")
    return file_review(spark, sf_dir).join(home, "review_id").groupBy("repo").agg(
        F.count("*").alias("n_files"), F.bround(F.avg("score"), 0).cast("bigint").alias("average"), *(F.sum(t).alias(t) for t in ("p0", "p1", "p2")), verdict.alias("verdict")
    )


@query(f"""with x as (select distinct review_id, content from review where content is not null), y as (select review_id, length(content) - length(regexp_replace(content, {_quoted(rules.RULE_COMMENT)}, '', 'g')) as n from x) select review_id, max(n) as emptied_chars from y where n > 0 group by review_id""")
def self_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of comment lines that only name what rules look for, and are left out before a scan of rules."""
    n = F.length("content") - F.length(rules.without_rule_comments(F.col("content")))
    return reviews(spark, sf_dir).where("content is not null").select("review_id", n.cast("bigint").alias("n")).where("n > 0").groupBy("review_id").agg(F.max("n").alias("emptied_chars"))


COUNT = "len(list_filter(string_split(replace(content, chr(13), ''), chr(10)), lambda x: regexp_matches(x, '{0}')))"


@query(f"""with x as (select review_id, len(string_split(content, chr(10))) as n_lines, {COUNT.format('^[ ' + chr(9) + ']*$')} as n_blank, {COUNT.format('^[ ' + chr(9) + ']*(#|//|[*]|/[*])')} as n_comment, {COUNT.format('^[ ' + chr(9) + ']*(if|elif|else|for|while|except|catch|case|switch)' + chr(92) + 'b')} as n_branches from review where content is not null)
select review_id, max(n_lines) as n_lines, max(n_blank) as n_blank, max(n_comment) as n_comment, max(n_branches) as n_branches, max(n_lines) - max(n_blank) - max(n_comment) as n_code from x group by review_id""")
def line_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.line_estimates(reviews(spark, sf_dir), "review_id", "content")


GUARDS = f"""a as (select repo, case when bool_or(coalesce({SEVERITY} in ('critical','high'), false)) then 'fail' else 'warn' end as verdict from f group by repo),
b as (select repo, case when bool_or(tier = 'P0') then 'fail' else 'warn' end as verdict from ({_union(packs.TEXT_PACKS)}) join (select review_id, max(repo) as repo from review group by review_id) using (review_id) group by repo)"""


@query(f"with {ONCE}, {GUARDS}, g as (select * from a union all select * from b) select repo, case when bool_or(verdict = 'fail') then 'fail' when bool_or(verdict = 'warn') then 'warn' else 'pass' end as verdict, count(*) as n_guards from g group by repo")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two guards over each repository, its findings and the packs over its files, merged to the worst."""
    home = reviews(spark, sf_dir).groupBy("review_id").agg(F.max("repo").alias("repo"))
    hits = packs.scan_packs(reviews(spark, sf_dir), "review_id", "content").join(home, "review_id")
    by_packs = hits.groupBy("repo").agg(F.when(F.bool_or(F.col("tier") == "P0"), "fail").otherwise("warn").alias("verdict"))
    by_findings = scoring.guard_verdicts(once(spark, sf_dir, "repo", "severity"), ["repo"])
    return scoring.merged_verdicts([by_findings, by_packs], ["repo"])
