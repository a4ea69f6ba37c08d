"""Queries over source texts: rule scans, attack surface, syntax trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.operators import code_ast, rules
from sievelode.plans.catalog import query
from sievelode.session import spread
from sievelode.sources.tables import load


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _fires(text: str, rule: rules.Rule) -> str:
    hit = f"regexp_matches({text}, {_quoted(rule.pattern)})"
    return f"({hit} and not regexp_matches({text}, {_quoted(rule.unless)}))" if rule.unless else hit


ALL = " union ".join(f"select review_id, '{r.name}' as rule, '{r.dimension}' as dimension, '{r.severity}' as severity from review where {_fires('content', r)}" for r in rules.SECURITY_RULES)
LINES = "l as (select distinct review_id, i as line_no, line from (select review_id, string_split(content, chr(10)) as s from review where content is not null), unnest(s) with ordinality u(line, i))"
CASE = " ".join(f"when {_fires('line', r)} then '{r.name}'" for r in rules.SURFACE_RULES)
FIRST = " ".join(f"when {_fires('line', r)} then '{r.name}'" for r in rules.SECURITY_RULES)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "review"))


@query(ALL)
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan_texts(reviews(spark, sf_dir), "review_id", "content")


@query(f"select dimension, severity, count(*) as n from ({ALL}) group by all")
def rule_scan_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan_texts(reviews(spark, sf_dir), "review_id", "content").groupBy("dimension", "severity").agg(F.count("*").alias("n"))


@query(f"with {LINES} select review_id, cast(line_no as int) as line_no, rule from (select review_id, line_no, case {FIRST} end as rule from l) where rule is not null")
def first_rule_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan_lines(reviews(spark, sf_dir), "review_id", "content", rules.SECURITY_RULES)


@query(f"with {LINES}, x as (select review_id, line_no, case {CASE} end as surface from l) select surface, count(*) as n_lines, count(distinct review_id) as n_reviews from x where surface is not null group by surface")
def attack_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.scan_lines(reviews(spark, sf_dir), "review_id", "content", rules.SURFACE_RULES)
    return found.groupBy(F.col("rule").alias("surface")).agg(F.count("*").alias("n_lines"), F.count_distinct("review_id").alias("n_reviews"))


@query(f"with {LINES} select review_id, count(*) as n_lines, count(*) filter (where regexp_matches(line, '\\.(get|query|run)\\(')) as entries, count(*) filter (where regexp_matches(line, '\\bif\\b')) as validations from l group by review_id having count(*) filter (where regexp_matches(line, '\\.(get|query|run)\\(')) > 0")
def trust_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("content", "\n")
    n = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("bigint")
    counts = reviews(spark, sf_dir).where("content is not null").select(
        "review_id", F.size(lines).cast("bigint").alias("n_lines"), n(r"\.(get|query|run)\(").alias("entries"), n(r"\bif\b").alias("validations")
    )  # counted where the text lies
    return counts.groupBy("review_id").agg(*(F.max(c).alias(c) for c in ("n_lines", "entries", "validations"))).where("entries > 0")


@query("select distinct review_id, ref from (select review_id, unnest(regexp_extract_all(content, '[''\"]([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+)[''\"]', 1)) as ref from review where content is not null)")
def path_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.regexp_extract_all("content", F.lit("['\"]([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+)['\"]"), 1)
    return reviews(spark, sf_dir).select("review_id", F.explode(refs).alias("ref")).distinct()


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.code_facts(reviews(spark, sf_dir), lang="lang", path="path")


@query()
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir)


@query()
def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.unused_imports(_facts(spark, sf_dir).persist())


@query()
def complexity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.complexity_report(_facts(spark, sf_dir))


@query()
def bug_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("bare-except", "mutable-default", "none-compare", "syntax-error", "zero-division", "endless-loop", "unreachable", "built-query", "mutated-loop", "ignored-result")
    return _facts(spark, sf_dir).where(F.col("kind").isin(*kinds)).select("review_id", "kind", "line").distinct()


@query()
def reuse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.reuse_rules(_facts(spark, sf_dir))


@query()
def tainted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.tainted_calls(_facts(spark, sf_dir).persist(), ("get",), ("run", "append", "warning", "error", "info"))


@query()
def long_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).where("kind = 'length' and number > 20").select("review_id", "name", "line", "number")


@query()
def naming_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.naming_breaks(_facts(spark, sf_dir))


@query()
def file_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.file_outline(_facts(spark, sf_dir))


@query()
def minimalism_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.minimalism(_facts(spark, sf_dir), ("os", "re", "sys", "json", "math", "time", "logging"), ("eval", "exec", "compile", "getattr", "run"))


@query()
def import_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelode.operators import graph

    return graph.coupling(code_ast.module_edges(_facts(spark, sf_dir), reviews(spark, sf_dir)).persist())


@query()
def undefined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.undefined_names(_facts(spark, sf_dir).persist())


@query()
def outward_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.outward_data(_facts(spark, sf_dir), ("requests", "urllib", "http", "socket", "ftplib", "smtplib", "aiohttp", "httpx"))


@query()
def threat_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.threat_model(_facts(spark, sf_dir), ("get", "input", "read", "recv"), ("run", "eval", "exec", "system", "write"))


@query("""with r as (select distinct repo, ref from (select repo, unnest(regexp_extract_all(content, '[''"]([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+)[''"]', 1)) as ref from review where content is not null)),
k as (select distinct repo, regexp_replace(replace(path, chr(92), '/'), '[.][a-z]+$', '') as ref from review where path is not null) select repo, count(*) as n_broken from r anti join k using (repo, ref) group by repo""")
def broken_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    refs = F.regexp_extract_all("content", F.lit("['\"]([A-Za-z0-9_-]+/[A-Za-z0-9_/-]+)['\"]"), 1)
    named = rows.select("repo", F.explode(refs).alias("ref")).distinct()
    known = rows.where("path is not null").select("repo", F.regexp_replace(F.translate("path", "\\", "/"), "[.][a-z]+$", "").alias("ref")).distinct()
    return named.join(known, ["repo", "ref"], "left_anti").groupBy("repo").agg(F.count("*").alias("n_broken"))
