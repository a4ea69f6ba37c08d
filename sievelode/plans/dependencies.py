"""Queries over requirement lines, signatures and scanned files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.functions.scalar import normal_path
from sievelode.operators import matching, scoring, state
from sievelode.plans.catalog import query
from sievelode.sources import readers
from sievelode.sources.tables import load

PARSED = """raw as (select distinct line_id, repo, source, line from dep_lines where line is not null and regexp_matches(line, '^\\s*[A-Za-z0-9]')),
m as (select *, regexp_extract(line, '^\\s*([A-Za-z0-9][A-Za-z0-9_.-]*)\\s*(?:\\[[^\\]]*\\])?\\s*(?:(==|>=|<=|~=|!=|>|<)\\s*([0-9A-Za-z_.*+-]+))?', ['name', 'op', 'version']) as x from raw),
parsed as (select line_id, repo, source, lower(x.name) as name, x.op as op, case when x.version = '' then '*' else x.version end as version from m)"""
MERGED = f"{PARSED}, merged as (select repo, name, coalesce(min_by(version, line_id) filter (where version <> '*'), '*') as version, string_agg(distinct source, ',' order by source) as sources, count(distinct line_id) as n_lines from parsed group by repo, name)"
KEY = "(list_transform(list_concat(regexp_extract_all({0}, '\\d+'), ['0','0','0'])[1:3], lambda x: cast(x as int)))"
POLICY = [("deny", "*/node_modules/*"), ("deny", "*.min.js"), ("ask", "*/vendor/*"), ("ask", "tests/*"), ("ask", "*_pb2.py"), ("allow", "src/*"), ("allow", "lib/*"), ("allow", "tests/*_?i*.py")]
CLEAN_PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(file, '\\', '/'), '^[A-Za-z]:', ''), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '^/', '')"


def _fits(actions: str) -> str:
    return " or ".join(f"regexp_full_match(p, '{matching.glob_pattern(g)[1:-1]}', 's')" for a, g in POLICY if a == actions)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "dep_lines").select("line_id", "repo", "source", "line").distinct()
    return matching.parse_requirements(lines)


@query(f"with {PARSED} select * from parsed")
def requirement_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("line_id", "repo", "source", "name", "op", "version")


@query(f"with {MERGED} select * from merged")
def requirement_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.merge_requirements(parsed(spark, sf_dir))


@query(f"""with {MERGED}, s as (select sig_id, lower(package) as name, {KEY.format('lo')} as lo_key, {KEY.format('hi')} as hi_key, lo, hi, severity from signatures)
select m.repo, m.name, m.version, s.sig_id, s.severity from merged m join s using (name) where m.version <> '*' and (lo is null or {KEY.format('m.version')} >= lo_key) and (hi is null or {KEY.format('m.version')} <= hi_key)""")
def version_range_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.vulnerable(matching.merge_requirements(parsed(spark, sf_dir)), load(spark, sf_dir, "signatures"))


@query(f"with {MERGED} select m.repo, m.name, 'info' as severity, count(*) as n_signatures from merged m join signatures s on lower(s.package) = m.name where m.version = '*' group by m.repo, m.name")
def unpinned_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = matching.merge_requirements(parsed(spark, sf_dir)).where("version = '*'")
    names = load(spark, sf_dir, "signatures").select(F.lower("package").alias("name"))
    return merged.join(names, "name").groupBy("repo", "name").agg(F.lit("info").alias("severity"), F.count("*").alias("n_signatures"))


@query(f"with {PARSED} select repo, name, count(distinct version) as n_versions, string_agg(distinct version, ',' order by version) as versions from parsed where version <> '*' group by repo, name having count(distinct version) > 1")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = parsed(spark, sf_dir).where("version <> '*'")
    return pinned.groupBy("repo", "name").agg(F.collect_set("version").alias("v")).where(F.size("v") > 1).select(
        "repo", "name", F.size("v").cast("bigint").alias("n_versions"), F.concat_ws(",", F.array_sort("v")).alias("versions")
    )


@query(f"with {PARSED}, p as (select name, max_by(repo, repo) as provider, count(distinct repo) as n_repos from parsed group by name) select * from p")
def provider_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).groupBy("name").agg(F.max("repo").alias("provider"), F.count_distinct("repo").alias("n_repos"))


@query("""with a as (select distinct repo from dep_audit), b as (select distinct repo from call_edges), c as (select distinct repo from dep_lines)
select coalesce(a.repo, b.repo) as repo, case when a.repo is null then 'only_edges' when b.repo is null then 'only_files' else 'both' end as side, exists (select 1 from c where c.repo = coalesce(a.repo, b.repo)) as has_requirements from a full outer join b on a.repo = b.repo""")
def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "dep_audit").select("repo").distinct().withColumn("a", F.lit(True))
    edges = load(spark, sf_dir, "call_edges").select("repo").distinct().withColumn("b", F.lit(True))
    lines = load(spark, sf_dir, "dep_lines").select("repo").distinct().withColumn("c", F.lit(True))
    side = F.when(F.col("a").isNull(), "only_edges").when(F.col("b").isNull(), "only_files").otherwise("both")
    return files.join(edges, "repo", "full_outer").join(lines, "repo", "left").select("repo", side.alias("side"), F.col("c").isNotNull().alias("has_requirements"))


@query(f"with x as (select distinct file_id, {CLEAN_PATH} as p from dep_audit where file is not null) select file_id, case when {_fits('deny')} then 'deny' when {_fits('ask')} then 'ask' when {_fits('allow')} then 'allow' else 'ask' end as decision from x")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("file_id", "file").distinct()
    return matching.decide(files, "file", POLICY, ("deny", "ask", "allow"), "ask").select("file_id", "decision").distinct()


@query(f"with x as (select distinct file_id, {CLEAN_PATH} as p from dep_audit where file is not null) select file_id, case when {_fits('deny')} then 'deny' when {_fits('allow')} then 'allow' when {_fits('ask')} then 'ask' else 'ask' end as decision from x")
def policy_variant_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("file_id", "file").distinct()
    return matching.decide(files, "file", POLICY, ("deny", "allow", "ask"), "ask").select("file_id", "decision").distinct()


RISKY = ("token", "schema", "policy", "secret", "deploy")  # words of paths that ask for a second look


@query(f"with x as (select distinct file_id, {CLEAN_PATH} as p from dep_audit where file is not null), d as (select file_id, p, case when {_fits('deny')} then 'deny' when {_fits('ask')} then 'ask' when {_fits('allow')} then 'allow' else 'allow' end as decision from x) select distinct file_id, case when decision <> 'deny' and regexp_matches(lower(p), '{'|'.join(RISKY)}') then 'ask' else decision end as decision from d")
def policy_escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by rules, allowed by default, raised to a question where the path has a risky word."""
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("file_id", "file").distinct()
    decided = matching.decide(files, "file", POLICY, ("deny", "ask", "allow"), "allow")
    return matching.escalated(decided, normal_path(F.col("file")), RISKY).select("file_id", "decision").distinct()


@query(f"""with x as (select distinct repo, file_id, {CLEAN_PATH} as p from dep_audit where file is not null), y as (select repo, file_id, list_position(list_transform(['app','pkg','lib','src','tools','tests'], lambda s: list_contains(string_split(p, '/'), s)), true) as place from x)
select repo, (['app','pkg','lib','src','tools','tests'])[place] as layer, count(distinct file_id) as n_files from y where place is not null group by all""")
def layer_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(normal_path(F.col("file")), "/")
    layer = F.lit(None).cast("string")
    for name in ("tests", "tools", "src", "lib", "pkg", "app"):
        layer = F.when(F.array_contains(parts, name), name).otherwise(layer)
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("repo", "file_id", layer.alias("layer")).distinct()
    return files.where("layer is not null").groupBy("repo", "layer").agg(F.count_distinct("file_id").alias("n_files"))


@query("""with k as (select count(*) as n_rows, count(distinct file_id) as n_keys from dep_audit), x as (select 'file' as "column", count(*) filter (where file is null) as n_null, count(*) filter (where trim(file) = '') as n_blank from dep_audit
union all select 'src', count(*) filter (where src is null), count(*) filter (where trim(src) = '') from dep_audit union all select 'lang', count(*) filter (where lang is null), count(*) filter (where trim(lang) = '') from dep_audit) select x.*, n_rows, n_keys from x, k""")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.quality(load(spark, sf_dir, "dep_audit"), ["file_id"], ["file", "src", "lang"])


@query("select file_id, count(*) as n from dep_audit group by file_id having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "dep_audit").groupBy("file_id").agg(F.count("*").alias("n")).where("n > 1")


@query("""with a as (select repo, path, max_by(coalesce(content, ''), struct_pack(r := reviewed_at, i := review_id)) as c from review where path is not null and reviewed_at < timestamp '2025-04-01' group by repo, path),
b as (select repo, path, max_by(coalesce(content, ''), struct_pack(r := reviewed_at, i := review_id)) as c from review where path is not null and reviewed_at >= timestamp '2025-04-01' group by repo, path)
select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, case when a.c is null then 'new' when b.c is null then 'gone' when a.c = b.c then 'same' else 'changed' end as status from a full outer join b on a.repo = b.repo and a.path = b.path""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "review").where("path is not null")
    cut = F.lit("2025-04-01").cast("timestamp")
    old, new = (state.snapshot(rows.where(c), ["repo", "path"], "content", ["reviewed_at", "review_id"]) for c in (F.col("reviewed_at") < cut, F.col("reviewed_at") >= cut))
    return state.compare_snapshots(old, new, ["repo", "path"])


@query("""with one as (select distinct review_id, repo, path, score, reviewed_at from review where path is not null and reviewed_at is not null), d as (select review_id, repo, path, max(score) as score, max(reviewed_at) as reviewed_at from one group by all),
w as (select *, lag(score) over (partition by repo, path order by reviewed_at, review_id, score) as before, row_number() over (partition by repo, path order by reviewed_at, review_id, score) as rn from (select review_id, repo, path, max(score) as score, max(reviewed_at) as reviewed_at from one group by review_id, repo, path))
select review_id, repo, path, coalesce(rn = 1 or score > before, false) as kept from w""")
def kept_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "review").where("path is not null and reviewed_at is not null")
    one = rows.groupBy("review_id", "repo", "path").agg(F.max("score").alias("score"), F.max("reviewed_at").alias("reviewed_at"))
    return state.kept_or_rolled_back(one, ["repo", "path"], ["reviewed_at", "review_id", "score"], "score").select("review_id", "repo", "path", "kept")


@query("select review_id, max(loaded_at) as loaded_at, max_by(score, loaded_at) as score_last from review where score is not null group by review_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.latest(load(spark, sf_dir, "review").where("score is not null").select("review_id", "loaded_at", "score"), ["review_id"], "loaded_at")
    return rows.select("review_id", "loaded_at", F.col("score").alias("score_last"))


RULE = " ".join(f"when regexp_full_match(p, '{matching.glob_pattern(g)[1:-1]}', 's') then '{g}'" for action in ("deny", "ask", "allow") for a, g in POLICY if a == action)


@query(f"with x as (select distinct file_id, {CLEAN_PATH} as p from dep_audit where file is not null), y as (select distinct file_id, case {RULE} end as rule from x) select rule, count(*) as n_files from y group by rule")
def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule decides how many files; null for those that none fits."""
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("file_id", "file").distinct()
    rows = matching.decide(files, "file", POLICY, ("deny", "ask", "allow"), "ask").select("file_id", "rule").distinct()
    return rows.groupBy("rule").agg(F.count("*").alias("n_files"))


KIND = "case " + " ".join(f"when regexp_matches(p, '{pattern}') then '{kind}'" for kind, pattern in readers.DEPENDENCY_FILES) + " end"


@query(f"with x as (select distinct repo, file_id, {CLEAN_PATH} as p from dep_audit where file is not null union select distinct repo, line_id, source from dep_lines), y as (select repo, p, {KIND} as kind from x) select repo, kind, count(distinct p) as n_paths from y where kind is not null group by all")
def dependency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of dependency files that each repository has, by the paths of its files and the sources of its requirement lines."""
    files = load(spark, sf_dir, "dep_audit").where("file is not null").select("repo", normal_path(F.col("file")).alias("p"))
    rows = files.unionByName(load(spark, sf_dir, "dep_lines").select("repo", F.col("source").alias("p"))).distinct()
    return rows.withColumn("kind", readers.dependency_file(F.col("p"))).where("kind is not null").groupBy("repo", "kind").agg(F.count_distinct("p").alias("n_paths"))


@query("with w as (select distinct line_id, unnest(regexp_extract_all(lower(line), '[a-z0-9][a-z0-9_-]*')) as name from dep_lines where line is not null) select line_id, name from w where name in (select lower(package) from signatures)")
def package_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement lines, comments included, that name a package with a known signature."""
    return matching.mentions(load(spark, sf_dir, "dep_lines"), "line_id", "line", load(spark, sf_dir, "signatures"), "package")
