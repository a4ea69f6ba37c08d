"""Queries of data flows, cognitive complexity, layers, and reports put together from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.operators import code_ast, graph, matching, state, taint
from sievelode.plans import dependencies
from sievelode.plans.catalog import query
from sievelode.plans.findings import ONCE, SEVERITY, once
from sievelode.plans.graphs import COUPLING, EDGES, edges
from sievelode.plans.search import keywords_sql
from sievelode.session import spread, written
from sievelode.sources.tables import load


def _flow_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(taint.flow_facts(spread(load(spark, sf_dir, "review"))))  # files are parsed once


@query()
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from the sources and lookups of these files to the sinks and the calls by which they query, store and log."""
    return taint.taint_flows(_flow_facts(spark, sf_dir), sources=(*taint.SOURCES, "get", "load"), sinks=(*taint.SINKS, "run", "query", "append", "info", "error", "warning"))


@query()
def named_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taint.named_flows(_flow_facts(spark, sf_dir))


@query()
def flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo``, ``n_vulnerable``, ``n_flows``, ``n_severe``: vulnerable packages and flows of each repository."""
    rows = load(spark, sf_dir, "review")
    facts = _flow_facts(spark, sf_dir)
    flows = taint.named_flows(facts).join(rows.groupBy("review_id").agg(F.max("repo").alias("repo")), "review_id").select("repo", F.lit("flow").alias("kind"), "severity")
    packages = matching.vulnerable(matching.merge_requirements(dependencies.parsed(spark, sf_dir)), load(spark, sf_dir, "signatures"))
    both = flows.unionByName(packages.select("repo", F.lit("package").alias("kind"), "severity"))
    return both.groupBy("repo").agg(
        F.count_if(F.col("kind") == "package").alias("n_vulnerable"), F.count_if(F.col("kind") == "flow").alias("n_flows"), F.count_if(F.col("severity").isin("critical", "high")).alias("n_severe")
    )


@query()
def adversarial_by_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _flow_facts(spark, sf_dir)
    return taint.adversarial(once(spark, sf_dir, "title", "line", "severity"), taint.taint_flows(facts, sources=(*taint.SOURCES, "get", "load"), sinks=(*taint.SINKS, "run", "query")), facts)


@query()
def adversarial_by_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of sinks, and of the calls by which these files store and log, with what flows and learned sinks say of them."""
    facts = _flow_facts(spark, sf_dir)
    sinks, doubtful = (*taint.SINKS, "run", "query"), ("append", "info", "error", "warning")
    flows = written(taint.taint_flows(facts, sources=(*taint.SOURCES, "get", "load"), sinks=(*sinks, *doubtful)))
    return taint.sink_verdicts(facts, flows, taint.learned_sinks(flows, least=20), sinks, doubtful)


@query()
def function_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_ast.function_report(code_ast.code_facts(spread(load(spark, sf_dir, "review")), lang="lang", path="path"))


# ---- graphs ----

#: Layers of modules by words of their names, from the lowest up (a fixed value of these queries).
LAYERS = (("storage", "table|store|cache|buffer|index|log|snapshot"), ("model", "record|schema|value|field|entry|token|node"), ("logic", "rule|scan|parse|merge|sort|rank|policy|check"), ("service", "handle|dispatch|worker|task|queue|stream"), ("surface", "view|page|report|export|render|api"))


def _layer_sql(column: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '[.](?:{words})_') then {i}" for i, (_, words) in enumerate(LAYERS)) + " else -1 end"


def _layer(column: str):
    out = F.lit(-1)
    for i in range(len(LAYERS) - 1, -1, -1):
        out = F.when(F.col(column).rlike(f"[.](?:{LAYERS[i][1]})_"), i).otherwise(out)
    return out


@query(f"""with x as (select distinct repo, src, dst, {_layer_sql('src')} as a, {_layer_sql('dst')} as b from call_edges where kind = 'import' and src is not null and dst is not null and src <> dst)
select repo, src, dst, a as from_layer, b as to_layer, case when a < 0 or b < 0 then 'unlayered' when a = b then 'same' when b < a then 'down' else 'up' end as direction from x""")
def layer_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every import between modules with the layers of both ends: dependencies go down or stay; up is a violation."""
    return graph.layer_direction(edges(spark, sf_dir).where("kind = 'import'"), _layer("src"), _layer("dst"))


@query(f"with {COUPLING} select repo, module, fan_in, fan_out, fan_in + fan_out as surface, cast(rank as int) as rank from (select *, row_number() over (partition by repo order by fan_in + fan_out desc, module) as rank from c) where rank <= 5")
def coupling_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five modules of each repository with the widest surface; the report's order."""
    rows = graph.coupling(edges(spark, sf_dir)).withColumn("surface", F.col("fan_in") + F.col("fan_out"))
    return state.last_n(rows, ["repo"], [F.desc("surface"), F.asc("module")], 5).withColumnRenamed("place", "rank")


RINGS = "t(repo, src, dst) as (select repo, src, dst from e union select t.repo, t.src, e.dst from t join e on e.repo = t.repo and e.src = t.dst)"


@query(f"""with recursive {EDGES}, {RINGS}, ring as (select repo, count(distinct src) as n_cyclic from t where src = dst group by repo), m as (select repo, count(distinct x) as n_modules from (select repo, src as x from e union all select repo, dst from e) group by repo)
select m.repo, n_modules, (select count(*) from e where e.repo = m.repo) as n_edges, coalesce(n_cyclic, 0) as n_cyclic from m left join ring using (repo)""")
def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules, edges and modules on cycles of each repository."""
    e = edges(spark, sf_dir)
    simple = graph.simple_edges(e)
    counts = simple.groupBy("repo").agg(F.count("*").alias("n_edges"))
    modules = simple.select("repo", F.explode(F.array("src", "dst")).alias("m")).groupBy("repo").agg(F.count_distinct("m").alias("n_modules"))
    rings = graph.components(e).groupBy("repo").agg(F.count("*").alias("n_cyclic"))
    return modules.join(counts, "repo").join(rings, "repo", "left").fillna(0, ["n_cyclic"])


@query()
def issue_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many Python files of the repository import the file of each finding; findings that none imports are left out."""
    rows = load(spark, sf_dir, "review")
    imports = code_ast.module_edges(code_ast.code_facts(rows, lang="lang", path="path"), rows)
    callers = imports.select("repo", F.element_at(F.split("dst", r"\."), -1).alias("stem"), "src").distinct().groupBy("repo", "stem").agg(F.count("*").alias("n_callers"))
    stem = F.regexp_extract("file", r"([^/\\\\.]+)(?:\.[^/\\\\]*)?$", 1)
    return once(spark, sf_dir, "repo", "file").withColumn("stem", stem).join(callers, ["repo", "stem"]).select("review_id", "ord", "n_callers")


TEST_MODULE = "[.](?:test_[a-z0-9_]+|test)(?:[.]|$)"


@query(f"""with recursive {EDGES}, m as (select repo, max(loaded_at) as last from call_edges group by repo), ch as (select distinct c.repo, c.src as module from call_edges c join m on m.repo = c.repo where c.src is not null and c.loaded_at > m.last - interval 720 hours),
r(repo, module, depth) as (select repo, module, 0 from ch union select r.repo, e.src, r.depth + 1 from r join e on e.repo = r.repo and e.dst = r.module where r.depth < 10)
select repo, module as test, cast(min(depth) as int) as steps from r where regexp_matches(module, '{TEST_MODULE}') group by repo, module""")
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test modules (by name) that depend on what was loaded in each repository's last thirty days, over at most ten edges."""
    e = edges(spark, sf_dir)
    last = e.groupBy("repo").agg(F.max("loaded_at").alias("last"))
    changed = e.join(last, "repo").where("loaded_at > last - interval 720 hours").select("repo", F.col("src").alias("module"))
    return graph.affected_tests(e, changed, F.col("module").rlike(TEST_MODULE))


@query(f"""with recursive {EDGES}, seeds as (select repo, min(src) as a, max(dst) as b from e group by repo), r(repo, b, module, depth) as (select repo, b, a, 0 from seeds union select r.repo, r.b, e.dst, r.depth + 1 from r join e on e.repo = r.repo and e.src = r.module where r.depth < 400)
select s.repo, s.a as src, s.b as dst, cast(coalesce((select min(depth) from r where r.repo = s.repo and r.module = s.b), -1) as int) as steps from seeds s""".replace(" where r.depth < 400", " where r.depth < 60"))
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from the first to the last module of each repository by name; -1 where no path leads there."""
    e = edges(spark, sf_dir)
    ends = graph.simple_edges(e).groupBy("repo").agg(F.min("src").alias("src"), F.max("dst").alias("dst"))
    return graph.path_lengths(e, ends)


# ---- evidence against findings, memory, budgets ----


@query(f"with {ONCE} select review_id, count(*) as n_findings, count(*) filter (where coalesce({SEVERITY} in ('critical', 'major'), false)) as n_baseline, min(case when {SEVERITY} = 'critical' then 0 when {SEVERITY} = 'major' then 1 else 2 end) as worst from f group by review_id having count(*) filter (where coalesce({SEVERITY} in ('critical', 'major'), false)) > 0")
def security_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with critical or major findings: how many, and the worst of them."""
    clean = F.regexp_replace(F.lower("severity"), "[^a-z]", "")
    rank = F.when(clean == "critical", 0).when(clean == "major", 1).otherwise(2)
    severe = F.coalesce(clean.isin("critical", "major"), F.lit(False))
    return once(spark, sf_dir, "severity").groupBy("review_id").agg(F.count("*").alias("n_findings"), F.count_if(severe).alias("n_baseline"), F.min(rank).alias("worst")).where("n_baseline > 0")


WORDS = keywords_sql("(coalesce(title, '') || ' ' || coalesce(suggestion, ''))")


@query(f"""with {ONCE}, w as (select review_id, ord, coalesce(nullif(suggestion, ''), title) as prediction, {WORDS} as w from f)
select review_id, ord, prediction, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1])[1:12], ' ') as keywords from w where prediction is not null and prediction <> ''""")
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each finding for later: its suggestion (else its title) and at most twelve keywords."""
    return state.lessons(once(spark, sf_dir, "title", "suggestion"), ["review_id", "ord"], "title", "suggestion")


@query("""select doc_id, case when length(text) < 30 then 'simple' when length(text) < 80 then 'medium' else 'complex' end as size, case when length(text) < 30 then 3 when length(text) < 80 then 5 else 8 end as rounds, (case when length(text) < 30 then 3 when length(text) < 80 then 5 else 8 end) * (case when lang = 'en' then 2 else 3 end) as calls from (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents)""")
def budget_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds and calls that a task of this text is given, by its length."""
    n = F.length(F.coalesce("text", F.lit("")))
    size = F.when(n < 30, "simple").when(n < 80, "medium").otherwise("complex")
    rounds = F.when(n < 30, 3).when(n < 80, 5).otherwise(8)
    return load(spark, sf_dir, "documents").select("doc_id", size.alias("size"), rounds.alias("rounds"), (rounds * F.when(F.col("lang") == "en", 2).otherwise(3)).alias("calls"))


@query("select doc_id, case when length(text) > 200 then text[1:200] || '…' else text end as compact, length(text) > 200 as cut from documents where text is not null")
def payload_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 200 characters with a mark; shorter ones stay."""
    long = F.length("text") > 200
    return load(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(long, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.col("text")).alias("compact"), long.alias("cut"))


@query("""with s as (select source, case when lower(trim(source)) like '%code%' then 0 else 1 end as kind, count(*) as n from documents where source is not null group by all)
select source, cast(row_number() over (order by kind, n desc, source) as int) as place from s""")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of text in the order in which they are tried: those of code first, then by how many there are."""
    counts = load(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    kind = F.when(F.contains(F.lower(F.trim("source")), F.lit("code")), 0).otherwise(1)
    return state.last_n(counts.withColumn("all", F.lit(0)), ["all"], [kind, F.desc("n"), F.asc("source")], 1 << 30).select("source", F.col("place").alias("place"))
