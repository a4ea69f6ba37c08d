"""Queries over call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.operators import graph, matching
from sievelode.plans.catalog import query
from sievelode.sources.tables import load

EDGES = "e as (select distinct repo, src, dst from call_edges where src is not null and dst is not null and src <> dst)"
COUPLING = f"""{EDGES}, own as (select distinct repo, src as module from call_edges where src is not null), i as (select e.* from e join own on own.repo = e.repo and own.module = e.dst),
c as (select own.repo, own.module, (select count(*) from i where i.repo = own.repo and i.dst = own.module) as fan_in, (select count(*) from i where i.repo = own.repo and i.src = own.module) as fan_out from own)"""
HUBS = f"{COUPLING}, h as (select repo, min_by(module, struct_pack(a := -fan_in, b := module)) as seed from c group by repo)"
CLOSURE = "t(repo, src, dst) as (select repo, src, dst from e union select t.repo, t.src, e.dst from t join e on e.repo = t.repo and e.src = t.dst)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "call_edges")


@query(f"with {COUPLING} select * from c")
def coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coupling(edges(spark, sf_dir))


@query(f"with {HUBS} select h.repo, h.seed, e.src as caller from h join e on e.repo = h.repo and e.dst = h.seed")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.callers(e, graph.hubs(e))


@query("select repo, dst, kind, count(*) as n_refs, count(distinct src) as n_callers, coalesce(min(line), -1) as first_line from call_edges where dst is not null group by repo, dst, kind")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("dst is not null").groupBy("repo", "dst", "kind").agg(
        F.count("*").alias("n_refs"), F.count_distinct("src").alias("n_callers"), F.coalesce(F.min("line"), F.lit(-1)).alias("first_line")
    )


@query(f"with recursive {HUBS}, r(repo, seed, module, depth) as (select repo, seed, seed, 0 from h union select r.repo, r.seed, e.src, r.depth + 1 from r join e on e.repo = r.repo and e.dst = r.module where r.depth < 64 and r.depth < 40) select repo, seed, module, min(depth) as depth from r where module <> seed group by all")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.reach(e, graph.hubs(e), reverse=True)


@query(f"with recursive {HUBS}, r(repo, seed, module, depth) as (select repo, seed, seed, 0 from h union select r.repo, r.seed, e.dst, r.depth + 1 from r join e on e.repo = r.repo and e.src = r.module where r.depth < 2) select repo, seed, module, min(depth) as depth from r where module <> seed group by all")
def bfs_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.reach(e, graph.hubs(e), max_depth=2)


@query(f"with recursive {EDGES}, {CLOSURE}, s as (select a.repo, a.src as module, a.dst as other from t a join t b on b.repo = a.repo and b.src = a.dst and b.dst = a.src) select repo, module, least(module, min(other)) as component from s where other <> module group by repo, module")
def circular_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


@query(f"""with recursive {EDGES}, {CLOSURE}, v as (select repo, src as module from e union select repo, dst from e), bad as (select repo, src as module from t where src = dst union select t.repo, t.dst from t join t c on c.repo = t.repo and c.src = t.src and c.src = c.dst),
d as (select v.* from v anti join bad using (repo, module)), p(repo, module, level) as (select d.repo, d.module, 0 from d union select p.repo, e.dst, p.level + 1 from p join e on e.repo = p.repo and e.src = p.module join d on d.repo = e.repo and d.module = e.dst)
select repo, module, max(level) as level from p group by all union all select repo, module, -1 from bad""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(edges(spark, sf_dir))


@query("""with recursive e as (select distinct repo, src, dst from call_edges where kind = 'inherit' and src is not null and dst is not null and src <> dst), r(repo, src, dst) as (select repo, src, dst from e union select r.repo, r.src, e.dst from r join e on e.repo = r.repo and e.src = r.dst)
select repo, src as seed, dst as module from r where src <> dst union select repo, src, src from e""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("kind = 'inherit'")
    seeds = graph.simple_edges(e).select("repo", F.col("src").alias("seed")).distinct()
    met = graph.reach(e, seeds).where("seed <> module").select("repo", "seed", "module")
    return met.unionByName(seeds.withColumn("module", F.col("seed")))  # each is its own ancestor


@query("select e.repo, e.dst, count(*) as n from call_edges e where e.dst is not null and not exists (select 1 from call_edges k where k.src = e.dst) and e.kind = 'import' group by all")
def broken_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return matching.missing_references(e.where("kind = 'import'"), "dst", e, "src").groupBy("repo", "dst").agg(F.count("*").alias("n"))


@query("""with own as (select distinct src as module from call_edges where src is not null), x as (select e.repo, e.src, e.dst, i, array_to_string(string_split(e.dst, '.')[1:i], '.') as prefix from (select distinct repo, src, dst from call_edges where kind = 'import' and dst is not null and src is not null) e, unnest(range(1, len(string_split(e.dst, '.')) + 1)) u(i))
select repo, src, dst, max(i) as matched_parts from x join (select distinct array_to_string(string_split(module, '.')[1:j], '.') as p from own, unnest(range(1, len(string_split(module, '.')) + 1)) w(j)) k on k.p = x.prefix group by all""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)

    def prefixes(df: DataFrame, column: str) -> DataFrame:
        parts = F.split(column, r"\.")
        return df.withColumn("i", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("i")), "."))

    known = prefixes(e.where("src is not null").select(F.col("src").alias("m")).distinct(), "m").select("prefix").distinct()
    imports = prefixes(e.where("kind = 'import' and dst is not null and src is not null").select("repo", "src", "dst").distinct(), "dst")
    return imports.join(known, "prefix").groupBy("repo", "src", "dst").agg(F.max("i").cast("bigint").alias("matched_parts"))


@query(f"with {HUBS}, x as (select h.repo, h.seed, e.dst as module, 1 as d from h join e on e.repo = h.repo and e.src = h.seed union all select h.repo, h.seed, e.src, 2 from h join e on e.repo = h.repo and e.dst = h.seed) select repo, seed, module, case sum(d) when 3 then 'both' when 2 then 'in' else 'out' end as direction from x group by repo, seed, module")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.neighbours(e, graph.hubs(e))
