"""Queries of expectations, verdicts by joined evidence, and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.functions.scalar import keywords
from sievelode.operators import quality, retrieval, rules, timeseries
from sievelode.plans.catalog import query
from sievelode.plans.codebase import ALL
from sievelode.plans.findings import ONCE, once
from sievelode.plans.search import keywords_sql
from sievelode.sources.tables import load

LINE_RULES = {
    "positive-quantity": "l_quantity > 0", "discount-range": "l_discount between 0 and 0.1", "flag-known": "l_returnflag in ('A', 'N', 'R')",
    "line-order": "l_linenumber between 1 and 7", "priced": "l_extendedprice >= 900", "shipped-late": "l_shipdate >= timestamp '1995-01-01 00:00:00'",
}
PART_RULES = {"small": "p_size <= 40", "named": "length(p_name) > 8", "branded": "p_brand like 'Brand#%'", "economy": "p_type = 'ECONOMY'"}
BUCKETS = [("injection", "(?i)query|shell"), ("crypto", "(?i)hash|hard-coded"), ("robustness", "(?i)except|debug"), ("input", "(?i)redirect|deserial")]


@query(" union all ".join(f"select '{n}' as rule, count(*) filter (where not coalesce({p}, false)) as n_failed, count(*) as n_rows from lineitem" for n, p in LINE_RULES.items()))
def line_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.expectations(load(spark, sf_dir, "lineitem"), LINE_RULES)


@query(" union all ".join(f"select p_partkey, '{n}' as rule from part where not coalesce({p}, false)" for n, p in PART_RULES.items()))
def record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(load(spark, sf_dir, "part"), "p_partkey", PART_RULES)


@query(f"with {ONCE} select bucket, count(*) as n, count(distinct repo) as n_repos from (select repo, case " + " ".join(f"when regexp_matches(title, '{p}') then '{n}'" for n, p in BUCKETS) + " else 'other' end as bucket from f) group by bucket")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.first_bucket(once(spark, sf_dir, "title", "repo"), "title", BUCKETS, "other")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("repo").alias("n_repos"))


@query(f"""with {ONCE}, flows as (select review_id, string_agg(dimension, ',') as dims, bool_or(severity = 'critical') as critical from ({ALL}) group by review_id)
select f.review_id, f.ord, case when flows.critical and f.dimension in ('security', 'network') then 'confirmed' when flows.review_id is not null then 'needs_review' else 'likely_fp' end as outcome from f left join flows using (review_id)""")
def adversarial_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = rules.scan_texts(load(spark, sf_dir, "review"), "review_id", "content")
    flows = broken.groupBy("review_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"))
    outcome = F.when(F.col("critical") & F.col("dimension").isin("security", "network"), "confirmed").when(F.col("critical").isNotNull(), "needs_review").otherwise("likely_fp")
    return once(spark, sf_dir, "dimension").join(flows, "review_id", "left").select("review_id", "ord", outcome.alias("outcome"))


@query("""with c as (select review_id, literal, count(*) as n from (select review_id, unnest(regexp_extract_all(content, '([a-z_]{4,})', 1)) as literal from (select distinct review_id, content from review where content is not null)) group by all having count(*) >= 5),
r as (select *, row_number() over (partition by review_id order by n desc, literal) as rank from c) select review_id, literal, n from r where rank <= 3""")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repeated_literals(load(spark, sf_dir, "review"), "review_id", "content", least=5, pattern="([a-z_]{4,})")


@query("""with x as (select review_id, max(len(string_split(content, chr(10)))) as n_lines, max(len(regexp_extract_all(content, '(?m)^(?:import|from|using|require)\\b'))) as n_imports from review where content is not null group by review_id)
select review_id, n_lines, n_imports, n_lines > 150 as long_file, n_imports > 3 as many_imports from x""")
def size_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("content", "\n"))
    imports = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^(?:import|from|using|require)\b"), 0))
    sizes = load(spark, sf_dir, "review").where("content is not null").groupBy("review_id").agg(F.max(lines).cast("bigint").alias("n_lines"), F.max(imports).cast("bigint").alias("n_imports"))
    return sizes.withColumn("long_file", F.col("n_lines") > 150).withColumn("many_imports", F.col("n_imports") > 3)


@query("""with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events) select user_id, min(i) as first_place, min(i) > 1 as fell_back, count(*) as successes from e where event_type = 'purchase' group by user_id""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = timeseries.places(load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").withColumnRenamed("place", "i")
    return placed.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("i").cast("bigint").alias("first_place"), (F.min("i") > 1).alias("fell_back"), F.count("*").alias("successes"))


@query("select event_type, count(*) as n, count(distinct json_extract_string(props, '$.k')) as n_values, min(cast(json_extract_string(props, '$.k') as int)) as least, max(cast(json_extract_string(props, '$.k') as int)) as most from events group by event_type")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    rows = load(spark, sf_dir, "events").select("event_type", k.alias("k"), k.try_cast("int").alias("v"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_values"), F.min("v").alias("least"), F.max("v").alias("most"))


def _words(key: str, table: str) -> str:
    return f"(select {key}, unnest(list_distinct({keywords_sql('text')})) as word from {table})"


@query(f"""with q as {_words('item_id', '(select * from benchmark where item_id % 20 = 0)')}, d as {_words('doc_id', 'documents')}, o as (select item_id, doc_id, count(*) as overlap from q join d using (word) group by all),
r as (select *, row_number() over (partition by item_id order by overlap desc, doc_id) - 1 as rank from o) select item_id, doc_id, overlap, rank from r where rank < 5""")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = keywords(F.col("text"), 1_000_000)  # all of them
    q = load(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select("item_id", F.explode(words).alias("word"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word"))
    overlap = d.join(q, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("overlap"))
    return retrieval.ranked(overlap, "item_id", "doc_id", "overlap", 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"with {ONCE}, s as (select repo, review_id, count(*) as n from f group by all), m as (select repo, avg(n) as m, stddev_pop(n) as sd from s group by repo) select s.repo, s.review_id, s.n from s join m using (repo) where n > m + 2 * sd")
def crowded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = once(spark, sf_dir, "repo").groupBy("repo", "review_id").agg(F.count("*").alias("n"))
    limits = counts.groupBy("repo").agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))
    return counts.join(limits, "repo").where("n > m + 2 * sd").select("repo", "review_id", "n")


@query("select event_type, l_returnflag, n from (select 'events' as event_type, null as l_returnflag, count(*) as n from events union all select null, l_returnflag, count(*) from lineitem group by l_returnflag)")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "events").agg(F.count("*").alias("n")).withColumn("event_type", F.lit("events"))
    b = load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return a.unionByName(b, allowMissingColumns=True).select("event_type", "l_returnflag", "n")


@query("""with a as (select distinct repo from findings), b as (select distinct repo from review) select repo, 'both' as side from (select * from a intersect select * from b) union all select repo, 'findings' from (select * from a except select * from b) union all select repo, 'reviews' from (select * from b except select * from a)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (load(spark, sf_dir, t).select("repo").distinct() for t in ("findings", "review"))
    sides = ((a.intersect(b), "both"), (a.subtract(b), "findings"), (b.subtract(a), "reviews"))
    out = [df.withColumn("side", F.lit(name)) for df, name in sides]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"with {ONCE} select review_id, ord, coalesce(max(case when severity = 'critical' then 2 when severity is null then 0 else 1 end) over (partition by review_id), 0) as worst from f")
def worst_of_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import window

    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity").isNull(), 0).otherwise(1)
    rows = once(spark, sf_dir, "severity").withColumn("rank", rank)
    return rows.select("review_id", "ord", F.max("rank").over(window.Window.partitionBy("review_id")).alias("worst"))
