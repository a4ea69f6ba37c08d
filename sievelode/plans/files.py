"""Queries of the readers: tables written as delimited rows, JSON, triples and texts with front matter, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.plans.catalog import query
from sievelode.session import shared_folder
from sievelode.sources import readers
from sievelode.sources.tables import load


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select cast(file_id as varchar) as file_id, repo, lang, cast(n_bytes as varchar) as n_bytes, count(*) as n from dep_audit group by all")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    load(spark, sf_dir, "dep_audit").select("file_id", "repo", "lang", "n_bytes").write.csv(path, header=True, escape='"')
    return readers.string_rows(spark, path).groupBy("file_id", "repo", "lang", "n_bytes").agg(F.count("*").alias("n"))


@query("select review_id, ord, title, line, count(*) as n from findings group by all")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    load(spark, sf_dir, "findings").select("review_id", "ord", "title", "line").write.json(path)
    rows = spark.read.schema("review_id long, ord int, title string, line int").json(path)
    return rows.groupBy("review_id", "ord", "title", "line").agg(F.count("*").alias("n"))


@query("with t as (select distinct src, kind, dst from call_edges where src is not null and dst is not null and kind is not null) select src as s, kind as p, dst as o, not exists (select 1 from t k where k.src = t.dst) as dangling from t")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call graph as N-Triples, read back, with the triples whose object is no subject."""
    path = _folder(spark, "triples")
    edges = load(spark, sf_dir, "call_edges").where("src is not null and dst is not null and kind is not null").select("src", "kind", "dst").distinct()
    edges.select(F.format_string("<%s> <%s> <%s> .", "src", "kind", "dst")).write.text(path)
    rows = readers.ntriples(spark, path)
    dangling = readers.dangling_objects(rows).withColumn("dangling", F.lit(True))
    bare = [F.substring(c, 2, F.length(c) - 2).alias(c) for c in ("s", "p", "o")]
    return rows.join(dangling, ["s", "p", "o"], "left").select(*bare, F.coalesce("dangling", F.lit(False)).alias("dangling"))


@query("select distinct review_id, coalesce(lang, '') as lang, repo from review")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and repository of each review, written before its text as front matter and read from there."""
    head = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\nrepo: "), F.col("repo"), F.lit("\n---\n"), F.coalesce("content", F.lit("")))
    fields = readers.front_matter(head)
    rows = load(spark, sf_dir, "review").select("review_id", fields.alias("m"))
    return rows.select("review_id", F.col("m")["lang"].alias("lang"), F.col("m")["repo"].alias("repo")).distinct()
