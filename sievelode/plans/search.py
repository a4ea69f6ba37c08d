"""Queries over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelode.functions.scalar import keywords, slug, softmax, token_estimate
from sievelode.operators import code_ast, retrieval, rules, timeseries, vectors
from sievelode.plans.catalog import query
from sievelode.session import spread, written
from sievelode.sources.tables import load

HAN = "[\\x{4e00}-\\x{9fff}]"
TERMS = f"list_concat(regexp_extract_all(lower(text), '[a-z0-9_]+'), regexp_extract_all(lower(text), '{HAN}'), list_transform(range(1, len(regexp_extract_all(lower(text), '{HAN}'))), lambda i: regexp_extract_all(lower(text), '{HAN}')[i] || regexp_extract_all(lower(text), '{HAN}')[i + 1]))"
POSTINGS = f"toks as (select doc_id, {TERMS} as terms from documents where text is not null), post as (select term, doc_id, count(*) as tf from (select doc_id, unnest(terms) as term from toks) group by all)"
BM25 = f"""{POSTINGS}, q as (select item_id, unnest(list_distinct({TERMS})) as term from benchmark where item_id % 20 = 0), st as (select count(*) as n, avg(len(terms)) as avgdl from toks), dl as (select doc_id, len(terms) as dl from toks),
used as (select post.* from post where term in (select term from q)), df as (select term, count(*) as df from used group by term),
s as (select q.item_id, used.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score, count(*) as hits from used join df using (term) join q using (term) join dl using (doc_id), st group by all),
b as (select *, row_number() over (partition by item_id order by score desc, doc_id) - 1 as rank from s), h as (select *, row_number() over (partition by item_id order by hits desc, doc_id) - 1 as rank from s)"""


def keywords_sql(text: str) -> str:
    """All keywords of a text with repetitions: runs of Han letters, the pairs within them, Latin words."""
    runs = f"regexp_extract_all({text}, '{HAN}{{2,}}')"
    pairs = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: r[i:i + 1])))"
    return f"list_concat({runs}, {pairs}, regexp_extract_all(lower({text}), '[a-z]{{3,}}'))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every item whose id is divisible by 20."""
    return load(spark, sf_dir, "benchmark").where("item_id % 20 = 0")


@query(f"with {POSTINGS} select term, count(*) as df, cast(sum(tf) as bigint) as cf from post group by term")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.index_terms(retrieval.postings(documents(spark, sf_dir)))


@query(f"with {POSTINGS} select doc_id from post where term in ('lockfile', 'reader', 'warning') group by doc_id having count(*) = 3")
def and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.all_terms(retrieval.postings(documents(spark, sf_dir)), "doc_id", ["warning", "lockfile", "reader", "lockfile"])


@query(f"with {BM25} select item_id, doc_id, score, hits, cast(rank as int) as rank from b where rank < 10")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(documents(spark, sf_dir), _stated(spark, sf_dir))
    return retrieval.ranked(scored, "item_id", "doc_id", "score", 10)


@query(f"with {BM25}, l as (select item_id, doc_id, rank from b where rank < 20 union all select item_id, doc_id, rank from h where rank < 20) select item_id, doc_id, round(sum(1.0::double / (60 + rank + 1)), 9) as score from l group by all")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25(documents(spark, sf_dir), _stated(spark, sf_dir)).persist()
    lists = [retrieval.ranked(scored, "item_id", "doc_id", by, 20) for by in ("score", "hits")]
    return retrieval.fuse(lists, "item_id", "doc_id")


@query(f"select doc_id, array_to_string(list_distinct_ordered, ' ') as words from (select doc_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1])[1:12] as list_distinct_ordered from (select doc_id, {keywords_sql('text')} as w from documents where text is not null))")
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.concat_ws(" ", keywords(F.col("text"))).alias("words"))


ESTIMATE = "(case when length(text) = 0 then 0 else greatest(1, cast(floor((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4) as bigint) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) end)"


@query(f"select doc_id, cast({ESTIMATE} as bigint) as tokens from documents where text is not null")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query(f"select doc_id, cast(sum({ESTIMATE}) over (partition by repo order by doc_id) as bigint) as used, sum({ESTIMATE}) over (partition by repo order by doc_id) > 20000 as over_budget from documents where text is not null")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where("text is not null")
    out = timeseries.running_budget(rows, "repo", "doc_id", token_estimate(F.col("text")), 20000)
    return out.select("doc_id", F.col("used").cast("bigint").alias("used"), F.col("over").alias("over_budget"))


@query("""with x as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as w, list_transform(string_split(text, chr(10)), lambda l: length(l)) as ll from documents where text is not null)
select doc_id, cast(len(w) as int) as n_words, cast(list_max(ll) as int) as longest_line, len(w) < 40 as few_words, list_max(ll) > 160 as long_line, case when contains(lower(text), 'lorem ipsum') then 'lorem ipsum' when contains(lower(text), 'todo') then 'todo' when contains(lower(text), 'fixme') then 'fixme' end as placeholder from x""")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.text_shape(documents(spark, sf_dir), "doc_id", "text")


@query("select sig_id, substr(trim(regexp_replace(lower(package || ' ' || severity), '[^a-z0-9]+', '-', 'g'), '-'), 1, 24) as slug, substr(md5(package), 1, 8) as short_hash from signatures")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "signatures").select("sig_id", slug(F.concat_ws(" ", "package", "severity")).alias("slug"), F.substring(F.md5("package"), 1, 8).alias("short_hash"))


@query("""with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select q.query_id, e.vec_id, list_cosine_similarity(q.v, e.embedding::double[]) as c from q join embeddings e on e.vec_id <> q.query_id),
r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s) select query_id, vec_id, round(c, 4) as cosine, cast(rank as int) as rank from r where rank <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return retrieval.nearest(e, e.where("vec_id % 20 = 0"))


@query("""with x as (select vec_id, list_transform(embedding, lambda v: exp(v::double - list_max(embedding)::double)) as e from embeddings) select vec_id, round(list_max(e) / list_sum(e), 5) as top, cast(list_position(e, list_max(e)) as bigint) as top_dim from x""")
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "embeddings").select("vec_id", softmax(F.col("embedding")).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 5).alias("top"), F.array_position("s", F.array_max("s")).alias("top_dim"))


@query("""with l as (select vec_id, i - 1 as dim, embedding[i]::double as x from embeddings, unnest(range(1, 65)) u(i)), s as (select dim, avg(x) as m, var_pop(x) as v from l group by dim)
select vec_id, cast(dim as int) as dim, round((x - m) / sqrt(v + 1e-5), 4) + 0.0 as value from l join s using (dim)""")
def batch_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.batch_norm(load(spark, sf_dir, "embeddings"), "vec_id", "embedding")


_W1 = [[((i * 7 + j * 3) % 5 - 2) / 4 for j in range(64)] for i in range(4)]
_W2 = [[1.0, -0.5, 0.25, 0.75]]


def _layer(v: str, weights: list[list[float]], bias: list[float]) -> str:
    return "[" + ", ".join(f"greatest(0.0::double, list_dot_product({v}, {w}::double[]) + {b})" for w, b in zip(weights, bias, strict=True)) + "]"


@query(f"select vec_id, round({_layer(_layer('embedding::double[]', _W1, [0.1, -0.1, 0.0, 0.2]) + '::double[]', _W2, [0.05])}[1], 4) as output from embeddings")
def mlp_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = vectors.dense_relu(F.col("embedding").cast("array<double>"), _W1, [0.1, -0.1, 0.0, 0.2])
    rows = load(spark, sf_dir, "embeddings").select("vec_id", hidden.alias("h"))
    return rows.select("vec_id", F.round(F.element_at(vectors.dense_relu(F.col("h"), _W2, [0.05]), 1), 4).alias("output"))


@query()
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.random_forest(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query()
def forest_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.forest_importances(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query()
def reuse_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each Python review the three texts of the (fixed) benchmark that contain most of the names it defines or imports."""
    facts = code_ast.code_facts(spread(load(spark, sf_dir, "review")), lang="lang", path="path")
    return retrieval.suggestions(written(code_ast.defined_names(facts)), load(spark, sf_dir, "benchmark"), "review_id", "item_id", "text")


@query()
def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").alias("hour"), F.length("props").alias("size"))
    return vectors.isolation_scores(rows, "event_id", ["value", "hour", "size"])
