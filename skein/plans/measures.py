"""Queries of the result log, run settings, query texts and offered load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.encode import encode
from skein.operators import grouping, index, metrics, traffic
from skein.plans.retrieval import CORPUS
from skein.runtime import materialize, table
from skein.sources.readers import parse_lines


def _log(spark: SparkSession, d: str) -> DataFrame:
    return metrics.typed(table(spark, d, "search_metrics"))


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_totals(_log(spark, d))


def warm_run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals without the first 20 queries of every run."""
    warm = metrics.without_warm_up(_log(spark, d))
    return warm.groupBy("run_id").agg(F.count("*").alias("n_queries"), F.min("log_seq").alias("first_seq"), F.max("log_seq").alias("last_seq"), F.sum("nmc").alias("n_misses"))


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.batch_totals(_log(spark, d))


def formatted_log(spark: SparkSession, d: str) -> DataFrame:
    return metrics.formatted(_log(spark, d))


def run_settings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.settings(table(spark, d, "run_configs"))


def cluster_ordinals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "all_results").select(F.explode("cluster_ids_set").alias("cluster_id")).where("cluster_id >= 0")
    return metrics.ordinals(e)


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "query_lines")).select("line_no", "text")


def paced_texts(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the gaps of a producer."""
    return traffic.poisson_gaps(query_texts(spark, d))


def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    return query_texts(spark, d).select("line_no", encode("text").alias("qvec"))


def traffic_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets for as many slots as the log has batches of its longest run."""
    n = _log(spark, d).agg(F.max("batch_seq")).first()[0] or 0
    return traffic.targets(spark, int(n))


def traffic_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of traffic_targets: slots, slots without their one or STEPS targets, targets out of range, bursts without a peak."""
    t = traffic_targets(spark, d)
    per = t.groupBy("slot", "burst").agg(F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"))
    steps = F.when(F.col("burst"), traffic.STEPS).otherwise(1)
    low, high = F.when(F.col("burst"), traffic.BASE).otherwise(traffic.LOW), F.when(F.col("burst"), traffic.BASE * traffic.PEAK).otherwise(traffic.HIGH)
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return per.agg(F.count("*").alias("slots"), count(F.col("n") != steps).alias("incomplete"), count((F.col("low") < low) | (F.col("high") > high)).alias("out_of_range"), count(F.col("burst") & (F.col("high") != high)).alias("flat_bursts"))


def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of encoded_texts and paced_texts: lines, different texts, texts with more than one vector, vectors of a length other than 1 or 0 (no words), gaps out of range."""
    norm = F.sqrt(F.aggregate("qvec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    e = encoded_texts(spark, d).select("line_no", norm.alias("norm"), F.hash("qvec").alias("code"))
    j = paced_texts(spark, d).select("line_no", "text", "gap_sec").join(e, "line_no")
    per = j.groupBy("text").agg(F.count("*").alias("n"), F.count_distinct("code").alias("codes"), F.sum(((F.abs(F.col("norm") - 1) > 1e-5) & (F.col("norm") > 0)).cast("bigint")).alias("off"), F.sum((~F.col("gap_sec").between(0, 12)).cast("bigint")).alias("gaps"))
    return per.agg(F.sum("n").alias("lines"), F.count("*").alias("texts"), F.sum((F.col("codes") != 1).cast("bigint")).alias("ambiguous"), F.sum("off").alias("not_unit"), F.sum("gaps").alias("bad_gaps"))


def minibatch_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ten groups of the vectors that queries ask for, fitted week by week of their arrival; each query's group when its week was fitted."""
    corpus = index.corpus(table(spark, d, "cluster_cache")).select(F.col("vec_id").alias("query_vec_id"), F.col("embedding").alias("qvec"))
    r = table(spark, d, "all_results").where("qid IS NOT NULL AND ts IS NOT NULL").groupBy("qid").agg(F.min_by(F.struct("query_vec_id", "ts"), "seq").alias("x"))
    asked = materialize(r.select("qid", "x.query_vec_id", F.to_date(F.date_trunc("week", "x.ts")).alias("tick")).join(corpus, "query_vec_id"), "asked")
    return grouping.minibatch_groups(asked.select("qid", "tick", "qvec"), "tick", 10, 64)


def kmeans_groups(spark: SparkSession, d: str) -> DataFrame:
    """Ten groups of the corpus vectors."""
    corpus = index.corpus(table(spark, d, "cluster_cache"))
    return grouping.kmeans_groups(corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 10, 64)


QUERIES = {f.__name__: f for f in (run_totals, warm_run_totals, batch_totals, formatted_log, run_settings, cluster_ordinals, query_texts, paced_texts, encoded_texts, traffic_targets, traffic_checks, text_checks, minibatch_groups, kmeans_groups)}

_TIMES = ", ".join(f"CASE WHEN NOT isnan({c}) AND {c} >= 0 THEN {c} END AS {c}" for c in metrics.TIMES)
_L = f"""WITH log AS (SELECT run_id, seq, batch_seq, qid, ts, nmc, num, drs, {_TIMES}, TRY_CAST(nullif(regexp_extract(chr, '^\\s*([0-9]+(?:\\.[0-9]+)?)%\\s*$', 1), '') AS DOUBLE) / 100 AS hit_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq, qid, ts ORDER BY logged_at) AS r FROM search_metrics) WHERE r = 1)"""

_TEXTS = ", ".join(f"CAST(round(CAST({c} AS DECIMAL(30, 14)), 4) AS DECIMAL(30, 4))::VARCHAR AS {c}" for c in metrics.TIMES)

SQL = {
    "traffic_checks": f"{_L} SELECT CAST(max(batch_seq) AS BIGINT) AS slots, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS flat_bursts FROM log",
    "formatted_log": f"{_L} SELECT run_id, seq, batch_seq, qid, nmc, num, drs, {_TEXTS}, CAST(round(CAST(hit_ratio * 100 AS DECIMAL(30, 12)), 3) AS DECIMAL(30, 3))::VARCHAR || '%' AS chr FROM log",
    "run_totals": f"""{_L} SELECT run_id, count(*) AS n_queries, count(duration) AS n_timed, round(sum(duration), 4) AS sum_duration, round(avg(duration), 6) AS mean_duration,
CAST(sum(nmc) AS BIGINT) AS n_misses, CAST(sum(drs) AS BIGINT) AS loaded_mb, round(avg(hit_ratio), 6) AS mean_hit_ratio FROM log GROUP BY run_id""",
    "warm_run_totals": f"{_L} SELECT run_id, count(*) AS n_queries, min(seq - 20) AS first_seq, max(seq - 20) AS last_seq, CAST(sum(nmc) AS BIGINT) AS n_misses FROM log WHERE seq > 20 GROUP BY run_id",
    "batch_totals": f"{_L} SELECT run_id, batch_seq, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(nmc) AS BIGINT) AS n_misses FROM log WHERE batch_seq > 0 GROUP BY 1, 2",
    "run_settings": """SELECT DISTINCT run_id, lower(trim(script)) AS script, CASE WHEN lower(trim(topic)) = 'hotpotqa' THEN 'hotpotqa' WHEN lower(trim(topic)) <> '' THEN lower(trim(topic)) || '_query' END AS topic_name,
coalesce(CASE WHEN NOT isnan(float_value) THEN float_value END, 0.3) AS float_value, round(1 - coalesce(CASE WHEN NOT isnan(float_value) THEN float_value END, 0.3), 6) AS distance_threshold, nlist, nprobe, cache_size,
coalesce(nullif(lower(trim(linkage)), ''), 'complete') AS linkage, coalesce(nullif(lower(trim(dynamic_thread)), ''), 'dynamic') AS dynamic_thread,
coalesce(nullif(lower(trim(jaccard_calculation)), ''), 'vector') AS jaccard_calculation, coalesce(num_thread, 8) AS num_thread FROM run_configs""",
    "cluster_ordinals": "SELECT c AS cluster_id, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS ordinal FROM (SELECT DISTINCT unnest(cluster_ids_set) AS c FROM all_results) WHERE c >= 0",
    "query_texts": "SELECT line_no, json_extract_string(CASE WHEN json_valid(raw_line) THEN raw_line END, '$.text') AS text FROM query_lines WHERE json_extract_string(CASE WHEN json_valid(raw_line) THEN raw_line END, '$.text') IS NOT NULL",
}


def _kmeans_sql(k: int = 10, rounds: int = 5) -> str:
    """Rounds of assignment and means, each a CTE; the first centres are the k vectors of the smallest ids."""
    out = f"WITH {CORPUS}, c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS g, v AS c FROM corpus ORDER BY vec_id LIMIT {k})"
    near = "SELECT vec_id, any_value(v) AS v, arg_min(g, (list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), g)) AS g FROM corpus, {c} GROUP BY vec_id"
    for i in range(rounds):
        out += f""", a{i} AS ({near.format(c=f'c{i}')}), m{i} AS (SELECT g, list(x ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS x FROM (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY g),
c{i + 1} AS (SELECT c{i}.g, coalesce(m{i}.c, CAST(c{i}.c AS DOUBLE[])) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.g = c{i}.g)"""
    return f"{out} SELECT vec_id AS qid, CAST(g AS INTEGER) AS group_id FROM ({near.format(c=f'c{rounds}')})"


SQL["kmeans_groups"] = _kmeans_sql()
SQL["text_checks"] = f"SELECT count(*) AS lines, count(DISTINCT text) AS texts, CAST(0 AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS not_unit, CAST(0 AS BIGINT) AS bad_gaps FROM ({SQL['query_texts']})"
