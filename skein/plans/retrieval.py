"""Queries of the index, the coarse probe and the searches.

Corpus: the usable vectors of cluster_cache. Queries: all_results, whose query_vec_id names
the vector; each vector that some query names is probed once. Searches take the
vectors with an id divisible by 100 against the whole corpus. The searches of probed blocks run over the written
index, which is built once for a session and its tables; flat_topk needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import index, search
from skein.runtime import kept, materialize, table

NPROBE, K, DIM = 24, 10, 64
#: Probed blocks of the 1,000 with which nine tenths of the nearest vectors are found: the given blocks hardly follow the vectors.
WIDE = 760


def corpus_of(spark: SparkSession, d: str) -> DataFrame:
    return index.corpus(table(spark, d, "cluster_cache"), DIM)


def _asked(spark: SparkSession, d: str, corpus: DataFrame) -> DataFrame:
    """(qid, qvec): the vectors that queries ask for, named by their vec_id."""
    ids = table(spark, d, "all_results").where("query_vec_id IS NOT NULL").select(F.col("query_vec_id").alias("vec_id")).distinct()
    return corpus.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def sample(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def _probes(spark: SparkSession, d: str, queries: DataFrame, nprobe: int = NPROBE) -> DataFrame:
    return search.coarse_probe(queries, table(spark, d, "centroids"), nprobe, DIM)


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6))


def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    p = index.profile(corpus_of(spark, d), DIM)
    return p.withColumn("size_mb", F.round("size_mb", 6))


def cluster_costs(spark: SparkSession, d: str) -> DataFrame:
    c = index.measured_costs(table(spark, d, "cluster_stats"), table(spark, d, "centroids"))
    return c.select("cluster_id", F.when(F.col("latency_sec") < float("inf"), F.col("latency_sec")).alias("latency_sec"), "size_mb")


def coarse_probe(spark: SparkSession, d: str) -> DataFrame:
    return _out(_probes(spark, d, _asked(spark, d, corpus_of(spark, d)))).withColumnRenamed("qid", "vec_id")


def probe_sets(spark: SparkSession, d: str) -> DataFrame:
    return search.probe_sets(_probes(spark, d, _asked(spark, d, corpus_of(spark, d)))).withColumnRenamed("qid", "vec_id")


def index_of(spark: SparkSession, d: str) -> DataFrame:
    """The written index over the corpus (vec_id, cluster_id, embedding, shard)."""
    cache = table(spark, d, "cluster_cache")
    return kept(cache, f"index {d}", lambda path: index.write_index(materialize(index.corpus(cache, DIM), "corpus"), path, DIM))


def ivf_index(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index, if it isn't there, and counts what its blocks hold."""
    return index_of(spark, d).groupBy("cluster_id", "shard").agg(F.count("*").alias("n_vectors"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


def nearest(spark: SparkSession, d: str, queries: DataFrame, blocks: DataFrame, k: int = K, per_cluster: bool = False, nprobe: int = NPROBE) -> DataFrame:
    return _out(search.search(queries, blocks, k, DIM, _probes(spark, d, queries, nprobe), per_cluster))


def ivf_topk(spark: SparkSession, d: str) -> DataFrame:
    blocks = index_of(spark, d)
    return nearest(spark, d, sample(blocks), blocks)


def per_cluster_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best three of every probed block."""
    blocks = index_of(spark, d)
    return nearest(spark, d, sample(blocks), blocks, 3, per_cluster=True)


def ivf_join_topk(spark: SparkSession, d: str) -> DataFrame:
    """ivf_topk of every vector that some query asks for: queries and blocks meet by a join."""
    blocks = index_of(spark, d)
    q = materialize(_asked(spark, d, blocks), "queries")
    return _out(search.search(q, blocks, 3, DIM, _probes(spark, d, q), many=True)).select("qid", "rank", "vec_id", "cluster_id", "dist")


def flat_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = corpus_of(spark, d)
    return _out(search.search(sample(corpus), corpus, K, DIM))


def ivf_wide_topk(spark: SparkSession, d: str) -> DataFrame:
    """ivf_topk with as many probes as a recall of 0.9 takes."""
    blocks = index_of(spark, d)
    return nearest(spark, d, sample(blocks), blocks, nprobe=WIDE)


def _recall(spark: SparkSession, d: str, nprobe: int) -> DataFrame:
    blocks = index_of(spark, d)
    q = sample(blocks)
    r = search.recall(search.search(q, blocks, K, DIM, _probes(spark, d, q, nprobe)), search.search(q, blocks, K, DIM))
    return r.withColumn("recall", F.round("recall", 6))


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, NPROBE)


def ivf_wide_recall(spark: SparkSession, d: str) -> DataFrame:
    return _recall(spark, d, WIDE)


QUERIES = {f.__name__: f for f in (ivf_index, ivf_topk, ivf_join_topk, flat_topk, ivf_recall, ivf_wide_topk, ivf_wide_recall, per_cluster_topk, coarse_probe, probe_sets, cluster_profile, cluster_costs)}

CORPUS = """
ok AS (SELECT * FROM cluster_cache WHERE vec_id IS NOT NULL AND cluster_id IS NOT NULL AND len(embeddings) = 64
  AND len(list_filter(embeddings, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
corpus AS (SELECT vec_id, cluster_id, CAST(embeddings AS DOUBLE[64]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id
  ORDER BY (loaded_at IS NOT NULL) DESC, loaded_at DESC, cluster_id) AS r FROM ok) WHERE r = 1)"""
_ASKED = "q AS (SELECT vec_id AS qid, v AS qv FROM corpus WHERE vec_id IN (SELECT query_vec_id FROM all_results))"
_SAMPLE = "q AS (SELECT vec_id AS qid, v AS qv FROM corpus WHERE vec_id % 100 = 0)"


def _probe_sql(queries: str) -> str:
    return f"""WITH {CORPUS}, {queries},
c AS (SELECT cluster_id, CAST(centroid AS DOUBLE[64]) AS c FROM centroids WHERE len(centroid) = 64),
d AS (SELECT qid, cluster_id, list_sum(list_transform(list_zip(qv, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM q, c),
probes AS (SELECT * FROM (SELECT qid, cluster_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, cluster_id) AS probe_rank FROM d) WHERE probe_rank <= {NPROBE})"""


_PAIRS = "list_sum(list_transform(list_zip(q.qv, corpus.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_IVF = f"""ivf AS (SELECT * FROM (SELECT q.qid, vec_id, corpus.cluster_id, {_PAIRS} AS dist, row_number() OVER (PARTITION BY q.qid ORDER BY {_PAIRS}, vec_id) AS rank
FROM q JOIN probes ON q.qid = probes.qid JOIN corpus ON corpus.cluster_id = probes.cluster_id) WHERE rank <= {K})"""
_FLAT = f"flat AS (SELECT * FROM (SELECT q.qid, vec_id, cluster_id, {_PAIRS} AS dist, row_number() OVER (PARTITION BY q.qid ORDER BY {_PAIRS}, vec_id) AS rank FROM q, corpus) WHERE rank <= {K})"

SQL = {
    "ivf_index": f"WITH {CORPUS} SELECT cluster_id, CAST(floor(cluster_id / 64) AS INTEGER) AS shard, count(*) AS n_vectors, min(vec_id) AS first_id, max(vec_id) AS last_id FROM corpus GROUP BY 1, 2",
    "ivf_join_topk": f"""{_probe_sql(_ASKED)} SELECT * FROM (SELECT q.qid, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY {_PAIRS}, vec_id) AS INTEGER) AS rank, vec_id, corpus.cluster_id,
round({_PAIRS}, 6) AS dist FROM q JOIN probes ON q.qid = probes.qid JOIN corpus ON corpus.cluster_id = probes.cluster_id) WHERE rank <= 3""",
    "cluster_profile": f"WITH {CORPUS} SELECT cluster_id, count(*) AS n_vectors, round(count(*) * 256 / 1048576.0, 6) AS size_mb, CAST(count(*) AS DOUBLE) AS load_cost FROM corpus GROUP BY cluster_id",
    "cluster_costs": """SELECT c.cluster_id, CASE WHEN isfinite(max(latency_sec)) THEN max(latency_sec) END AS latency_sec, coalesce(max(size_mb), 0.0) AS size_mb
FROM (SELECT DISTINCT cluster_id FROM centroids) c LEFT JOIN cluster_stats s ON s.cluster_id = c.cluster_id GROUP BY c.cluster_id""",
    "coarse_probe": f"{_probe_sql(_ASKED)} SELECT qid AS vec_id, CAST(probe_rank AS INTEGER) AS probe_rank, cluster_id, round(dist, 6) AS dist FROM probes",
    "probe_sets": f"{_probe_sql(_ASKED)} SELECT qid AS vec_id, list_sort(list(cluster_id)) AS cluster_ids FROM probes GROUP BY qid",
    "ivf_topk": f"{_probe_sql(_SAMPLE)}, {_IVF} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, cluster_id, round(dist, 6) AS dist FROM ivf",
    "per_cluster_topk": f"""{_probe_sql(_SAMPLE)} SELECT * FROM (SELECT q.qid, CAST(row_number() OVER (PARTITION BY q.qid, corpus.cluster_id ORDER BY {_PAIRS}, vec_id) AS INTEGER) AS rank, vec_id, corpus.cluster_id,
round({_PAIRS}, 6) AS dist FROM q JOIN probes ON q.qid = probes.qid JOIN corpus ON corpus.cluster_id = probes.cluster_id) WHERE rank <= 3""",
    "flat_topk": f"WITH {CORPUS}, {_SAMPLE}, {_FLAT} SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, cluster_id, round(dist, 6) AS dist FROM flat",
    "ivf_recall": f"""{_probe_sql(_SAMPLE)}, {_IVF}, {_FLAT} SELECT count(DISTINCT f.qid) AS queries, count(*) AS true_rows, count(i.vec_id) AS hits,
round(count(i.vec_id) / count(*), 6) AS recall FROM flat f LEFT JOIN ivf i ON i.qid = f.qid AND i.vec_id = f.vec_id""",
}
SQL |= {n.replace("ivf_", "ivf_wide_"): SQL[n].replace(f"probe_rank <= {NPROBE}", f"probe_rank <= {WIDE}") for n in ("ivf_topk", "ivf_recall")}
