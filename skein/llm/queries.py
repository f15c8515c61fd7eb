"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sets import record_sets
from skein.llm import clusters, cooccurrence, digests, packing, setjoin, spampages, tokens, vectors
from skein.runtime import materialize, table

#: Vectors: elements, neighbours a vector and least cosine of a neighbour.
DIM, K, NEAR = 64, 10, 0.85
#: Problem 1: least cosine of two similar vectors.
SAME = 0.92
#: Problem 4: least Jaccard similarity, and ids of a query that takes part.
OVERLAP, LEAST_IDS = 0.7, 5
#: Problem 6: least share of the queries and least lift of a pair.
PAIR_SHARE, PAIR_LIFT = 0.02, 3.0

IDS = "SELECT DISTINCT qid, c FROM (SELECT qid, unnest(cluster_ids_set) AS c FROM all_results WHERE qid IS NOT NULL) WHERE c >= 0"


def _sets(spark: SparkSession, d: str, least: int = 1) -> DataFrame:
    return record_sets(table(spark, d, "all_results"), "qid", "cluster_ids_set", least)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = cooccurrence.associations(_sets(spark, d))
    return found.where((F.col("n") >= PAIR_SHARE * F.col("n_records")) & (F.col("n") * F.col("n_records") >= PAIR_LIFT * F.col("n_a") * F.col("n_b"))).select(F.col("a").alias("cluster_id_a"), F.col("b").alias("cluster_id_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of cluster ids of a common query: counts, lift, expectation under the null, tail and rate."""
    return cooccurrence.associations(_sets(spark, d)).withColumnsRenamed({"a": "cluster_id_a", "b": "cluster_id_b"})


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of p6_pairs."""
    return p6_pairs(spark, d).select("cluster_id_a", "cluster_id_b", "n", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, day, metric, value) of the measured durations and known batch numbers, repeated rows once.

    -1, NaN and null durations weren't measured; null and 0 batch numbers are unknown.
    """
    m = table(spark, d, "search_metrics").select("run_id", "seq", "qid", "ts", "batch_seq", "duration").distinct()
    dur = F.when(F.col("duration") >= 0, F.col("duration"))
    both = F.array(F.struct(F.lit("duration").alias("metric"), dur.alias("value")), F.struct(F.lit("batch_seq").alias("metric"), F.when(F.col("batch_seq") > 0, F.col("batch_seq")).cast("double").alias("value")))
    long = m.select("run_id", F.to_date("ts").alias("day"), F.explode(both).alias("x")).select("run_id", "day", "x.*")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of duration and batch_seq of every run on every day (scope run_day), of every run over its
    days and of every day over its runs (scopes run and day, merged from the digests of run_day), with measured
    rank errors. A null run_id or day is a group of its own; the column not in the scope is null."""
    values = materialize(_metrics(spark, d), "values")
    fine = materialize(digests.digests(values, ["run_id", "day", "metric"], "value"), "digests")
    scopes = (("run_day", ["run_id", "day", "metric"]), ("run", ["run_id", "metric"]), ("day", ["day", "metric"]))
    ans = None
    for scope, keys in scopes:
        got = digests.answers(fine if scope == "run_day" else digests.merge(fine, keys), keys)
        got = got.select(F.lit(scope).alias("scope"), *[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (("run_id", "string"), ("day", "date"))], "metric", "n", "est")
        ans = got if ans is None else ans.unionAll(got)
    ans = materialize(ans, "answers")
    of = {scope: ans.where(F.col("scope") == scope).select(*keys, "n", "est") for scope, keys in scopes}
    asked = digests.all_answers([(of[scope], keys) for scope, keys in scopes])
    between = materialize(digests.between(values, asked, ["run_id", "day", "metric"], "value"), "between")  # the one pass over the values
    parts = None
    for scope, keys in scopes:
        got = digests.certify(between, of[scope], keys, ("low", "high", "n_values"))
        got = got.select(F.lit(scope).alias("scope"), *[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (("run_id", "string"), ("day", "date"))], "metric", "n", "q", "value", "rank_low", "rank_high", "rank_error")
        parts = got if parts is None else parts.unionAll(got)
    return parts


def p3_batch_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of batch_seq of every run: so few distinct values that the digests are exact."""
    values = _metrics(spark, d).where("metric = 'batch_seq'").select("run_id", "value")
    ans = digests.answers(digests.digests(values, ["run_id"], "value"), ["run_id"])
    q = F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in digests.QUANTILES]), F.col("est")))
    return ans.select("run_id", "n", q.alias("q", "value"))


#: Largest rank error that p3_certified accepts. The widest centroid holds a share of pi / (2 DELTA) = 0.0039 of the rows; a digest that was merged once more can add that again.
RANK_ERROR = 0.01


def p3_certified(spark: SparkSession, d: str) -> DataFrame:
    """The size of every group of p3_percentiles, and whether each measured rank error is within the bound."""
    within = (F.col("rank_error") <= RANK_ERROR) & (F.col("rank_low") <= F.col("rank_high"))
    return p3_percentiles(spark, d).select("scope", "run_id", "day", "metric", "n", "q", within.alias("certified"))


def p3_medians(spark: SparkSession, d: str) -> DataFrame:
    """The medians alone, of the two coarse scopes."""
    return p3_percentiles(spark, d).where("q = 0.5 AND scope <> 'run_day'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    g = clusters.vector_groups(table(spark, d, "cluster_cache"), "vec_id", "embeddings", DIM, SAME)
    return g.select(F.col("id").alias("vec_id"), F.col("group_id").alias("group_vec_id"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size, most typical vectors and cohesion of every group."""
    cache = table(spark, d, "cluster_cache")
    groups = materialize(clusters.vector_groups(cache, "vec_id", "embeddings", DIM, SAME), "groups")
    return clusters.describe(cache, groups, "vec_id", "embeddings", DIM).withColumnRenamed("group_id", "group_vec_id")


def p1_average(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the stricter average, missing links counted as 0."""
    g = clusters.vector_groups(table(spark, d, "cluster_cache"), "vec_id", "embeddings", DIM, SAME, "all")
    return g.select(F.col("id").alias("vec_id"), F.col("group_id").alias("group_vec_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.similar_records(table(spark, d, "all_results"), "qid", "cluster_ids_set", OVERLAP, LEAST_IDS)
    return pairs.select(F.col("a").alias("qid_a"), F.col("b").alias("qid_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of equal sets, its size and its number of similar classes, for every query with at least five ids."""
    return setjoin.linked_classes(table(spark, d, "all_results"), "qid", "cluster_ids_set", OVERLAP, LEAST_IDS).withColumnRenamed("id", "qid")


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ranked neighbours of every usable vector, from cosine NEAR on; cosines to 6 places."""
    near = vectors.nearest(table(spark, d, "cluster_cache"), "vec_id", "embeddings", DIM, K, NEAR).withColumnsRenamed({"id": "vec_id", "other": "neighbour"})
    return near.withColumn("sim", F.round("sim", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(table(spark, d, "cluster_cache"), "vec_id", "embeddings", DIM, K, NEAR)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall against brute force of the vectors whose id is divisible by 100, against all rows."""
    cache = table(spark, d, "cluster_cache")
    near = materialize(vectors.nearest(cache, "vec_id", "embeddings", DIM, K, NEAR), "near")
    return vectors.recall(cache, near, "vec_id", "embeddings", DIM, K, NEAR)


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of p5_recall, and whether at least nine tenths of the true neighbours are found."""
    return p5_recall(spark, d).select("queries", "true_pairs", (F.col("recall") >= 0.9).alias("enough"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids; null texts come back empty."""
    return tokens.decode_corpus(p7_ids(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sized(table(spark, d, "documents")))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row of what every packing must keep: documents placed, containers over the capacity, documents in pieces that fit in one, gaps or
    overlaps of pieces."""
    packed = materialize(p8_packed(spark, d), "packed")
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).where(F.col("used") > packing.CAPACITY).count()
    per = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("n_tokens")).alias("ends"), F.count_distinct("piece").alias("numbers"))
    torn = F.sum((F.col("pieces") != F.ceil(F.col("n") / packing.CAPACITY)).cast("bigint"))
    gaps = F.sum(((F.col("ends") != F.col("n")) | (F.col("numbers") != F.col("pieces"))).cast("bigint"))
    return per.agg(F.count("*").alias("documents"), F.coalesce(torn, F.lit(0)).alias("torn"), F.coalesce(gaps, F.lit(0)).alias("gaps"), F.lit(over).cast("bigint").alias("over_capacity"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers and their used share."""
    return packing.fill(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spampages.spam_pages(table(spark, d, "documents")).select("doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    """The shares of every document by which p9_found decides."""
    return spampages.measures(table(spark, d, "documents"))


def p9_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Hand labels against p9_found: (label, annotator, n, agree)."""
    said = table(spark, d, "review_labels").where("doc_id IS NOT NULL").select("doc_id", "label", "annotator")
    found = spampages.measures(table(spark, d, "documents")).select("doc_id", (F.col("flagged_share") > 0.5).alias("spam"))
    same = ((F.col("label") == "not_sentences") == F.col("spam")).cast("long")
    return said.join(found, "doc_id").groupBy("label", "annotator").agg(F.count("*").alias("n"), F.sum(same).alias("agree"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Documents on which two or more annotators agree, and whether p9_found decides at least 97 in 100 of them alike."""
    said = table(spark, d, "review_labels").where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label", "annotator").distinct()
    agreed = said.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("label").alias("label"), F.max("label").alias("other")).where("n > 1 AND label = other").select("doc_id", "label")
    found = spampages.measures(table(spark, d, "documents")).select("doc_id", (F.col("flagged_share") > 0.5).alias("spam"))
    same = ((F.col("label") == "not_sentences") == F.col("spam")).cast("long")
    return agreed.join(found, "doc_id").agg(F.count("*").alias("documents"), (F.sum(same) >= 0.97 * F.count("*")).alias("alike"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p1_average": p1_average, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall, "p5_checked": p5_checked, "p3_percentiles": p3_percentiles, "p3_batch_percentiles": p3_batch_percentiles, "p3_medians": p3_medians, "p3_certified": p3_certified, "p6_found": p6_found, "p6_pairs": p6_pairs, "p6_counts": p6_counts, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_found": p9_found, "p9_measures": p9_measures, "p9_agreement": p9_agreement, "p9_checked": p9_checked}

_PAIRS = f"""
WITH e AS ({IDS}), t AS (SELECT count(DISTINCT qid) AS n_records FROM e), f AS (SELECT c, count(*) AS n FROM e GROUP BY c),
p AS (SELECT a.c AS x, b.c AS y, count(*) AS n FROM e a JOIN e b ON a.qid = b.qid AND a.c < b.c GROUP BY 1, 2)"""

_VECTORS = f"""u AS (SELECT vec_id, any_value(CAST(embeddings AS DOUBLE[{DIM}])) AS v FROM cluster_cache WHERE vec_id IS NOT NULL AND len(embeddings) = {DIM}
  AND len(list_filter(embeddings, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS x, b.vec_id AS y, array_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id)"""

_NEAR = f"""n AS (SELECT * FROM (SELECT x AS vec_id, y AS neighbour, sim, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS rank FROM
(SELECT x, y, round(sim, 12) AS sim FROM s WHERE sim >= {NEAR} UNION ALL SELECT y, x, round(sim, 12) FROM s WHERE sim >= {NEAR})) WHERE rank <= {K})"""
_LINKED = f"""l AS MATERIALIZED (SELECT x, y FROM s WHERE sim >= {SAME}), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), g AS (SELECT x AS vec_id, min(y) AS group_vec_id FROM r GROUP BY x)"""

SQL = {
    "p5_checked": f"WITH {_VECTORS}, {_NEAR} SELECT count(DISTINCT vec_id) AS queries, count(*) AS true_pairs, true AS enough FROM n WHERE vec_id % 100 = 0",
    "p1_groups": f"""
WITH RECURSIVE {_VECTORS}, {_LINKED}, w AS (SELECT vec_id, list_transform(v, lambda z: z / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u),
m AS (SELECT group_vec_id, list(s ORDER BY i) AS m FROM (SELECT group_vec_id, i, sum(x) AS s FROM (SELECT group_vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM g JOIN w USING (vec_id)) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT group_vec_id, vec_id, list_cosine_similarity(v, m) AS c FROM g JOIN w USING (vec_id) JOIN m USING (group_vec_id))
SELECT group_vec_id, count(*) AS size, list(vec_id ORDER BY round(c, 9) DESC, vec_id)[:3] AS typical, round(avg(c), 6) AS cohesion FROM c GROUP BY 1""",
    "p4_classes": f"""
WITH e AS ({IDS}), s AS (SELECT qid, list(c ORDER BY c) AS ids, count(*) AS k FROM e GROUP BY qid HAVING count(*) >= {LEAST_IDS}),
k AS (SELECT ids, min(qid) AS class_id, count(*) AS copies, any_value(k) AS k FROM s GROUP BY ids), f AS (SELECT class_id, k, unnest(ids) AS c FROM k),
o AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS o, any_value(a.k) + any_value(b.k) AS ab FROM f a JOIN f b ON a.c = b.c AND a.class_id <> b.class_id GROUP BY 1, 2),
n AS (SELECT x, count(*) AS links FROM o WHERE 10 * o >= 7 * (ab - o) GROUP BY x)
SELECT qid, class_id, copies, coalesce(links, 0) AS links FROM s JOIN k USING (ids) LEFT JOIN n ON n.x = class_id""",
    "p3_certified": """
WITH m AS (SELECT DISTINCT run_id, seq, qid, ts, batch_seq, duration FROM search_metrics), v AS (SELECT run_id, CAST(ts AS DATE) AS day, 'duration' AS metric FROM m WHERE duration >= 0 AND isfinite(duration)
UNION ALL SELECT run_id, CAST(ts AS DATE), 'batch_seq' FROM m WHERE batch_seq > 0),
g AS (SELECT 'run_day' AS scope, run_id, day, metric, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'run', run_id, NULL, metric, count(*) FROM v GROUP BY ALL UNION ALL SELECT 'day', NULL, day, metric, count(*) FROM v GROUP BY ALL)
SELECT scope, run_id, day, metric, n, q, true AS certified FROM g, (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q)""",
    "p9_checked": """WITH a AS (SELECT doc_id, min(label) AS l, max(label) AS m, count(*) AS n FROM (SELECT DISTINCT doc_id, label, annotator FROM review_labels WHERE doc_id IS NOT NULL AND label IS NOT NULL) GROUP BY 1)
SELECT count(*) AS documents, true AS alike FROM a JOIN documents USING (doc_id) WHERE n > 1 AND l = m""",
    "p8_checks": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS over_capacity FROM documents WHERE length(text) > 0",
    "p1_found": f"""
WITH RECURSIVE {_VECTORS}, l AS MATERIALIZED (SELECT x, y FROM s WHERE sim >= {SAME}), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT x AS vec_id, min(y) AS group_vec_id FROM r GROUP BY x""",
    "p3_batch_percentiles": """
WITH m AS (SELECT DISTINCT run_id, seq, qid, ts, batch_seq, duration FROM search_metrics), b AS (SELECT run_id, CAST(batch_seq AS DOUBLE) AS v FROM m WHERE batch_seq > 0),
q AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::DOUBLE AS q), c AS (SELECT run_id, v, count(*) AS k FROM b GROUP BY 1, 2),
u AS (SELECT run_id, v, sum(k) OVER (PARTITION BY run_id ORDER BY v) AS upto, sum(k) OVER (PARTITION BY run_id) AS n FROM c)
SELECT run_id, CAST(n AS BIGINT) AS n, q, min(v) AS value FROM u, q WHERE upto >= q * n GROUP BY 1, 2, 3""",
    "p6_found": f"""{_PAIRS}
SELECT CAST(x AS BIGINT) AS cluster_id_a, CAST(y AS BIGINT) AS cluster_id_b FROM p JOIN f fa ON fa.c = x JOIN f fb ON fb.c = y, t
WHERE p.n >= {PAIR_SHARE} * n_records AND p.n * n_records >= {PAIR_LIFT} * fa.n * fb.n""",
    "p6_counts": f"""{_PAIRS}
SELECT CAST(x AS BIGINT) AS cluster_id_a, CAST(y AS BIGINT) AS cluster_id_b, p.n AS n, fa.n AS n_a, fb.n AS n_b, n_records,
  round(p.n * n_records / CAST(fa.n * fb.n AS DOUBLE), 6) AS lift FROM p JOIN f fa ON fa.c = x JOIN f fb ON fb.c = y, t""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": f"""
WITH e AS ({IDS}), s AS (SELECT qid, count(*) AS k FROM e GROUP BY qid HAVING count(*) >= {LEAST_IDS}), f AS (SELECT e.* FROM e JOIN s USING (qid)),
o AS (SELECT a.qid AS x, b.qid AS y, count(*) AS o FROM f a JOIN f b ON a.c = b.c AND a.qid < b.qid GROUP BY 1, 2)
SELECT x AS qid_a, y AS qid_b FROM o JOIN s sa ON sa.qid = x JOIN s sb ON sb.qid = y WHERE 10 * o >= 7 * (sa.k + sb.k - o)""",
}
