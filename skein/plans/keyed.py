"""Queries of problem 2 over all_results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sets import record_sets
from skein.operators import hotkeys
from skein.runtime import table

#: Share of the queries that makes a cluster id frequent.
SHARE = 0.1

IDS = """
SELECT DISTINCT qid, c FROM (SELECT qid, unnest(cluster_ids_set) AS c FROM all_results WHERE qid IS NOT NULL) WHERE c >= 0"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return record_sets(table(spark, d, "all_results"), "qid", "cluster_ids_set")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.frequent_keys(_sets(spark, d), SHARE).select(F.col("key").alias("cluster_id").cast("bigint"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of queries of every cluster id, and the smallest, largest and sum of their qids."""
    per = hotkeys.per_key(_sets(spark, d)).where("key IS NOT NULL")
    return per.select(F.col("key").alias("cluster_id"), F.col("n").alias("n_queries"), F.col("id_min").alias("min_qid"), F.col("id_max").alias("max_qid"), F.col("id_sum").alias("sum_qid"))


def p2_postings(spark: SparkSession, d: str) -> DataFrame:
    """The qids of every cluster id, in rows of bounded length."""
    return hotkeys.postings(_sets(spark, d)).select(F.col("key").alias("cluster_id"), "part", "n", F.col("record_ids").alias("qids"))


def p2_posting_sums(spark: SparkSession, d: str) -> DataFrame:
    """What p2_postings holds of every cluster id: queries, their smallest and largest qid, and whether every row is of bounded length."""
    rows = hotkeys.postings(_sets(spark, d))
    low, high = F.min(F.array_min("record_ids")), F.max(F.array_max("record_ids"))
    return rows.groupBy(F.col("key").alias("cluster_id")).agg(F.sum("n").alias("n_queries"), low.alias("min_qid"), high.alias("max_qid"), (F.max("n") <= hotkeys.CHUNK).alias("bounded"))


QUERIES = {"p2_posting_sums": p2_posting_sums, "p2_found": p2_found, "p2_counts": p2_counts, "p2_postings": p2_postings}

SQL = {
    "p2_posting_sums": f"WITH e AS ({IDS}) SELECT c AS cluster_id, count(*) AS n_queries, min(qid) AS min_qid, max(qid) AS max_qid, true AS bounded FROM e GROUP BY c",
    "p2_found": f"""
WITH e AS ({IDS}), n AS (SELECT count(DISTINCT qid) AS n FROM e)
SELECT CAST(c AS BIGINT) AS cluster_id FROM e GROUP BY c HAVING count(*) >= {SHARE} * (SELECT n FROM n)""",
    "p2_counts": f"""
WITH e AS ({IDS})
SELECT c AS cluster_id, count(*) AS n_queries, min(qid) AS min_qid, max(qid) AS max_qid, CAST(sum(qid) AS BIGINT) AS sum_qid FROM e GROUP BY c""",
}
