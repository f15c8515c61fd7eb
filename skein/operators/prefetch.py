"""Prefetch plans: what to load of the next group when a group's last query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_ends(scheduled: DataFrame, last_n: int = 1, window_col: str = "window_id") -> DataFrame:
    """One row a group: first and last query with their sets, and the last_n last queries.

    scheduled: (window, qid, group_id, position, cluster_ids). Columns first_qid, first_set,
    last_qid, last_set, last_qids (in order), n_queries.
    """
    w = Window.partitionBy(window_col, "group_id").orderBy(F.desc("position"))
    tail = scheduled.withColumn("_r", F.row_number().over(w))
    return tail.groupBy(window_col, "group_id").agg(
        F.min_by("qid", "position").alias("first_qid"),
        F.min_by("cluster_ids", "position").alias("first_set"),
        F.max_by("qid", "position").alias("last_qid"),
        F.max_by("cluster_ids", "position").alias("last_set"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= last_n, F.struct("position", "qid")))), lambda x: x["qid"]).alias("last_qids"),
        F.count("*").alias("n_queries"),
    )


def plan_first(ends: DataFrame, window_col: str = "window_id") -> DataFrame:
    """(window, group_id, trigger_qid, next_group_id, targets): at a group's last query the next group's first set.

    After the last group of a window nothing is fetched: next_group_id and targets are null.
    """
    w = Window.partitionBy(window_col).orderBy("group_id")
    return ends.select(window_col, "group_id", F.col("last_qid").alias("trigger_qid"), F.lead("group_id").over(w).alias("next_group_id"), F.lead("first_set").over(w).alias("targets"))


def cluster_frequency(scheduled: DataFrame, window_col: str = "window_id") -> DataFrame:
    """(window, group_id, cluster_id, n, rank): queries of each group that touch a block, most first.

    Ties go to the block met first: by the position of its first query, then by id.
    """
    one = scheduled.select(window_col, "group_id", "position", "cluster_ids").repartition(window_col, "group_id")  # sets travel once, ids never
    e = one.select(window_col, "group_id", "position", F.explode("cluster_ids").alias("cluster_id"))
    n = e.groupBy(window_col, "group_id", "cluster_id").agg(F.count("*").alias("n"), F.min("position").alias("met"))
    w = Window.partitionBy(window_col, "group_id").orderBy(F.desc("n"), "met", "cluster_id")
    return n.withColumn("rank", F.row_number().over(w)).drop("met")


def plan_balanced(scheduled: DataFrame, ends: DataFrame, slots: int, window_col: str = "window_id") -> DataFrame:
    """(window, group_id, trigger_qid, next_group_id, rank, cluster_id, n): the next group's `slots` most used blocks."""
    nxt = plan_first(ends, window_col).where("next_group_id IS NOT NULL").drop("targets")
    freq = cluster_frequency(scheduled, window_col).where(F.col("rank") <= slots).withColumnRenamed("group_id", "next_group_id")
    return nxt.join(freq, [window_col, "next_group_id"]).select(window_col, "group_id", "trigger_qid", "next_group_id", "rank", "cluster_id", "n")


def window_top(windowed: DataFrame, top: int = 10, window_col: str = "window_id") -> DataFrame:
    """(window, rank, cluster_id, n): the most used blocks of each window; ties by first access (seq), then id."""
    e = windowed.select(window_col, "seq", F.explode("cluster_ids").alias("cluster_id"))
    n = e.groupBy(window_col, "cluster_id").agg(F.count("*").alias("n"), F.min("seq").alias("met"))
    w = Window.partitionBy(window_col).orderBy(F.desc("n"), "met", "cluster_id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(window_col, "rank", "cluster_id", "n")
