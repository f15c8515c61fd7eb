"""Queries of windows, overlap, grouping, schedules, prefetch plans and cache traces over all_results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sets import clean_ids
from skein.operators import cache, grouping, index, metrics, prefetch
from skein.plans.tracesql import linkage_sql, schedule_sql, trace_sql
from skein.runtime import materialize, table
from skein.streaming import windows

#: Similarity of grouped queries, queries of a window that are grouped, blocks in the cache, slots of a plan.
LEAST, CAP, CAPACITY, SLOTS, THREADS = 0.3, 200, 200, 10, 8


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """(qid, window_id, seq, topic, ts, cluster_ids): each query as it first arrived (smallest seq), its ids cleaned."""
    r = table(spark, d, "all_results").where("qid IS NOT NULL AND seq IS NOT NULL")
    first = r.groupBy("qid").agg(F.min_by(F.struct("window_id", "seq", "topic", "ts", "cluster_ids_set"), "seq").alias("x"))
    return first.select("qid", "x.window_id", "x.seq", F.coalesce(F.lower(F.trim("x.topic")), F.lit("")).alias("topic"), "x.ts", clean_ids(F.col("x.cluster_ids_set")).alias("cluster_ids"))


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    return grouping.cap_window(_delivered(spark, d), CAP)


def window_cap(spark: SparkSession, d: str) -> DataFrame:
    """Queries of each window, and those that are grouped: the first CAP."""
    every, kept = _delivered(spark, d), _windowed(spark, d)
    n = every.groupBy("window_id").agg(F.count("*").alias("n_window"))
    k = kept.groupBy("window_id").agg(F.count("*").alias("n_grouped"), F.max("seq").alias("last_seq"))
    return n.join(k, "window_id")


def query_windows(spark: SparkSession, d: str) -> DataFrame:
    """Queries in every non-empty tumbling window of five polls of one second."""
    w = windows.poll_windows(_delivered(spark, d).where("ts IS NOT NULL"))
    return w.groupBy(F.unix_timestamp("window_start").alias("window_sec")).agg(F.count("*").alias("n_queries"))


def count_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 queries of each topic."""
    w = windows.count_windows(_delivered(spark, d), 100, ["topic"])
    return w.groupBy("topic", "window_no").agg(F.count("*").alias("n_queries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def query_chunks(spark: SparkSession, d: str) -> DataFrame:
    return grouping.chunks(_windowed(spark, d), THREADS)


def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = grouping.jaccard_pairs(_windowed(spark, d), LEAST)
    return p.withColumn("distance", F.round(1 - F.col("jaccard"), 9)).withColumn("jaccard", F.round("jaccard", 9))


def _groups(spark: SparkSession, d: str, linkage: str) -> DataFrame:
    return grouping.group_windows(_windowed(spark, d), LEAST, linkage)


def group_single_linkage(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d, "single")


def group_complete_linkage(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d, "complete")


def group_average_linkage(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d, "average")


def schedule_single(spark: SparkSession, d: str) -> DataFrame:
    return grouping.schedule(_groups(spark, d, "single"))


def schedule_arrival(spark: SparkSession, d: str) -> DataFrame:
    return grouping.pass_through(_windowed(spark, d))


def schedule_arrival_whole(spark: SparkSession, d: str) -> DataFrame:
    return grouping.pass_through(_delivered(spark, d))


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    w = materialize(_windowed(spark, d), "windowed")
    s = grouping.schedule(grouping.group_windows(w, LEAST, "single"))
    return materialize(s.join(w.select("qid", "cluster_ids"), "qid"), "scheduled")


def _scheduled_whole(spark: SparkSession, d: str) -> DataFrame:
    """As _scheduled(), of every query of every window, as the prefetching scripts group them."""
    w = materialize(_delivered(spark, d), "delivered")
    s = grouping.schedule(grouping.group_whole_windows(w, LEAST))
    return materialize(s.join(w.select("qid", "cluster_ids"), "qid"), "scheduled")


def group_ends(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.group_ends(_scheduled(spark, d), last_n=2)


def prefetch_plan_first(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.plan_first(prefetch.group_ends(_scheduled(spark, d)))


def prefetch_plan_balanced(spark: SparkSession, d: str) -> DataFrame:
    s = _scheduled(spark, d)
    return prefetch.plan_balanced(s, prefetch.group_ends(s), SLOTS)


def cluster_frequency(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.cluster_frequency(_scheduled(spark, d))


def group_ends_whole(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.group_ends(_scheduled_whole(spark, d), last_n=2)


def prefetch_plan_first_whole(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.plan_first(prefetch.group_ends(_scheduled_whole(spark, d)))


def prefetch_plan_balanced_whole(spark: SparkSession, d: str) -> DataFrame:
    s = _scheduled_whole(spark, d)
    return prefetch.plan_balanced(s, prefetch.group_ends(s), SLOTS)


def cluster_frequency_whole(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.cluster_frequency(_scheduled_whole(spark, d))


def group_complete_linkage_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every query of every window by complete linkage, the default of the runs."""
    return grouping.group_whole_windows(materialize(_delivered(spark, d), "delivered"), LEAST, "complete")


def window_top_clusters(spark: SparkSession, d: str) -> DataFrame:
    return prefetch.window_top(_delivered(spark, d), 10)


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return index.measured_costs(table(spark, d, "cluster_stats"), table(spark, d, "centroids"))


def placement_order(spark: SparkSession, d: str) -> DataFrame:
    """Load order of the blocks of every query, were none cached."""
    e = _delivered(spark, d).select("qid", F.posexplode("cluster_ids").alias("probe_rank", "cluster_id"))
    return index.placement(e, materialize(_costs(spark, d), "costs"), ["qid"], THREADS).select("qid", "cluster_id", "size_mb", "load_rank", "batch")


def adaptive_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads for loading the blocks of every query, from their measured latencies."""
    costs = _costs(spark, d).where(F.col("latency_sec") < float("inf"))
    e = _delivered(spark, d).select("qid", F.explode("cluster_ids").alias("cluster_id"))
    per = e.join(costs, "cluster_id", "left").groupBy("qid").agg(F.count("*").cast("int").alias("n_blocks"), F.sum("latency_sec").alias("total"), F.avg("latency_sec").alias("mean"))
    return per.select("qid", "n_blocks", index.adaptive_threads(F.col("total"), F.col("mean"), F.col("n_blocks")).alias("threads"))


def _topic_schedule(spark: SparkSession, d: str, linkage: str | None) -> DataFrame:
    """(topic, window_no, position, qid, group_id, cluster_ids): a stream per topic in windows of CAP queries."""
    w = windows.count_windows(_delivered(spark, d), CAP, ["topic"])
    w = materialize(w.withColumn("wkey", F.concat_ws("#", "topic", "window_no")), "topic_windows")
    s = grouping.pass_through(w, "wkey") if linkage is None else grouping.schedule(grouping.group_windows(w, LEAST, linkage, "wkey"), "wkey")
    return s.select("qid", "group_id", "position").join(w.select("qid", "topic", "window_no", "cluster_ids"), "qid")


def _trace(policy: str, linkage: str | None = None, fetch: str = "none", pipelined: bool = False):
    def f(spark: SparkSession, d: str) -> DataFrame:
        t = cache.trace(_topic_schedule(spark, d, linkage), materialize(_costs(spark, d), "costs"), CAPACITY, policy, fetch, ["topic"], "window_no", pipelined=pipelined)
        return t.withColumn("load_mb", F.round("load_mb", 4))

    return f


TRACES = {
    "cache_trace_cost_freq": _trace("cost_freq"),
    "cache_trace_lru": _trace("lru"),
    "cache_trace_fifo": _trace("fifo"),
    "cache_trace_window_topk": _trace("window_top"),
    "cache_trace_grouped": _trace("cost_freq", "complete"),
    "cache_trace_prefetch_fg": _trace("cost_freq", "complete", "first"),
    "cache_trace_prefetch_balance": _trace("cost_freq", "complete", "balance"),
    "cache_trace_pipelined": _trace("cost_freq", "complete", "balance", True),
}


def cache_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every policy and topic: in order of arrival, grouped, and grouped with either prefetch."""
    costs = materialize(_costs(spark, d), "costs")
    out = None
    for linkage in (None, "complete"):
        s = materialize(_topic_schedule(spark, d, linkage), "schedule")
        for policy in cache.POLICIES:
            for fetch in ("none",) if linkage is None else ("none", "first", "balance"):
                mode = "arrival" if linkage is None else "grouped" if fetch == "none" else f"grouped_{fetch}"
                t = cache.totals(cache.trace(s, costs, CAPACITY, policy, fetch, ["topic"], "window_no"), ["topic"])
                t = t.withColumn("policy", F.lit(policy)).withColumn("mode", F.lit(mode))
                out = t if out is None else out.unionByName(t)
    return out


def run_log(spark: SparkSession, d: str) -> DataFrame:
    """The result log of a run: grouped by complete linkage, with prefetch of the next group's first query and the cost_freq cache."""
    return metrics.run_log(_trace("cost_freq", "complete", "first")(spark, d), ["topic"])


QUERIES = {f.__name__: f for f in (run_log, query_windows, count_windows, window_cap, query_chunks, jaccard_pairs, group_single_linkage, group_complete_linkage, group_average_linkage, schedule_single, schedule_arrival, group_ends, prefetch_plan_first, prefetch_plan_balanced, cluster_frequency, schedule_arrival_whole, group_ends_whole, prefetch_plan_first_whole, prefetch_plan_balanced_whole, cluster_frequency_whole, group_complete_linkage_whole, window_top_clusters, placement_order, adaptive_threads)} | TRACES | {"cache_summary": cache_summary}

_D = """WITH RECURSIVE first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY seq) AS r FROM all_results WHERE qid IS NOT NULL AND seq IS NOT NULL) WHERE r = 1),
delivered AS (SELECT qid, window_id, seq, coalesce(lower(trim(topic)), '') AS topic, ts, coalesce(list_sort(list_distinct(list_filter(cluster_ids_set, lambda x: x >= 0))), []) AS cluster_ids FROM first)"""
_W = f"""{_D},
windowed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY seq, qid) AS rn FROM delivered) WHERE rn <= {CAP})"""
_P = f"""{_W},
e AS (SELECT window_id, qid, unnest(cluster_ids) AS c FROM windowed), inter AS (SELECT a.window_id, a.qid AS qid_a, b.qid AS qid_b, count(*) AS i
FROM e a JOIN e b ON a.window_id = b.window_id AND a.c = b.c AND a.qid < b.qid GROUP BY ALL),
pairs AS (SELECT i.window_id, qid_a, qid_b, i / CAST(len(a.cluster_ids) + len(b.cluster_ids) - i AS DOUBLE) AS jaccard, 10 * i > 3 * (len(a.cluster_ids) + len(b.cluster_ids) - i) AS above
FROM inter i JOIN windowed a ON a.qid = qid_a JOIN windowed b ON b.qid = qid_b)"""
_G = f"""{_P},
links AS (SELECT qid_a AS x, qid_b AS y FROM pairs WHERE above UNION ALL SELECT qid_b, qid_a FROM pairs WHERE above),
reach(x, y) AS (SELECT qid, qid FROM windowed UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
groups AS (SELECT w.window_id, w.qid, w.seq, min(o.seq) AS group_id FROM windowed w JOIN reach ON reach.x = w.qid JOIN windowed o ON o.qid = reach.y GROUP BY ALL),
scheduled AS (SELECT g.*, row_number() OVER (PARTITION BY g.window_id ORDER BY group_id, g.seq, g.qid) AS position, cluster_ids FROM groups g JOIN windowed USING (qid)),
ends AS (SELECT window_id, group_id, arg_min(qid, position) AS first_qid, arg_min(cluster_ids, position) AS first_set, arg_max(qid, position) AS last_qid, arg_max(cluster_ids, position) AS last_set,
  list(qid ORDER BY position)[-2:] AS last_qids, count(*) AS n_queries FROM scheduled GROUP BY ALL),
nxt AS (SELECT window_id, group_id, last_qid AS trigger_qid, lead(group_id) OVER w AS next_group_id, lead(first_set) OVER w AS targets FROM ends WINDOW w AS (PARTITION BY window_id ORDER BY group_id)),
freq AS (SELECT window_id, group_id, cluster_id, n, row_number() OVER (PARTITION BY window_id, group_id ORDER BY n DESC, met, cluster_id) AS rank FROM
  (SELECT window_id, group_id, cluster_id, count(*) AS n, min(position) AS met FROM (SELECT window_id, group_id, position, unnest(cluster_ids) AS cluster_id FROM scheduled) GROUP BY ALL))"""
COSTS = "costs AS (SELECT c.cluster_id, max(latency_sec) AS latency_sec, coalesce(max(size_mb), 0.0) AS size_mb FROM (SELECT DISTINCT cluster_id FROM centroids) c LEFT JOIN cluster_stats s ON s.cluster_id = c.cluster_id GROUP BY c.cluster_id)"

SQL = {
    "query_windows": f"{_D} SELECT CAST(floor(epoch(ts) / 5) * 5 AS BIGINT) AS window_sec, count(*) AS n_queries FROM delivered WHERE ts IS NOT NULL GROUP BY 1",
    "count_windows": f"""{_D} SELECT topic, window_no, count(*) AS n_queries, min(seq) AS first_seq, max(seq) AS last_seq FROM
(SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY seq, qid) - 1) // 100 AS window_no FROM delivered) GROUP BY 1, 2""",
    "window_cap": f"""{_W} SELECT window_id, n_window, n_grouped, last_seq FROM (SELECT window_id, count(*) AS n_window FROM delivered GROUP BY 1)
JOIN (SELECT window_id, count(*) AS n_grouped, max(seq) AS last_seq FROM windowed GROUP BY 1) USING (window_id)""",
    "query_chunks": f"""{_W} SELECT window_id, qid, seq, CAST((row_number() OVER (PARTITION BY window_id ORDER BY seq, qid) - 1) // (count(*) OVER (PARTITION BY window_id) // {THREADS} + 1) AS INTEGER) AS chunk FROM windowed""",
    "jaccard_pairs": f"{_P} SELECT window_id, qid_a, qid_b, round(jaccard, 9) AS jaccard, round(1 - jaccard, 9) AS distance FROM pairs WHERE jaccard >= {LEAST}",
    "group_single_linkage": f"{_G} SELECT window_id, qid, seq, group_id FROM groups",
    "schedule_single": f"{_G} SELECT window_id, qid, seq, group_id, CAST(position AS INTEGER) AS position FROM scheduled",
    "schedule_arrival": f"{_W} SELECT window_id, qid, seq, seq AS group_id, CAST(row_number() OVER (PARTITION BY window_id ORDER BY seq, qid) AS INTEGER) AS position FROM windowed",
    "group_ends": f"{_G} SELECT window_id, group_id, first_qid, first_set, last_qid, last_set, last_qids, n_queries FROM ends",
    "prefetch_plan_first": f"{_G} SELECT window_id, group_id, trigger_qid, next_group_id, targets FROM nxt",
    "prefetch_plan_balanced": f"""{_G} SELECT nxt.window_id, nxt.group_id, trigger_qid, next_group_id, CAST(rank AS INTEGER) AS rank, cluster_id, n FROM nxt
JOIN freq ON freq.window_id = nxt.window_id AND freq.group_id = next_group_id WHERE rank <= {SLOTS}""",
    "cluster_frequency": f"{_G} SELECT window_id, group_id, cluster_id, n, CAST(rank AS INTEGER) AS rank FROM freq",
    "window_top_clusters": f"""{_D} SELECT window_id, CAST(rank AS INTEGER) AS rank, cluster_id, n FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n DESC, met, cluster_id) AS rank FROM
(SELECT window_id, cluster_id, count(*) AS n, min(seq) AS met FROM (SELECT window_id, seq, unnest(cluster_ids) AS cluster_id FROM delivered) GROUP BY 1, 2)) WHERE rank <= 10""",
    "placement_order": f"""{_D}, {COSTS} SELECT qid, cluster_id, size_mb, CAST(load_rank AS INTEGER) AS load_rank, CAST((load_rank - 1) // {THREADS} AS INTEGER) AS batch FROM
(SELECT qid, e.cluster_id, coalesce(size_mb, 0.0) AS size_mb, row_number() OVER (PARTITION BY qid ORDER BY coalesce(size_mb, 0.0) DESC, e.cluster_id) AS load_rank
 FROM (SELECT qid, unnest(cluster_ids) AS cluster_id FROM delivered) e LEFT JOIN costs ON costs.cluster_id = e.cluster_id)""",
    "adaptive_threads": f"""{_D}, {COSTS} SELECT qid, CAST(n_blocks AS INTEGER) AS n_blocks, CAST(greatest(1, least(n_blocks, 8, least(n_blocks, ask), 2048)) AS INTEGER) AS threads FROM
(SELECT qid, count(*) AS n_blocks, CASE WHEN avg(latency_sec) > 0 THEN floor(sum(latency_sec) / (avg(latency_sec) * 2.0)) + 1 ELSE 1 END AS ask
 FROM (SELECT qid, unnest(cluster_ids) AS cluster_id FROM delivered) e LEFT JOIN (SELECT * FROM costs WHERE isfinite(latency_sec)) c ON c.cluster_id = e.cluster_id GROUP BY qid)""",
}
#: The plans of whole windows: the same without the cap.
SQL |= {f"{n}_whole": SQL[n].replace(f" WHERE rn <= {CAP})", ")") for n in ("schedule_arrival", "group_ends", "prefetch_plan_first", "prefetch_plan_balanced", "cluster_frequency")}

SQL |= {f"group_{n}_linkage": f"{_W}, {linkage_sql('windowed', 'window_id', LEAST, n)} SELECT window_id, qid, seq, group_id FROM agg" for n in ("complete", "average")}


SQL["group_complete_linkage_whole"] = f"{_D}, {linkage_sql('delivered', 'window_id', LEAST, 'complete')} SELECT window_id, qid, seq, group_id FROM agg"


def _trace_sql(policy: str, linkage: str | None = None, fetch: str = "none") -> str:
    return f"{_D}, {COSTS}, {schedule_sql(CAP, LEAST, linkage, fetch)}, {trace_sql(CAPACITY, policy, fetch)}"


SQL |= {n: f"{_trace_sql(*a)} SELECT * FROM tr" for n, a in {
    "cache_trace_cost_freq": ("cost_freq",),
    "cache_trace_lru": ("lru",),
    "cache_trace_fifo": ("fifo",),
    "cache_trace_window_topk": ("window_top",),
    "cache_trace_grouped": ("cost_freq", "complete"),
    "cache_trace_prefetch_fg": ("cost_freq", "complete", "first"),
    "cache_trace_prefetch_balance": ("cost_freq", "complete", "balance"),
}.items()}
SQL["run_log"] = f"""{_trace_sql("cost_freq", "complete", "first")} SELECT topic, seq, window_no AS batch_seq, qid, n_miss AS nmc, printf('%.3f%%', hit_ratio * 100) AS chr, num,
CAST(floor(load_mb) AS INTEGER) AS drs, len(prefetched) > 0 AS prefetch FROM
(SELECT *, row_number() OVER (PARTITION BY topic ORDER BY window_no, position) - {metrics.WARM_UP} AS seq, count(*) OVER (PARTITION BY topic, window_no) AS num FROM tr) WHERE seq > 0"""
_TOTALS = """count(*) AS queries, CAST(sum(len(hits) + len(misses)) AS BIGINT) AS requests, CAST(sum(len(hits)) AS BIGINT) AS hits, CAST(sum(len(evicted)) AS BIGINT) AS evictions,
CAST(sum(len(prefetched)) AS BIGINT) AS prefetches, round(sum(load_mb), 4) AS load_mb, round(coalesce(sum(len(hits)) / CAST(nullif(sum(len(hits) + len(misses)), 0) AS DOUBLE), 0.0), 6) AS hit_ratio"""
SQL["cache_summary"] = " UNION ALL ".join(
    f"SELECT * FROM ({_trace_sql(policy, linkage, fetch)} SELECT topic, {_TOTALS}, '{policy}' AS policy, '{mode}' AS mode FROM tr GROUP BY topic)"
    for policy in cache.POLICIES
    for mode, linkage, fetch in (("arrival", None, "none"), ("grouped", "complete", "none"), ("grouped_first", "complete", "first"), ("grouped_balance", "complete", "balance"))
)
