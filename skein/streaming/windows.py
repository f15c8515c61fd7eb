"""Windows over arriving queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def poll_windows(queries: DataFrame, polls: int = 5, poll_sec: int = 1, ts_col: str = "ts") -> DataFrame:
    """Adds `window_start`: tumbling windows of `polls` polls of `poll_sec` seconds, by event time; null times have none."""
    sec = polls * poll_sec
    start = F.floor(F.unix_timestamp(F.col(ts_col).cast("timestamp")) / sec) * sec
    return queries.withColumn("window_start", F.timestamp_seconds(start))


#: Sequence numbers that are ranked together.
SPAN = 1_000_000


def count_windows(queries: DataFrame, size: int, by: list[str]) -> DataFrame:
    """Adds `window_no` from 0: consecutive runs of `size` queries in order of (seq, qid) within each `by`.

    Ranks are taken within spans of SPAN sequence numbers and shifted by the sizes of the spans before, so the queries of
    one key are never sorted in one task. Null sequence numbers come first.
    """
    s = queries.withColumn("_span", F.coalesce(F.floor(F.col("seq") / SPAN), F.lit(-(1 << 62))))
    n = s.groupBy(*by, "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = n.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_span").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_span") == F.col("_s")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "_span").orderBy("seq", "qid")) - 1
    ranked = s.withColumn("_place", place).join(spans, on)
    return ranked.withColumn("window_no", F.floor((F.col("_before") + F.col("_place")) / size)).drop("_span", "_s", "_before", "_place", *[f"_k{i}" for i in range(len(by))])


def probe_counts(stream: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(day, cluster_id, n) of (ts, cluster_ids_set): probes of each block a window; on a stream, with a watermark.

    A row counts an id once. Null times, nulls and ids below 0 don't count; on a stream, neither do rows
    later than `late` behind the newest.
    """
    s = stream.select(F.col("ts").cast("timestamp").alias("ts"), "cluster_ids_set").where("ts IS NOT NULL").withWatermark("ts", late)
    e = s.select("ts", F.explode(F.array_distinct("cluster_ids_set")).alias("cluster_id")).where("cluster_id >= 0")
    return e.groupBy(F.window("ts", width).alias("w"), "cluster_id").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "cluster_id", "n")


def run_once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, `each` taking its batches, and stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
