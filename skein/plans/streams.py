"""Queries that run as streams over a table's files until all are read."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.sets import clean_ids
from skein.operators import index
from skein.plans import workload
from skein.plans.tracesql import stream_sql
from skein.runtime import shared_dir, table
from skein.streaming import cachestream, groups, windows


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table's files as a stream; a table is a file or a folder of files."""
    schema = table(spark, d, name).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    return r.parquet(f"{d}/{name}.parquet") if folder else r.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _run(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All batches of a finished stream, with their number as `epoch`."""
    root = os.path.join(shared_dir(spark), "skein", uuid.uuid4().hex)

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")

    windows.run_once(stream, each, f"{root}/checkpoint", mode)
    return spark.read.parquet(f"{root}/out")


def stream_probe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily probes of every block: the last state of each count."""
    rows = _run(spark, windows.probe_counts(_stream(spark, d, "all_results"), late="60 days"), "update")
    w = Window.partitionBy("day", "cluster_id").orderBy(F.desc("epoch"))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("day", "cluster_id", "n")


def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """The window_top cache of every topic as a stateful stream."""
    costs = index.measured_costs(table(spark, d, "cluster_stats"), table(spark, d, "centroids")).collect()  # one row a block
    s = _stream(spark, d, "all_results").withColumn("topic", F.lower(F.trim("topic"))).withColumn("cluster_ids", clean_ids("cluster_ids_set"))
    t = cachestream.stream_trace(s, {r["cluster_id"]: r["latency_sec"] for r in costs}, {r["cluster_id"]: r["size_mb"] for r in costs}, 200, "window_top", "topic")
    return _run(spark, t, "append").drop("epoch").withColumnRenamed("key", "topic")


def stream_groups(spark: SparkSession, d: str) -> DataFrame:
    """The schedule of every window as its batch arrives, single linkage."""
    s = _stream(spark, d, "all_results").select("window_id", "qid", "seq", clean_ids("cluster_ids_set").alias("cluster_ids"))
    root = os.path.join(shared_dir(spark), "skein", uuid.uuid4().hex)
    windows.run_once(s, groups.group_batches(f"{root}/out", 0.3, "single"), f"{root}/checkpoint")
    return groups.newest(spark, f"{root}/out")


QUERIES = {"stream_groups": stream_groups, "stream_probe_counts": stream_probe_counts, "stream_cache": stream_cache}

SQL = {
    "stream_probe_counts": """SELECT CAST(ts AS DATE) AS day, c AS cluster_id, count(*) AS n FROM (SELECT ts, unnest(list_distinct(cluster_ids_set)) AS c FROM all_results WHERE ts IS NOT NULL) WHERE c >= 0 GROUP BY 1, 2""",
    "stream_groups": workload.SQL["schedule_single"],
    "stream_cache": f"WITH RECURSIVE {workload.COSTS}, {stream_sql(200, 60)}",
}
