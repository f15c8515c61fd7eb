"""Result files and topics."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("grouping", "prefetch", "baseline")


def result_path(root: str, dataset: str, mode: str, nlist: int, float_value: float, linkage: str, dynamic: str, jaccard: str, stamp: str, granularity: str | None = None) -> str:
    """Folder of a run's result log: root/dataset/mode/nlist/float/linkage/dynamic/jaccard[/granularity]/stamp."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    return os.path.join(root, dataset, mode, str(nlist), str(float_value), linkage, dynamic, jaccard, *([granularity] if granularity else []), stamp)


def write_log(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a CSV log with headers; the columns in partition_by become folders. Nulls are empty fields."""
    w = rows.write.mode("append").option("header", True).option("nullValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def log_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with a folder for every batch: a batch that runs again replaces its own."""

    def f(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("header", True).csv(os.path.join(path, f"epoch={epoch}"))

    return f


def send_queries(texts: DataFrame, servers: str, topic: str) -> None:
    """Texts as UTF-8 values of a topic; needs Spark's Kafka connector on the class path."""
    texts.where("text IS NOT NULL").select(F.encode("text", "UTF-8").alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
