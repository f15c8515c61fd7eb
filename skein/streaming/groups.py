"""Grouping of arriving windows: every micro-batch's windows are grouped and scheduled as they come, with all rows seen of them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import grouping


def group_batches(path: str, least: float, linkage: str = "complete", cap: int | None = 200, window_col: str = "window_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function writing the schedule of a batch's windows to path/epoch=n as Parquet.

    Batches: (window, qid, seq, cluster_ids). The rows of all batches stay under path.rows, so a window that
    comes in several batches is grouped again from all its rows, and a query delivered again, in whatever
    batch, counts once, as it first arrived (smallest seq). path.windows names the windows that each batch
    wrote; newest() reads the last schedule of each. A batch that runs again replaces its folders. An empty
    batch writes no rows.
    """

    def f(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("qid IS NOT NULL AND seq IS NOT NULL").select(window_col, "qid", "seq", "cluster_ids")
        rows.write.mode("overwrite").parquet(os.path.join(f"{path}.rows", f"epoch={epoch}"))
        seen = spark.read.schema(rows.schema).parquet(*[os.path.join(f"{path}.rows", f"epoch={e}") for e in range(epoch + 1)])
        came = spark.read.schema(rows.schema).parquet(os.path.join(f"{path}.rows", f"epoch={epoch}")).select("qid").distinct()
        # also windows that lose a query to one where it arrived earlier
        touched = seen.join(came, "qid", "left_semi").select(F.col(window_col).alias("_w")).distinct()
        touched.write.mode("overwrite").parquet(os.path.join(f"{path}.windows", f"epoch={epoch}"))
        touched = spark.read.schema(touched.schema).parquet(os.path.join(f"{path}.windows", f"epoch={epoch}"))
        first = seen.groupBy("qid").agg(F.min_by(F.struct(window_col, "seq", "cluster_ids"), "seq").alias("x")).select(f"x.{window_col}", "qid", "x.seq", "x.cluster_ids")
        one = first.join(touched, F.col(window_col).eqNullSafe(F.col("_w")), "left_semi")
        groups = grouping.group_windows(grouping.cap_window(one, cap, window_col), least, linkage, window_col)
        grouping.schedule(groups, window_col).write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch}"))

    return f


def newest(spark: SparkSession, path: str, window_col: str = "window_id") -> DataFrame:
    """The last schedule of every window that group_batches() wrote to path."""
    last = spark.read.parquet(f"{path}.windows").groupBy("_w").agg(F.max("epoch").alias("_e"))
    rows = spark.read.parquet(path)
    return rows.join(last, F.col(window_col).eqNullSafe(F.col("_w")) & (F.col("epoch") == F.col("_e")), "left_semi").drop("epoch")
