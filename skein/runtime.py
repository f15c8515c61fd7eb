"""Session settings, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a side that this library broadcasts by itself.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and bench.py use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(conf.pop("partitions", 8)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where unset, a fresh local one that goes with the process, but only on a local master: a cluster's
    executors would write to disks of their own, so there it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        d = f"file://{d}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d


#: Paths of the tables written by materialize() and not yet deleted.
_written: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back.

    Cuts the lineage: later stages survive the loss of executors without
    recomputing what lies before, and every reader sees the same rows. scratch() deletes what is written inside it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "skein", uuid.uuid4().hex, label)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that outlive scratch(): (application, key) -> (state of the source, the table as read).
_kept: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def kept(source: DataFrame, key: str, write: Callable[[str], None]) -> DataFrame:
    """A table derived from the files of `source` that stays for the session, like an index: written by write(path)
    at the first call and again when the files, their sizes or times have changed."""
    spark = source.sparkSession
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    state = []
    for f in sorted(source.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(f)
        st = at.getFileSystem(conf).getFileStatus(at)
        state.append((f, st.getLen(), st.getModificationTime()))
    name = (spark.sparkContext.applicationId, key)
    if name not in _kept or _kept[name][0] != tuple(state):
        path = os.path.join(shared_dir(spark), "skein", uuid.uuid4().hex, "kept")
        write(path)
        _kept[name] = (tuple(state), spark.read.parquet(path))  # its files are listed once
    return _kept[name][1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the intermediate tables that were written inside: write a query's result within it.

        with scratch(spark):
            p5_found(spark, d).write.parquet(out)
    """
    mark = len(_written)
    try:
        yield
    finally:
        for path in _written[mark:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _written[mark:]


def small_or_none(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df, a written table, has at most `limit` rows and so may be broadcast."""
    return df.limit(limit + 1).count() <= limit


def join_checked(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with `side` broadcast only if its counted rows stay under BROADCAST_ROWS, else shuffled."""
    return big.join(F.broadcast(side) if small_or_none(side) else side, on, how)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
