"""The clustered index: corpus, centroids, costs of blocks and their load order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import usable
from skein.runtime import join_checked, width

DIM = 64
#: Bytes of an element in a block's file.
ELEMENT = 4


def corpus(cache: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster_id, embedding): the usable vectors that are filed in a block, each vec_id once.

    A vector delivered again keeps its latest row (loaded_at, then the smaller
    cluster_id; null times are oldest). Rows with a null vec_id or cluster_id, or
    without a usable vector, are left out before.
    """
    ok = cache.where(F.col("vec_id").isNotNull() & F.col("cluster_id").isNotNull() & usable("embeddings", dim))
    rank = F.struct(F.col("loaded_at").isNotNull().alias("dated"), "loaded_at", (-F.col("cluster_id")).alias("c"))
    last = ok.groupBy("vec_id").agg(F.max_by(F.struct("cluster_id", "embeddings"), rank).alias("x"))
    return last.select("vec_id", "x.cluster_id", F.col("x.embeddings").alias("embedding"))


def profile(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Rows (cluster_id, n_vectors, size_mb, load_cost) of a corpus; the cost is deterministic: the number of vectors."""
    n = vectors.groupBy("cluster_id").agg(F.count("*").alias("n_vectors"))
    return n.select("cluster_id", "n_vectors", (F.col("n_vectors") * (dim * ELEMENT) / 1048576).alias("size_mb"), F.col("n_vectors").cast("double").alias("load_cost"))


def measured_costs(stats: DataFrame, centroids: DataFrame) -> DataFrame:
    """Rows (cluster_id, latency_sec, size_mb) for every block of the index.

    Profiles outside the index are dropped. A block profiled more than once takes the
    largest latency and the largest size; no known latency means infinity (never evicted
    for its cost), no known size 0.
    """
    known = stats.groupBy("cluster_id").agg(F.max("latency_sec").alias("latency_sec"), F.max("size_mb").alias("size_mb"))
    ids = centroids.select("cluster_id").where("cluster_id IS NOT NULL").distinct()
    return ids.join(known, "cluster_id", "left").select("cluster_id", F.coalesce("latency_sec", F.lit(float("inf"))).alias("latency_sec"), F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"))


def placement(misses: DataFrame, sizes: DataFrame, by: list[str], threads: int = 8) -> DataFrame:
    """Load order of the missing blocks of each query: largest first, equal sizes in probe order.

    misses: by + (probe_rank, cluster_id); sizes: (cluster_id, size_mb), unknown 0.
    Adds size_mb, load_rank (from 1) and batch (of `threads` loads, from 0).
    """
    j = join_checked(misses, sizes.select("cluster_id", "size_mb"), ["cluster_id"], "left").withColumn("size_mb", F.coalesce("size_mb", F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy(F.desc("size_mb"), "probe_rank")
    return j.withColumn("load_rank", F.row_number().over(w)).withColumn("batch", F.floor((F.col("load_rank") - 1) / threads).cast("int"))


def adaptive_threads(total_latency: Column, avg_latency: Column, missing: Column, cores: int = 8, bound: float = 2.0, memory_mb: float = 4096.0, block_mb: float = 4.0) -> Column:
    """Threads for loading `missing` blocks: at least 1, at most the blocks, the cores, what
    total / (bound * avg) asks for, and what half of the memory holds; null counts as no blocks."""
    m = F.coalesce(missing, F.lit(0))
    ask = F.when((avg_latency > 0) & (total_latency < float("inf")), F.floor(total_latency / (avg_latency * bound)).cast("int") + 1).otherwise(F.lit(1))
    return F.greatest(F.lit(1), F.least(m, F.lit(cores), F.least(m, ask), F.lit(int(memory_mb / (0.5 * block_mb)))))


#: Blocks of one directory of a written index, and bytes of vectors of a file.
SPAN, FILE = 64, 64 << 20


def write_index(vectors: DataFrame, path: str, dim: int = DIM) -> None:
    """The corpus as Parquet in the order of its blocks, SPAN blocks a directory (column `shard` = cluster_id div SPAN).

    vectors is a written table. Files hold about FILE bytes, so a block of a tenth of all rows lies in several files and a file of small
    blocks is read by row groups; the number of files follows the bytes, that of directories the blocks.
    """
    parts = max(1, min(width(vectors.sparkSession), vectors.count() * dim * ELEMENT // (1 << 20)), vectors.count() * dim * ELEMENT // FILE)
    placed = vectors.withColumn("shard", F.floor(F.col("cluster_id") / SPAN).cast("int")).repartitionByRange(parts, "cluster_id", "vec_id")
    placed.sortWithinPartitions("shard", "cluster_id", "vec_id").write.partitionBy("shard").parquet(path)


def probed(vectors: DataFrame, ids: list[int]) -> DataFrame:
    """The vectors of some blocks. Of a written index only their directories are listed and their row groups read."""
    ids = sorted({int(i) for i in ids})
    if not ids:
        return vectors.limit(0)
    of = lambda c, v: f"{c} IN ({', '.join(map(str, v))})"  # noqa: E731  one expression to parse: a Column per id is slow
    if "shard" in vectors.columns:
        vectors = vectors.where(of("shard", sorted({i // SPAN for i in ids})))
    return vectors.where(of("cluster_id", ids))


def write_partitioned(vectors: DataFrame, path: str) -> None:
    """The corpus as Parquet with one directory per block: a filter on cluster_id then reads only those.

    Rows of a block are spread over several files where it is large (range partitioning with
    vec_id as second key), so a block of a tenth of all rows doesn't become one task.
    """
    vectors.repartitionByRange("cluster_id", "vec_id").write.partitionBy("cluster_id").parquet(path)


def read_blocks(spark, path: str, ids: list[int]) -> DataFrame:
    """The vectors of some blocks of write_partitioned(); the ids become partition filters."""
    return spark.read.parquet(path).where(F.col("cluster_id").isin([int(i) for i in ids]))
