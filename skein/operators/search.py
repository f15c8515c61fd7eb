"""Coarse probes and exact search in the probed blocks, or in all.

Up to QUERIES queries are held by every task; the corpus is scanned where it lies, once, and never
shuffled. A task multiplies its vectors with the queries that probe their block and keeps the k best
for each query, so what is shuffled is at most k rows per query and split. Of a written index the probed
blocks alone are read.

More queries than that meet the blocks by a join: a block's vectors and its queries are each cut into groups of
bounded size, and every group of vectors meets every group of queries in a cell. The blocks are read
once whatever the number of queries; neither a hot block nor one that every query probes is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import matrix, pairwise_l2
from skein.operators.index import probed
from skein.runtime import join_checked, materialize

#: Query vectors that every task holds (5 MB of 64 doubles each 10,000), and the most centroids that are broadcast.
QUERIES, CENTROIDS = 10_000, 200_000
#: Vectors, and queries, of a block that meet in one cell.
CELL = 20_000


def coarse_probe(queries: DataFrame, centroids: DataFrame, nprobe: int, dim: int, id_col: str = "qid", vec_col: str = "qvec") -> DataFrame:
    """Rows (id_col, probe_rank, cluster_id, dist) of the nprobe nearest centroids by squared L2, ties by cluster_id.

    queries: usable vectors, any number; they stay in their splits. The centroids are the
    index's fixed list; their number is checked before they are broadcast. Centroids with a
    null id or vector are left out; fewer than nprobe give what there is.
    """
    kept = centroids.where(F.col("cluster_id").isNotNull() & (F.size("centroid") == dim))
    rows = kept.select(F.col("cluster_id").cast("int"), "centroid").limit(CENTROIDS + 1).toArrow().sort_by("cluster_id").combine_chunks()
    if rows.num_rows > CENTROIDS:
        raise ValueError(f"more than {CENTROIDS} centroids: build a coarser index over them first")
    kind = dict(queries.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, probe_rank int, cluster_id int, dist double"
    if not rows.num_rows:
        return queries.sparkSession.createDataFrame([], schema)
    ids = rows.column("cluster_id").to_numpy()
    send = queries.sparkSession.sparkContext.broadcast((ids, matrix(rows.column("centroid").chunk(0), dim)))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = send.value
        n = min(nprobe, len(ids))
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                d = pairwise_l2(matrix(part.column(1), dim), c)
                # centroids are in order of id, so a stable order breaks ties by id
                best = np.argsort(d, axis=1, kind="stable")[:, :n]
                who = np.repeat(np.arange(part.num_rows), n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows)), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(d, best, 1).ravel())], names=[id_col, "probe_rank", "cluster_id", "dist"])

    return queries.select(id_col, vec_col).mapInArrow(f, schema)


def probe_sets(probes: DataFrame, id_col: str = "qid") -> DataFrame:
    """(id_col, cluster_ids): the probed ids as ascending sets."""
    return probes.groupBy(id_col).agg(F.sort_array(F.collect_set("cluster_id")).alias("cluster_ids"))


SCHEMA = "qid bigint, vec_id bigint, cluster_id int, dist double"


class Best:
    """The k best (query, vector) pairs of each query, or of each query and block."""

    def __init__(self, k: int, per_cluster: bool) -> None:
        self.k, self.per_cluster = k, per_cluster
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, who: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, cluster: int) -> None:
        """Compare queries q (numbers `who`) with vectors x (ids `vec`) of a block."""
        for t in range(0, len(who), 1024):
            d = pairwise_l2(q[t : t + 1024], x)
            if len(x) > self.k:
                cutoff = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
                i, j = np.nonzero(d <= cutoff[:, None])  # all of a tie
            else:
                i, j = (y.ravel() for y in np.indices(d.shape))
            self.parts.append((who[t + i], vec[j], np.full(len(i), cluster, np.int32), d[i, j]))
            self.held += len(i)
            if self.held > 1_000_000:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        w, v, c, d = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((v, d, c, w) if self.per_cluster else (v, d, w))
        w, v, c, d = w[order], v[order], c[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (self.per_cluster & (c[1:] != c[:-1]))]))
        rank = np.arange(len(w)) - np.repeat(at, np.diff(np.append(at, len(w))))
        keep = rank < self.k
        self.parts = [(w[keep], v[keep], c[keep], d[keep])]
        self.held = len(self.parts[0][0])
        return self.parts[0]

    def batch(self, qid: np.ndarray) -> pa.RecordBatch:
        w, v, c, d = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(qid[w]), pa.array(v), pa.array(c), pa.array(d)], names=["qid", "vec_id", "cluster_id", "dist"])


def search(queries: DataFrame, corpus: DataFrame, k: int, dim: int, probes: DataFrame | None = None, per_cluster: bool = False, many: bool = False) -> DataFrame:
    """Rows (qid, rank, vec_id, cluster_id, dist): the k nearest corpus vectors of every query, ties by vec_id.

    queries: (qid BIGINT, qvec), usable, each qid once. With probes (qid, cluster_id) only
    the probed blocks are searched, a block that isn't there gives nothing. per_cluster
    keeps the k best of each block instead (rank within the block). Fewer vectors than k
    give fewer rows; the whole result is exact. `many`: more than QUERIES queries are expected, none are held.
    """
    spark = queries.sparkSession
    one = queries.select(F.col("qid").cast("bigint").alias("qid"), "qvec")
    rows = None if many else one.limit(QUERIES + 1).toArrow().combine_chunks()
    if rows is not None and rows.num_rows <= QUERIES:
        found = _scan(rows, corpus, k, dim, probes, per_cluster) if rows.num_rows else spark.createDataFrame([], SCHEMA)
    elif probes is not None:
        found = _cells(one, corpus, k, dim, probes, per_cluster)
    else:  # every query against every vector: that work dwarfs a scan for each block of queries
        found = spark.createDataFrame([], SCHEMA)
        blocks = -(-queries.count() // QUERIES)
        for blk in range(blocks):
            here = one.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == blk).toArrow().combine_chunks()  # about QUERIES rows
            if here.num_rows:
                found = found.unionAll(_scan(here, corpus, k, dim, None, per_cluster))
    w = Window.partitionBy("qid", *(["cluster_id"] if per_cluster else [])).orderBy("dist", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "cluster_id", "dist")


def _scan(rows: pa.Table, corpus: DataFrame, k: int, dim: int, probes: DataFrame | None, per_cluster: bool) -> DataFrame:
    """The k best of each split, for queries that every task holds; probes: of these queries or of more."""
    qid, q = rows.column("qid").to_numpy(), matrix(rows.column("qvec").chunk(0), dim)
    probing = None
    scan = corpus
    if probes is not None:
        p = probes.select(F.col("qid").cast("bigint"), "cluster_id").toArrow()  # QUERIES x nprobe rows at most
        c, at = p.column("cluster_id").to_numpy(), np.argsort(qid)
        who = at[np.searchsorted(qid[at], p.column("qid").to_numpy())]
        order = np.argsort(c, kind="stable")
        ids, start = np.unique(c[order], return_index=True)
        probing = dict(zip(ids.tolist(), np.split(who[order], start[1:]), strict=True))
        scan = probed(corpus, ids.tolist())
    send = corpus.sparkSession.sparkContext.broadcast((qid, q, probing))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, probing = send.value
        best = Best(k, per_cluster)
        every = np.arange(len(qid))
        for b in batches:
            vec, clu, x = np.asarray(b.column(0)), np.asarray(b.column(1)), matrix(b.column(2), dim)
            order = np.argsort(clu, kind="stable")
            ids, start = np.unique(clu[order], return_index=True)
            for c, rows in zip(ids.tolist(), np.split(order, start[1:]), strict=True):
                who = every if probing is None else probing.get(c)
                for s in range(0, len(rows) if who is not None else 0, 4096):
                    best.add(who, q[who], vec[rows[s : s + 4096]], x[rows[s : s + 4096]], c)
        if best.parts:
            yield best.batch(qid)

    return scan.select(F.col("vec_id").cast("bigint"), F.col("cluster_id").cast("int"), "embedding").mapInArrow(f, SCHEMA)


def _cells(queries: DataFrame, corpus: DataFrame, k: int, dim: int, probes: DataFrame, per_cluster: bool) -> DataFrame:
    """The k best of each cell, a group of a block's vectors and one of its queries."""
    probes = materialize(probes.select(F.col("qid").cast("bigint").alias("qid"), F.col("cluster_id").cast("int").alias("cluster_id")), "probes")
    asked = probes.groupBy("cluster_id").agg(F.count("*").alias("m"))
    loads = corpus.groupBy(F.col("cluster_id").cast("int").alias("cluster_id")).agg(F.count("*").alias("n")).join(asked, "cluster_id")
    grid = materialize(loads.select("cluster_id", F.ceil(F.col("n") / CELL).cast("int").alias("vs"), F.ceil(F.col("m") / CELL).cast("int").alias("qs")), "grid")
    vectors = join_checked(corpus.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("cluster_id").cast("int").alias("cluster_id"), "embedding"), grid, ["cluster_id"])
    vectors = vectors.select("cluster_id", F.pmod(F.xxhash64("vec_id"), "vs").cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "vec_id", "embedding")
    who = join_checked(probes, grid, ["cluster_id"]).join(queries, "qid")
    who = who.select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), F.pmod(F.xxhash64("qid"), "qs").cast("int").alias("q"), "qid", "qvec")

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        best = Best(k, per_cluster)
        if left.num_rows and right.num_rows:
            qid, vec = left.column("qid").to_numpy(), right.column("vec_id").to_numpy()
            q, x = matrix(left.column("qvec").chunk(0), dim), matrix(right.column("embedding").chunk(0), dim)
            for s in range(0, len(x), 4096):
                best.add(np.arange(len(q)), q, vec[s : s + 4096], x[s : s + 4096], right.column("cluster_id")[0].as_py())
        if not best.parts:
            return pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("cluster_id", pa.int32()), ("dist", pa.float64())]).empty_table()
        return pa.Table.from_batches([best.batch(qid)])

    return who.groupBy("cluster_id", "v", "q").cogroup(vectors.groupBy("cluster_id", "v", "q")).applyInArrow(f, SCHEMA)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (queries, true_rows, hits, recall) of a search against the exact one; no queries give a null recall."""
    hit = truth.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("true_rows"), F.count("hit").alias("hits"), (F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"))
