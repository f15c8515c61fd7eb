"""Grouping queries of a window by the overlap of their probe sets, and the schedule that follows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINKAGES = ("single", "complete", "average")
#: Different sets of one side of a matrix where windows have no bound.
BLOCK = 1024


def cap_window(queries: DataFrame, cap: int | None, window_col: str = "window_id", seq_col: str = "seq") -> DataFrame:
    """The first `cap` queries of every window in order of arrival (ties by qid); None keeps all.

    The rank is limited before the exchange, so a window of a third of all rows sends only
    `cap` rows per split. A null window is a window.
    """
    if cap is None:
        return queries
    w = Window.partitionBy(window_col).orderBy(seq_col, "qid")
    return queries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def _jaccard_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of sets by one product of the incidence matrix; 0 where a set is empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0)
    dic, at = np.unique(flat, return_inverse=True)
    m = np.zeros((len(sets), max(1, len(dic))))
    m[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
    inter = m @ m.T
    size = m.sum(axis=1)
    union = size[:, None] + size[None] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def jaccard_pairs(windowed: DataFrame, least: float, window_col: str = "window_id") -> DataFrame:
    """Rows (window, qid_a, qid_b, jaccard), qid_a < qid_b, of the pairs of a window with jaccard >= least > 0.

    windowed: (window, qid, seq, cluster_ids) of capped windows, each qid once in a window. A window is one
    matrix product; its number of queries is bounded by the cap.
    """
    kind = dict(windowed.dtypes)[window_col]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("qid")
        j = _jaccard_matrix([np.asarray(x) for x in pdf["cluster_ids"]])
        q = pdf["qid"].to_numpy()
        a, b = np.nonzero(np.triu(j >= least, 1))
        return pd.DataFrame({window_col: pdf[window_col].iloc[0], "qid_a": q[a], "qid_b": q[b], "jaccard": j[a, b]})

    return windowed.select(window_col, "qid", "cluster_ids").groupBy(window_col).applyInPandas(f, f"`{window_col}` {kind}, qid_a bigint, qid_b bigint, jaccard double")


def agglomerate(sim: np.ndarray, least: float, linkage: str) -> np.ndarray:
    """Labels (smallest position of the group) of agglomerative clustering of distances 1 - sim.

    Two groups merge while their linkage distance is below 1 - least, always the closest pair;
    of equals the pair whose smallest positions come first.
    """
    n = len(sim)
    dist = 1 - sim
    np.fill_diagonal(dist, np.inf)
    label, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    limit = 1 - least
    while n > 1:
        at = int(dist.argmin())  # row-major, so the first of equals has the smallest positions
        i, j = divmod(at, n)
        if not dist[i, j] < limit - 1e-12:
            break
        i, j = min(i, j), max(i, j)
        if linkage == "single":
            new = np.minimum(dist[i], dist[j])
        elif linkage == "complete":
            new = np.maximum(dist[i], dist[j])
        else:
            new = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        dist[i], dist[:, i] = new, new
        dist[j], dist[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    return label


def group_windows(windowed: DataFrame, least: float, linkage: str = "complete", window_col: str = "window_id") -> DataFrame:
    """Rows (window, qid, seq, group_id); group_id is the smallest seq of the group.

    windowed: (window, qid, seq, cluster_ids) of capped windows. A window without queries has no rows,
    one query is one group, queries with empty sets stay alone. Nulls in cluster_ids count as empty.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    kind = dict(windowed.dtypes)[window_col]

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "qid"])
        sets = [np.zeros(0, np.int64) if x is None else np.asarray(x) for x in pdf["cluster_ids"]]
        label = agglomerate(_jaccard_matrix(sets), least, linkage)
        seq = pdf["seq"].to_numpy()
        return pd.DataFrame({window_col: pdf[window_col].iloc[0], "qid": pdf["qid"], "seq": seq, "group_id": seq[label]})

    return windowed.select(window_col, "qid", "seq", "cluster_ids").groupBy(window_col).applyInPandas(f, f"`{window_col}` {kind}, qid bigint, seq bigint, group_id bigint")


def _star(near: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes joined by `near`, left by right (by left without right); root is the smallest node joined."""
    nodes = left if right is None else np.concatenate([left, right])
    root = np.full(len(nodes), -1)
    n = len(left)
    for start in range(n):
        if root[start] >= 0:
            continue
        members, front = [start], np.array([start])
        root[start] = start
        while len(front):
            if right is None:
                new = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            else:
                rows, cols = front[front < n], front[front >= n] - n
                new = np.concatenate([np.flatnonzero(near[:, cols].any(axis=1) & (root[:n] < 0)), n + np.flatnonzero(near[rows].any(axis=0) & (root[n:] < 0))])
            root[new] = start
            members += new.tolist()
            front = new
        root[members] = members[int(nodes[members].argmin())]
    met = root >= 0
    return nodes[met], nodes[root[met]]


def sparse_complete(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> dict[int, int]:
    """agglomerate() by complete linkage over the pairs a < b that may merge: node -> smallest node of its group, for the ends of pairs.

    A group's distance to another is known only if all their pairs may merge; other groups never do.
    """
    import heapq

    near: dict[int, dict[int, float]] = {}
    for x, y, d in zip(a.tolist(), b.tolist(), dist.tolist(), strict=True):
        near.setdefault(x, {})[y] = d
        near.setdefault(y, {})[x] = d
    label = {x: x for x in near}
    heap = list(zip(dist.tolist(), a.tolist(), b.tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        d, i, j = heapq.heappop(heap)
        if i not in near or near[i].get(j) != d:
            continue
        label[j] = i
        gone = near.pop(j)
        for k in gone:
            near[k].pop(j)
        for k in [k for k in near[i] if k not in gone]:
            near[i].pop(k), near[k].pop(i)
        for k, own in near[i].items():
            if gone[k] > own:
                near[i][k] = near[k][i] = gone[k]
                heapq.heappush(heap, (gone[k], min(i, k), max(i, k)))
    for x in sorted(label):  # a node is merged into a smaller one
        label[x] = label[label[x]]
    return label


def group_whole_windows(windowed: DataFrame, least: float, linkage: str = "single", window_col: str = "window_id") -> DataFrame:
    """Rows (window, qid, seq, group_id) as of group_windows() by single or complete linkage, for windows of any size.
    windowed is a written table.

    Equal sets of a window are one node; nodes are cut into blocks of BLOCK, and every pair of blocks meets in a cell of its own.
    Single linkage groups are the connected components of the pairs that may merge: a cell returns a star per component, at most 2 x BLOCK rows,
    which are joined per window. Complete linkage needs the pairs that may merge themselves; their merges run per window.
    """
    from skein.runtime import materialize

    if linkage not in ("single", "complete"):
        raise ValueError("linkage is single or complete")
    w = windowed.select(window_col, "qid", "seq", F.to_json(F.struct(window_col)).alias("_w"), F.array_sort(F.array_distinct(F.filter(F.coalesce("cluster_ids", F.array()), lambda x: x.isNotNull()))).alias("_set"))
    sets = w.where(F.size("_set") > 0).groupBy("_w", "_set").agg(F.min("seq").alias("low"))
    sets = sets.withColumn("node", F.row_number().over(Window.partitionBy("_w").orderBy("low", "_set")) - 1)
    sets = materialize(sets, "sets")
    parts = sets.groupBy("_w").agg((F.floor(F.max("node") / BLOCK) + 1).cast("int").alias("parts"))
    own = F.floor(F.col("node") / BLOCK).cast("int")
    cells = sets.join(parts, "_w").withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("_w", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "_set")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        node, dist = pdf["node"].to_numpy(), 1 - _jaccard_matrix([np.asarray(x) for x in pdf["_set"]])
        near = dist < 1 - least - 1e-12
        left = (pdf["own"] == i).to_numpy()
        if linkage == "complete":
            x, y = np.nonzero(np.triu(near, 1))
            x, y = (x, y) if i == j else (x[left[x] & ~left[y]], y[left[x] & ~left[y]])
            return pd.DataFrame({"_w": pdf["_w"].iloc[0], "node": node[x], "root": node[y], "dist": dist[x, y]})
        if i == j:
            x, root = _star(near, node, None)
        else:
            x, root = _star(near[np.ix_(left, ~left)], node[left], node[~left])
        return pd.DataFrame({"_w": pdf["_w"].iloc[0], "node": x, "root": root, "dist": 0.0})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        if linkage == "complete":
            label = sparse_complete(pdf["node"].to_numpy(), pdf["root"].to_numpy(), pdf["dist"].to_numpy())
            return pd.DataFrame({"_w": pdf["_w"].iloc[0], "node": list(label), "root": list(label.values())})
        nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        root = np.searchsorted(nodes, pdf["root"].to_numpy())
        label = np.arange(len(nodes))
        while True:
            m = np.minimum(label[at], label[root])
            new = label.copy()
            np.minimum.at(new, at, m)
            np.minimum.at(new, root, m)
            new = new[new]
            if (new == label).all():
                break
            label = new
        return pd.DataFrame({"_w": pdf["_w"].iloc[0], "node": nodes, "root": nodes[label]})

    links = cells.groupBy("_w", "i", "j").applyInPandas(meet, "_w string, node int, root int, dist double")
    roots = links.groupBy("_w").applyInPandas(join, "_w string, node int, root int")
    groups = roots.join(sets.select("_w", F.col("node").alias("root"), F.col("low").alias("group_id")), ["_w", "root"]).select("_w", "node", "group_id")
    named = sets.join(groups, ["_w", "node"], "left").select("_w", "_set", F.coalesce("group_id", "low").alias("group_id"))
    return w.join(named, ["_w", "_set"], "left").select(window_col, "qid", "seq", F.coalesce("group_id", "seq").alias("group_id"))


def schedule(groups: DataFrame, window_col: str = "window_id") -> DataFrame:
    """Adds `position` (from 1 in each window): groups in order of first arrival, arrival order within a group."""
    w = Window.partitionBy(window_col).orderBy("group_id", "seq", "qid")
    return groups.withColumn("position", F.row_number().over(w))


def pass_through(windowed: DataFrame, window_col: str = "window_id") -> DataFrame:
    """The ungrouped schedule: arrival order, every query its own group."""
    w = Window.partitionBy(window_col).orderBy("seq", "qid")
    return windowed.select(window_col, "qid", "seq", F.col("seq").alias("group_id")).withColumn("position", F.row_number().over(w))


def chunks(windowed: DataFrame, workers: int = 8, window_col: str = "window_id") -> DataFrame:
    """(window, qid, seq, chunk): consecutive slices of n // workers + 1 queries of each window."""
    rank = Window.partitionBy(window_col).orderBy("seq", "qid")
    every = Window.partitionBy(window_col)
    size = F.floor(F.count("*").over(every) / workers) + 1
    return windowed.select(window_col, "qid", "seq", F.floor((F.row_number().over(rank) - 1) / size).cast("int").alias("chunk"))


class Centres:
    """Centres of k-means that are kept between batches: one scan of a batch adds up k sums per split, only k x dim numbers reach the driver."""

    def __init__(self, first: np.ndarray) -> None:
        self.at = first
        self.seen = np.zeros(len(first), np.int64)

    def sums(self, vectors: DataFrame, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the vectors nearest to each centre (ties to the first)."""
        from skein.functions.vectors import matrix, pairwise_l2

        send = vectors.sparkSession.sparkContext.broadcast(self.at)

        def add(batches):
            import pyarrow as pa

            c = send.value
            t, n = np.zeros(c.shape), np.zeros(len(c), np.int64)
            for b in batches:
                x = matrix(b.column(0), c.shape[1])
                at = pairwise_l2(x, c).argmin(axis=1)
                np.add.at(t, at, x)
                n += np.bincount(at, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(n), pa.array(list(t), pa.list_(pa.float64()))], names=["g", "n", "t"])

        dim = self.at.shape[1]
        rows = vectors.select(vec_col).mapInArrow(add, "g int, n bigint, t array<double>")
        total = rows.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(dim)]).orderBy("g").toPandas()
        return total["n"].to_numpy(), total[[f"t{i}" for i in range(dim)]].to_numpy()

    def partial_fit(self, vectors: DataFrame, vec_col: str) -> None:
        """Move each centre to the mean of all vectors that it was given so far and in this batch."""
        n, total = self.sums(vectors, vec_col)
        some = n > 0
        self.at = self.at.copy()
        self.at[some] = (self.at[some] * self.seen[some, None] + total[some]) / (self.seen[some] + n[some])[:, None]
        self.seen = self.seen + n

    def predict(self, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        from skein.functions.vectors import matrix, pairwise_l2

        send = vectors.sparkSession.sparkContext.broadcast(self.at)

        def assign(batches):
            import pyarrow as pa

            for b in batches:
                at = pairwise_l2(matrix(b.column(1), send.value.shape[1]), send.value).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at)], names=[id_col, "group_id"])

        return vectors.select(id_col, vec_col).mapInArrow(assign, f"`{id_col}` {dict(vectors.dtypes)[id_col]}, group_id int")


def _first(vectors: DataFrame, k: int, dim: int, id_col: str, vec_col: str) -> np.ndarray | None:
    from skein.functions.vectors import matrix

    start = vectors.orderBy(id_col).select(vec_col).limit(k).toArrow().combine_chunks()
    return matrix(start.column(0).chunk(0), dim) if start.num_rows else None


def minibatch_groups(vectors: DataFrame, tick_col: str, k: int, dim: int, id_col: str = "qid", vec_col: str = "qvec") -> DataFrame:
    """Rows (id_col, group_id): tick after tick, the centres are fitted to the tick's vectors and give these their groups.

    vectors is a written table. The first centres are the first tick's k vectors of smallest id; ticks are few (one scan each), null ticks come
    first. The order within a tick has no influence.
    """
    kind = dict(vectors.dtypes)[id_col]
    out, centres = vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, group_id int"), None
    for r in vectors.select(tick_col).distinct().orderBy(F.asc_nulls_first(tick_col)).collect():
        batch = vectors.where(F.col(tick_col).eqNullSafe(F.lit(r[0])))
        centres = centres or Centres(_first(batch, k, dim, id_col, vec_col))
        centres.partial_fit(batch, vec_col)
        out = out.unionAll(centres.predict(batch, id_col, vec_col))
    return out


def kmeans_groups(vectors: DataFrame, k: int, dim: int, rounds: int = 5, id_col: str = "qid", vec_col: str = "qvec") -> DataFrame:
    """Rows (id_col, group_id) of k-means over vectors: the grouping as full-batch rounds.

    The first centres are the k vectors of smallest id. Empty groups keep their centre.
    """
    first = _first(vectors, k, dim, id_col, vec_col)
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {dict(vectors.dtypes)[id_col]}, group_id int")
    centres = Centres(first)
    for _ in range(rounds):
        n, total = centres.sums(vectors, vec_col)
        new = centres.at.copy()
        new[n > 0] = total[n > 0] / n[n > 0][:, None]
        done, centres.at = np.array_equal(new, centres.at), new
        if done:
            break
    return centres.predict(vectors, id_col, vec_col)
