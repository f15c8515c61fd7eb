"""Grouping records into similarity clusters (problem 1).

Reciprocal-nearest-neighbour average linkage on a sparse graph. The links are pairs of
vectors at or above the threshold, found by the hashing of skein.llm.vectors. Every round all
pairs of clusters that are each other's best merge at once, if their average is at the threshold;
the links between two clusters become one link with their sum and number. It ends when no
link is left at the threshold. Two readings of the average:

- "linked": the mean of the links there are, so that chains stay together: this is
  the grouping that p1_found defines. The best links of every vector and enough to
  connect whatever is connected give the same groups as all links, so no group's pairs are all made.
- "all": missing links count as 0, the usual average linkage on a sparse graph.
  Every met link takes part, and a class of exact copies weighs as many as it has.

While there are more than LOCAL links, a round is one aggregate for the best of every cluster, one for
the mutual pairs and one for the new links, over the whole cluster, and each round's merges and links are written
tables; links shrink by a constant factor. What is left, at most LOCAL links, ends in one task on
arrays, by the same rule. Where links leave no pair but one mutual in each round (the arms
of a star), ROUNDS bounds the rounds of "linked": what is still linked then is joined at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.vectors import Collection, usable
from skein.runtime import join_checked, materialize, small_or_none

#: Links up to which one task runs the rounds.
LOCAL = 2_000_000
#: Rounds of "linked" over the cluster and, again, in a task, after which all that is linked is joined.
ROUNDS = 60
#: A mean of links at the threshold can miss it by rounding.
SLACK = 1e-12
#: Links kept for every vector besides those that connect, where links there are decide ("linked").
LINKS = 8


def components(links: DataFrame) -> DataFrame:
    """Rows (v, label) of the ends of links (a, b): label is the smallest id of the component.

    Minima over neighbours with pointer jumping, until nothing changes; every round is a written table.
    """
    both = materialize(links.select(F.col("a").alias("v"), F.col("b").alias("o")).unionAll(links.select(F.col("b").alias("v"), F.col("a").alias("o"))), "ends")
    labels = materialize(both.groupBy("v").agg(F.least(F.min("o"), F.first("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("o"), F.col("label").alias("l")), "o").groupBy("v").agg(F.min("l").alias("l"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "l").alias("l"))
        jump = step.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        new = materialize(step.join(jump, "l", "left").select("v", F.col("label").alias("old"), F.least("l", F.coalesce("ll", "l")).alias("label")), "labels")
        labels = new.select("v", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels


def link_rounds(a: np.ndarray, b: np.ndarray, s: np.ndarray, least: float, linkage: str, na: np.ndarray | None = None, nb: np.ndarray | None = None, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Clusters of the ends of links: (ids, cluster of each, rounds). A cluster's name is its smallest id.

    na, nb: equal vectors that each end stands for (1 without). s: similarities; with w, sums over w links.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(ids)
    x, y = at[: len(a)], at[len(a) :]
    size = np.ones(n)
    if na is not None:
        size[x], size[y] = na, nb
    if w is None:
        w = size[x] * size[y]
        s = s * w
    x, y = np.minimum(x, y), np.maximum(x, y)
    where = np.arange(n)
    rounds = 0
    while len(x):
        if linkage == "linked" and rounds == ROUNDS:
            where = _joined(x, y, n)[where]
            break
        mean = s / (w if linkage == "linked" else size[x] * size[y])
        ok = mean >= least - SLACK
        order = np.lexsort((y[ok], x[ok], -mean[ok]))
        live = np.flatnonzero(ok)[order]
        if not len(live):
            break
        rounds += 1
        place = np.full(n, len(live))
        np.minimum.at(place, x[live], np.arange(len(live)))
        np.minimum.at(place, y[live], np.arange(len(live)))
        k = np.arange(len(live))
        mutual = live[(place[x[live]] == k) & (place[y[live]] == k)]
        to = np.arange(n)
        to[y[mutual]] = x[mutual]
        size[x[mutual]] += size[y[mutual]]
        where = to[where]
        x, y = to[x], to[y]
        x, y = np.minimum(x, y), np.maximum(x, y)
        cross = x != y
        x, y, s, w = x[cross], y[cross], s[cross], w[cross]
        if len(x):
            order = np.lexsort((y, x))
            x, y, s, w = x[order], y[order], s[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            x, y, s, w = x[first], y[first], np.add.reduceat(s, first), np.add.reduceat(w, first)
    return ids, ids[where], rounds


def _joined(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Smallest node that each of n nodes is joined with by the links x, y."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _round(edges: DataFrame, least: float, linkage: str) -> DataFrame:
    """The merges (lo, hi, size) of one round, a written table. edges: (x, y, s, w, nx, ny), x < y."""
    mean = F.col("s") / (F.col("w") if linkage == "linked" else F.col("nx") * F.col("ny"))
    live = edges.withColumn("m", mean).where(F.col("m") >= least - SLACK)
    rank = F.struct("m", (-F.col("x")).alias("i"), (-F.col("y")).alias("j"))
    ends = F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("y").alias("o")), F.struct(F.col("y").alias("c"), F.col("x").alias("o"))))
    best = live.select(ends.alias("e"), rank.alias("r"), (F.col("nx") + F.col("ny")).alias("size")).groupBy("e.c").agg(F.max(F.struct("r", "e.o", "size")).alias("b"))
    pairs = best.select(F.least("c", "b.o").alias("lo"), F.greatest("c", "b.o").alias("hi"), "b.size").groupBy("lo", "hi").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return materialize(pairs.where("n = 2").select("lo", "hi", "size"), "merges")


def _contract(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """The links after a round, a written table."""
    new = materialize(merges.select(F.col("lo").alias("was"), F.col("lo").alias("now"), "size").unionAll(merges.select("hi", "lo", "size")), "renamed")
    for end, n in (("x", "nx"), ("y", "ny")):
        joined = join_checked(edges, new.withColumnRenamed("was", end), [end], "left")
        edges = joined.select(*[c for c in ("x", "y", "s", "w", "nx", "ny") if c not in (end, n)], F.coalesce("now", end).alias(end), F.coalesce("size", n).alias(n))
    flip = F.col("x") > F.col("y")
    edges = edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "s", "w", F.when(flip, F.col("ny")).otherwise(F.col("nx")).alias("nx"), F.when(flip, F.col("nx")).otherwise(F.col("ny")).alias("ny"))
    return materialize(edges.groupBy("x", "y", "nx", "ny").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).select("x", "y", "s", "w", "nx", "ny"), "edges")


def linked_clusters(links: DataFrame, least: float, linkage: str = "linked", local: int = LOCAL) -> DataFrame:
    """Rows (v, c) of the ends of links (a, b, sim), a < b, each pair once; c is the cluster's smallest id.

    links is a written table. With columns na and nb each end stands for so many equal vectors.
    """
    nx, ny = (F.col(c).cast("double") if c in links.columns else F.lit(1.0) for c in ("na", "nb"))
    edges = links.select(F.col("a").alias("x"), F.col("b").alias("y"), (F.col("sim") * nx * ny).alias("s"), (nx * ny).alias("w"), nx.alias("nx"), ny.alias("ny"))
    merged: list[DataFrame] = []
    last = None  # (hi, c) of what the rounds left, where no task ends them
    while not small_or_none(edges, local):
        if linkage == "linked" and len(merged) == ROUNDS:
            last = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("v").alias("hi"), F.col("label").alias("c"))
            break
        merges = _round(edges, least, linkage)
        if merges.limit(1).count() == 0:
            last = merges.select("hi", F.col("lo").alias("c"))
            break
        merged.append(merges)
        edges = _contract(edges, merges)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(c)) for c in range(6)] for b in batches]
        if parts:
            x, y, s, w, nx, ny = (np.concatenate(v) for v in zip(*parts, strict=True))
            ids, c, _ = link_rounds(x, y, s, least, linkage, nx, ny, w)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(c)], names=["hi", "c"])

    if last is None:  # at most `local` links
        last = edges.repartition(1).select("x", "y", "s", "w", "nx", "ny").mapInArrow(f, "hi bigint, c bigint")
    if not merged:
        return last.select(F.col("hi").alias("v"), "c")
    last = materialize(last, "ended")
    for merges in reversed(merged):  # what was merged in a round went where its cluster went later
        went = merges.select("hi", F.col("lo")).join(last.withColumnRenamed("hi", "lo"), "lo", "left").select("hi", F.coalesce("c", "lo").alias("c"))
        last = materialize(last.unionAll(went), "ended")
    ends = links.select(F.col("a").alias("hi")).unionAll(links.select("b")).distinct()
    return ends.join(last, "hi", "left").select(F.col("hi").alias("v"), F.coalesce("c", "hi").alias("c"))


def vector_groups(df: DataFrame, id_col: str, vec_col: str, dim: int, least: float, linkage: str = "linked", local: int = LOCAL) -> DataFrame:
    """Rows (id, group_id) of every usable vector in a group of at least two; group_id is its smallest id.

    Usable: dim finite elements, not all zero, and an id. Rows of one id are one
    vector; copies under different ids are in one group. An empty table gives no rows.
    """
    c = Collection(df, id_col, vec_col, dim)
    met = c.neighbours(LINKS, least, spanning=True) if linkage == "linked" else c.neighbours(None, least)
    links = materialize(met.where("id < other").groupBy(F.col("id").alias("a"), F.col("other").alias("b")).agg(F.max("sim").alias("sim")), "links")
    if c.has_copies and linkage != "linked":
        n = materialize(c.members().groupBy("rep").agg(F.count("*").alias("n")), "sizes")
        for end in ("a", "b"):
            links = join_checked(links, n.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}")), [end], "left").fillna(1, [f"n{end}"])
        links = materialize(links.select("a", "b", "sim", "na", "nb"), "weighted")
    groups = linked_clusters(links, least, linkage, local).select(F.col("v").alias("id"), F.col("c").alias("group_id"))
    if c.has_copies:
        groups = materialize(groups, "groups")
        copies = c.members().where("id <> rep")
        extra = copies.join(groups.select(F.col("id").alias("rep"), F.col("group_id").alias("g")), "rep", "left").select("id", F.coalesce("g", "rep").alias("group_id"))
        reps = copies.select(F.col("rep").alias("id")).distinct().join(groups, "id", "left_anti").select("id", F.col("id").alias("group_id"))
        groups = groups.unionByName(extra).unionByName(reps)
    if linkage == "linked":
        return groups  # a link's ends never end alone
    groups = materialize(groups, "groups")
    size = groups.groupBy("group_id").count().where("count > 1").select("group_id")
    return groups.join(size, "group_id").select("id", "group_id")


def _directions(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def describe(df: DataFrame, groups: DataFrame, id_col: str, vec_col: str, dim: int, top: int = 3) -> DataFrame:
    """Rows (group_id, size, typical, cohesion): the `top` members nearest the group's mean direction
    (ties by id) and the mean cosine of the members to it. groups: a written table (id, group_id)."""
    one = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).join(groups, "id").dropDuplicates(["id"])
    one = materialize(one.select("id", "group_id", "vec"), "members")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable(b.column(1), b.column(2), dim)
            g, at = np.unique(ids, return_inverse=True)
            t = np.zeros((len(g), dim))
            np.add.at(t, at, _directions(x))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.bincount(at, minlength=len(g)).astype(np.int64)), pa.array(list(t), pa.list_(pa.float64()))], names=["group_id", "n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2).flatten()).reshape(-1, dim)) for b in batches if b.num_rows]
        if got:
            k, n, t = (np.concatenate(v) for v in zip(*got, strict=True))
            g, at = np.unique(k, return_inverse=True)
            m, out = np.zeros(len(g), np.int64), np.zeros((len(g), dim))
            np.add.at(m, at, n)
            np.add.at(out, at, t)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(m), pa.array(list(out), pa.list_(pa.float64()))], names=["group_id", "n", "total"])

    schema = "group_id bigint, n bigint, total array<double>"
    means = materialize(one.select("id", "group_id", "vec").mapInArrow(sums, schema).repartition("group_id").mapInArrow(add, schema), "means")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _directions(np.asarray(b.column(2).flatten(), dtype=np.float64).reshape(-1, dim))
            t = np.asarray(b.column(4).flatten()).reshape(-1, dim)
            cos = (u * t).sum(axis=1) / np.maximum(np.linalg.norm(t, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(cos)], names=["id", "group_id", "n", "cos"])

    side = F.broadcast(means) if small_or_none(means, 50_000) else means
    scored = one.join(side, "group_id").select("id", "group_id", "vec", "n", "total").mapInArrow(near, "id bigint, group_id bigint, n bigint, cos double")
    scored = materialize(scored, "scored")
    w = Window.partitionBy("group_id").orderBy(F.desc(F.round("cos", 9)), "id")  # rounding makes ties of copies ties
    best = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    typical = best.groupBy("group_id").agg(F.expr("transform(array_sort(collect_list(struct(r, id))), p -> p.id)").alias("typical"))
    return scored.groupBy("group_id").agg(F.first("n").alias("size"), F.round(F.avg("cos"), 6).alias("cohesion")).join(typical, "group_id").select("group_id", "size", "typical", "cohesion")
