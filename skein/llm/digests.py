"""Percentiles of very large numeric columns (problem 3): mergeable centroid digests.

A digest is a list of centroids (mean, weight, least, most) in order of value.
Sorted values are clustered so that no centroid spans more than one unit of
k(q) = delta / pi * asin(2 q - 1): small at both ends, coarse in the middle. Equal
values are one point before clustering and a digest of few distinct values keeps
them all, so heavy ties cost no accuracy. Digests merge by clustering the union of
their centroids again; merging days, runs or partitions is the same step.

certify() counts, for every answer, the rows below and up to it: the rank error it reports is
measured, not estimated. Answers of several scopes share one second pass over the values:
between() counts the values of every group between neighbouring answers, and certify() adds these counts up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skein.runtime import materialize, small_or_none, width

#: Compression: a digest keeps at most about this many centroids.
DELTA = 400
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
#: Splits whose digests of one group are merged at once.
FAN_IN = 64
#: Values that a split sorts at once; each group's digest of these leaves it.
HELD = 2_000_000
DIGEST = "n bigint, means array<double>, weights array<double>, lows array<double>, highs array<double>"
_PARTS = ("means", "weights", "lows", "highs")


def compress(means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, ...]:
    """Centroids in any order -> at most about delta centroids in order of mean."""
    order = np.lexsort((highs, lows, means))
    m, w, lo, hi = means[order], weights[order], lows[order], highs[order]
    if len(m) == 0:
        return m, w, lo, hi
    same = np.concatenate([[True], (m[1:] != m[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    at = np.flatnonzero(same)
    if len(at) > delta:
        w1 = np.add.reduceat(w, at)
        total = w1.sum()
        mid = (np.cumsum(w1) - w1 / 2) / total
        k = np.floor(delta / math.pi * (np.arcsin(np.clip(2 * mid - 1, -1, 1)) + math.pi / 2))
        at = at[np.concatenate([[True], k[1:] != k[:-1]])]
    out_w = np.add.reduceat(w, at)
    lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
    mean = np.where(lo == hi, lo, np.clip(np.add.reduceat(m * w, at) / out_w, lo, hi))
    return mean, out_w, lo, hi


def quantile(q: Sequence[float], means: np.ndarray, weights: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Values at the quantiles: a centroid of one value answers itself, elsewhere the line through the means at the middle of their
    weights. Where centroids overlap, as after merging, their ends tell nothing of the rank, so only the first and the last end count."""
    means, weights, lows, highs = (np.asarray(x, float) for x in (means, weights, lows, highs))
    if not len(means):
        return np.full(len(q), np.nan)
    ends = np.cumsum(weights)
    rank = np.asarray(q) * ends[-1]
    at = np.minimum(np.searchsorted(ends, rank, side="left"), len(means) - 1)
    point = lows == highs
    begin, stop = np.where(point, ends - weights, ends - weights / 2), np.where(point, ends, ends - weights / 2)
    x = np.concatenate([[0.0], np.stack([begin, stop], axis=1).ravel(), [ends[-1]]])
    y = np.concatenate([[lows.min()], np.repeat(means, 2), [highs.max()]])
    return np.where(point[at], lows[at], np.interp(rank, x, np.maximum.accumulate(y)))


def digests(values: DataFrame, keys: Sequence[str], value: str, delta: int = DELTA) -> DataFrame:
    """One digest for each combination of `keys`: columns keys + DIGEST.

    Null, NaN and infinite values are left out; a group of only such values has no
    row. Null keys are a group. Every split makes its own digests, so a key of a
    third of all rows leaves a split as one row; the rows of a group merge in two
    levels.
    """
    keys = list(keys)
    types = dict(values.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "lane int", DIGEST])
    lanes = -(-width(values.sparkSession) // FAN_IN)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % lanes
        held: list[pa.RecordBatch] = []
        rows = 0

        def leave() -> pa.RecordBatch:
            """Digests of the values held: sorted and counted for all groups at once, clustered for each."""
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            code = np.zeros(t.num_rows, np.int64)
            for k in keys:
                d = t.column(k).chunk(0).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(d.dictionary) + np.asarray(d.indices), return_inverse=True)[1]
            _, first = np.unique(code, return_index=True)
            x = np.asarray(t.column(value).chunk(0))
            order = np.lexsort((x, code))
            c, v = code[order], x[order]
            at = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])]))
            w = np.diff(np.append(at, len(v)))
            c, v = c[at], v[at]
            ends = np.append(np.flatnonzero(c[1:] != c[:-1]) + 1, len(c))
            starts = np.concatenate([[0], ends[:-1]])
            digest = [(p, q, p, p) if len(p) <= delta else compress(p, q, p, p, delta) for p, q in ((v[i:j], w[i:j].astype(float)) for i, j in zip(starts, ends, strict=True))]
            offs = pa.array(np.concatenate([[0], np.cumsum([len(d[0]) for d in digest])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offs, pa.array(np.concatenate([d[i] for d in digest]), pa.float64())) for i in range(len(_PARTS))]
            cols = [t.column(k).chunk(0).take(pa.array(first)) for k in keys]
            return pa.RecordBatch.from_arrays([*(col.cast(f.type) for col, f in zip(cols, arrow, strict=False)), pa.array(np.full(len(ends), lane, np.int32)), pa.array(np.add.reduceat(w, starts).astype(np.int64)), *lists], schema=arrow)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= HELD:
                    yield leave()
                    rows = 0
        if held:
            yield leave()

    clean = values.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    parts = clean.mapInArrow(split, schema)
    return merge(parts if lanes > 1 else parts.drop("lane"), keys, delta)


def merge(parts: DataFrame, keys: Sequence[str], delta: int = DELTA) -> DataFrame:
    """Merge digests of equal keys; other columns than keys and those of DIGEST are dropped.

    Two levels: first by keys and lane (where the column is there), then by keys.
    """
    keys = list(keys)
    types = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), DIGEST])
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge runs of equal keys of a sorted stream."""
        now: tuple | None = None
        held: list[tuple[np.ndarray, ...]] = []
        out: list[tuple] = []
        n = 0

        def end() -> None:
            if held:
                d = held[0] if len(held) == 1 else compress(*(np.concatenate(c) for c in zip(*held, strict=True)), delta)
                out.append((*now, n, *d))
                held.clear()

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        for b in batches:
            own = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)) if keys else [()] * b.num_rows
            sizes = b.column(len(keys)).to_pylist()
            lists = [b.column(len(keys) + 1 + i) for i in range(len(_PARTS))]
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists[0].value_lengths()))])
            flat = [np.asarray(x.flatten(), dtype=float) for x in lists]
            for r, key in enumerate(own):
                if key != now:
                    end()
                    now, n = key, 0
                    if len(out) >= 1000:
                        yield batch()
                held.append(tuple(x[ends[r] : ends[r + 1]] for x in flat))
                n += sizes[r]
        end()
        if out:
            yield batch()

    cols = [*keys, "n", *_PARTS]

    def by(df: DataFrame, *ks: str) -> DataFrame:
        placed = df.repartition(*[F.col(k) for k in ks]).sortWithinPartitions(*ks) if ks else df.repartition(1)
        return placed.select(*cols).mapInArrow(f, schema)

    return by(by(parts, *keys, "lane") if "lane" in parts.columns else parts, *keys)


def answers(dig: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """keys, n and the array `est` of the values at the quantiles."""
    keys = list(keys)
    types = dict(dig.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n bigint, est array<double>"])

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            est = [quantile(quantiles, *row) for row in zip(*(pdf[p] for p in _PARTS), strict=True)]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "n": pdf["n"], "est": est})

    return dig.mapInPandas(f, schema)


def _finite(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return values.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))


def _same(keys: Sequence[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def all_answers(answers: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows (keys, asked): for each group of the first answers, which have all keys, its answers and those of the groups of the others that hold it, ascending."""
    out, keys = answers[0]
    out = out.select(*keys, F.col("est").alias("_0"))
    for i, (other, k) in enumerate(answers[1:], 1):
        side = other.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("est").alias(f"_e{i}"))
        out = out.join(F.broadcast(side) if small_or_none(other) else side, _same(k), "left").drop(*[f"_{c}" for c in k])
    arrays = ["_0", *[f"_e{i}" for i in range(1, len(answers))]]
    return out.select(*keys, F.array_sort(F.array_distinct(F.concat(*arrays))).alias("asked"))


def between(values: DataFrame, asked: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, low, high, n_values): the values of every group equal to an answer or between two neighbouring ones, as
    least, largest and number. One pass; at most 2 x answers + 1 rows a group, combined before the shuffle.
    asked is broadcast if its rows stay under the checked bound, else joined with AQE's skew join."""
    keys = list(keys)
    a = materialize(asked.select(*[F.col(k).alias(f"_{k}") for k in keys], "asked"), "asked")
    j = _finite(values, keys, value).join(F.broadcast(a) if small_or_none(a) else a, _same(keys))
    most = a.agg(F.max(F.size("asked"))).first()[0] or 0
    below = F.lit(0)
    for i in range(most):  # compiled comparisons instead of a lambda; beyond the array's end there is null
        below = below + F.coalesce((F.get("asked", i) < F.col("_v")).cast("int"), F.lit(0))
    g = j.groupBy(*keys, below.alias("_b"), F.array_contains("asked", F.col("_v")).alias("_hit"))
    return g.agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n_values")).drop("_b", "_hit")


def certify(values: DataFrame, ans: DataFrame, keys: Sequence[str], value: str | tuple[str, str, str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Rows (keys, n, q, value, rank_low, rank_high, rank_error) with measured ranks.

    rank_low and rank_high are the shares of the group's values below and up to
    `value`; rank_error is the distance of q from that interval (0 inside). `value`
    is always a value of the data: between two of them the closer rank is taken. values: rows of single values, or, with three
    names, of between(). ans is broadcast if its rows stay under the checked bound,
    else shuffled with the hot groups' rows spread by AQE's skew join.
    """
    keys = list(keys)
    a = ans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_n"), "est")
    if isinstance(value, str):
        v = _finite(values, keys, value).select(*keys, F.col("_v").alias("_lo"), F.col("_v").alias("_hi"), F.lit(1).cast("bigint").alias("_m"))
    else:
        v = values.select(*keys, *[F.col(c).alias(x) for c, x in zip(value, ("_lo", "_hi", "_m"), strict=True)])
    j = v.join(F.broadcast(a) if small_or_none(ans) else a, _same(keys))
    aggs = []
    for i in range(len(quantiles)):
        e = F.col("est")[i]
        aggs += [F.sum(F.when(F.col("_hi") < e, F.col("_m")).otherwise(0)).alias(f"lt{i}"), F.sum(F.when(F.col("_hi") <= e, F.col("_m")).otherwise(0)).alias(f"le{i}"), F.max(F.when(F.col("_hi") <= e, F.col("_hi"))).alias(f"dn{i}"), F.min(F.when(F.col("_lo") >= e, F.col("_lo"))).alias(f"up{i}")]
    g = j.groupBy(*[f"_{k}" for k in keys]).agg(F.first("_n").alias("n"), *aggs)
    q = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("q"), F.col(f"lt{i}").alias("lt"), F.col(f"le{i}").alias("le"), F.col(f"dn{i}").alias("dn"), F.col(f"up{i}").alias("up")) for i, p in enumerate(quantiles)]))
    r = g.select(*[F.col(f"_{k}").alias(k) for k in keys], "n", q.alias("x")).select(*keys, "n", "x.*")
    # est itself occurs (lt < le), or its neighbours do: the one below ends at rank lt = le, the one above begins there
    down = F.col("dn").isNotNull() & ((F.col("q") * F.col("n") <= F.col("le")) | F.col("up").isNull())
    low = F.when(F.col("lt") < F.col("le"), F.col("lt")).otherwise(F.col("le")) / F.col("n")
    high = F.col("le") / F.col("n")
    return r.select(*keys, "n", "q", F.when(F.col("lt") < F.col("le"), F.col("dn")).when(down, F.col("dn")).otherwise(F.col("up")).alias("value"), low.alias("rank_low"), high.alias("rank_high"), F.greatest(F.lit(0.0), low - F.col("q"), F.col("q") - high).alias("rank_error"))
