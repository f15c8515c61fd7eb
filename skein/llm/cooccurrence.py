"""Items that appear together (problem 6): exact pair counts against a fitted null.

Counting. Every input split adds the pairs of its records into counts of its
own (a dense array while the universe is small enough, sorted codes beyond),
and one row per pair it saw leaves the split; a record's pairs are never rows.

Null. The bipartite configuration model with the same expected item frequencies
and basket sizes: item i is in basket b with probability x_i y_b / (1 + x_i y_b).
Items of equal frequency share x and baskets of equal size share y, so the fit
runs on two histograms. Under it the joint count of two items is Poisson
binomial; its upper tail is taken by a saddlepoint approximation and judged
under false-discovery control (Benjamini-Hochberg on a fixed grid of p-values).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.hotkeys import per_key
from skein.runtime import join_checked, materialize

#: Distinct items up to which a split counts in a dense triangle (8 bytes a pair).
DENSE_ITEMS = 2_000
#: Pairs made at once.
STEP = 2_000_000
#: Pairs that a split holds at once beyond that.
SPARSE_STEP = 2_000_000
#: Different frequencies, and different record sizes, that the null is fitted to; more are binned.
BINS = 4096
#: Edges of the grid of p-values, in natural logarithms.
GRID = np.concatenate([[-700.0, -500.0, -400.0], np.arange(-300, -50, 5.0), np.arange(-50, 0.001, 0.05)])


def _pairs(s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of all pairs of s items, at most about STEP at a time."""
    if s * (s - 1) // 2 <= STEP:
        yield np.triu_indices(s, 1)
        return
    for i in range(s - 1):
        for j in range(i + 1, s, STEP):
            to = np.arange(j, min(s, j + STEP))
            yield np.full(len(to), i), to


def pair_counts(records: DataFrame, items: DataFrame, id_col: str = "id", keys_col: str = "ids") -> DataFrame:
    """Rows (a, b, n), a < b, of all pairs of keys in at least one record.

    records: arrays of distinct ascending BIGINT or INT keys, one row a record.
    items: one row `key` for each key; only its number of rows matters here.
    Null and one-element arrays give no pair.
    """
    small = items.limit(DENSE_ITEMS + 1).count() <= DENSE_ITEMS
    schema = "a bigint, b bigint, n bigint"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n"]
        dic: np.ndarray = np.zeros(0, np.int64)
        dense = np.zeros((0, 0), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def shrink() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ab = np.concatenate([x for x, _ in held])
            n = np.concatenate([x for _, x in held])
            order = np.lexsort((ab[:, 1], ab[:, 0]))
            ab, n = ab[order], n[order]
            new = np.concatenate([[True], (ab[1:] != ab[:-1]).any(axis=1)])
            at = np.flatnonzero(new)
            return ab[at, 0], ab[at, 1], np.add.reduceat(n, at)

        for batch in batches:
            lists = batch.column(0)
            lens = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.asarray(lists.flatten()).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(lens)])[:-1]
            if small:
                fresh = np.union1d(dic, flat)
                if len(fresh) > len(dic):
                    at = np.searchsorted(fresh, dic)
                    grown = np.zeros((len(fresh), len(fresh)), np.int64)
                    grown[np.ix_(at, at)] = dense
                    dic, dense = fresh, grown
                flat = np.searchsorted(dic, flat)
            for s in np.unique(lens[lens > 1]):
                starts = offs[lens == s]
                step = max(1, STEP // (s * (s - 1) // 2))
                for k in range(0, len(starts), step):
                    m = flat[starts[k : k + step, None] + np.arange(s)]
                    for i, j in _pairs(s):
                        if small:
                            dense += np.bincount((m[:, i] * len(dic) + m[:, j]).ravel(), minlength=dense.size).reshape(dense.shape)
                            continue
                        ab = np.stack([m[:, i].ravel(), m[:, j].ravel()], axis=1)
                        held.append((ab, np.ones(len(ab), np.int64)))
                        size += len(ab)
                        if size >= SPARSE_STEP:
                            a, b, n = shrink()
                            held, size = [(np.stack([a, b], axis=1), n)], len(n)
                            if size > SPARSE_STEP // 2:  # few repeats: let the shuffle add them up
                                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=names)
                                held, size = [], 0
        if small and dense.size:
            a, b = np.nonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array(dic[a]), pa.array(dic[b]), pa.array(dense[a, b])], names=names)
        elif held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in shrink()], names=names)

    return records.select(keys_col).mapInArrow(split, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))


def binned(values: np.ndarray, counts: np.ndarray, most: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts as they are, up to `most` of them; else the means and counts of bins of equal ratio, at most `most`.

    A bin is narrower than a relative (largest / smallest) ** (1 / most): under 0.6 % for 4,096 bins of frequencies up to 10**10.
    """
    values, counts = values.astype(float), counts.astype(float)
    if len(values) <= most:
        return values, counts
    low, high = np.log(values.min()), np.log(values.max())
    at = np.minimum(((np.log(values) - low) / (high - low) * most).astype(int), most - 1)
    n = np.bincount(at, counts, most)
    mean = np.bincount(at, values * counts, most)
    return mean[n > 0] / n[n > 0], n[n > 0]


def fit_null(freq: np.ndarray, n_items: np.ndarray, size: np.ndarray, n_baskets: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitness (x of each frequency, y of each size) of the bipartite configuration model.

    n_items items have frequency freq, n_baskets baskets have size `size`. An item
    in every basket and a basket of all items get a fitness of 1e12.
    """
    freq, size = freq.astype(float), size.astype(float)
    total = float((freq * n_items).sum())
    if total <= 0:
        return np.zeros(len(freq)), np.zeros(len(size))
    x, y = freq / math.sqrt(total), size / math.sqrt(total)
    for _ in range(rounds):
        x2 = np.minimum(freq / ((n_baskets * y) / (1 + np.outer(x, y))).sum(axis=1), 1e12)
        y2 = np.minimum(size / ((n_items * x2) / (1 + np.outer(y, x2))).sum(axis=1), 1e12)
        done = max(np.abs(x2 / x - 1).max(), np.abs(y2 / y - 1).max()) < tol
        x, y = x2, y2
        if done:
            break
    return x, y


def log_tail(q: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X >= n) of X = sum over s of Binomial(m_s, q_s); q has a row for each n.

    Lugannani-Rice saddlepoint with the lattice correction; near the mean, where
    it is undefined, the normal approximation with a skewness term. The possible
    maximum is exact and 0 has the tail 1.
    """
    q = np.clip(q, 0.0, 1 - 1e-15)
    mu, var = (m * q).sum(axis=1), (m * q * (1 - q)).sum(axis=1)
    sd = np.sqrt(np.maximum(var, 1e-300))
    skew = (m * q * (1 - q) * (1 - 2 * q)).sum(axis=1) / sd**3
    z = (n - 0.5 - mu) / sd
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    upper = 0.5 * _erfc(z / math.sqrt(2))
    near = np.clip(upper + skew * (z * z - 1) * phi / 6, 1e-300, 1.0)
    out = np.log(near)
    top = np.broadcast_to(m, q.shape).astype(float).copy()
    top[q <= 0] = 0
    most = top.sum(axis=1)
    far = (z > 0.75) & (n < most) & (var > 0)
    if far.any():
        qf, nf = q[far], n[far].astype(float)
        t = np.log(nf / np.maximum(mu[far], 1e-300))
        for _ in range(60):
            e = qf * np.exp(np.minimum(t, 600))[:, None]
            r = e / (1 - qf + e)
            k1, k2 = (m * r).sum(axis=1), (m * r * (1 - r)).sum(axis=1)
            step = np.clip((nf - k1) / np.maximum(k2, 1e-12), -1.0, 1.0)
            t = t + step
            if np.abs(step).max() < 1e-9:
                break
        e = qf * np.exp(np.minimum(t, 600))[:, None]
        r = e / (1 - qf + e)
        k0 = (m * np.log1p(qf * np.expm1(np.minimum(t, 600))[:, None])).sum(axis=1)
        k2 = (m * r * (1 - r)).sum(axis=1)
        w = np.sqrt(np.maximum(2 * (t * nf - k0), 1e-12))
        u = -np.expm1(-t) * np.sqrt(np.maximum(k2, 1e-12))
        lphi = -w * w / 2 - 0.5 * math.log(2 * math.pi)
        mills = _mills(w)
        out[far] = lphi + np.log(np.maximum(mills + 1 / u - 1 / w, 1e-300))
    full = (n >= most) & (n > 0)
    if full.any():
        out[full] = np.where(n[full] > most[full], -np.inf, (m * np.log(np.where(q[full] > 0, q[full], 1.0))).sum(axis=1))
    out[n <= 0] = 0.0
    return np.minimum(out, 0.0)


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def _mills(w: np.ndarray) -> np.ndarray:
    """(1 - Phi(w)) / phi(w) for w > 0, by erfc or, beyond 25, its expansion."""
    big = w > 25
    small = np.where(big, 1.0, w)
    exact = 0.5 * _erfc(small / math.sqrt(2)) / (np.exp(-small * small / 2) / math.sqrt(2 * math.pi))
    v = np.where(big, w, 25.0)
    return np.where(big, 1 / v - 1 / v**3 + 3 / v**5, exact)


def associations(records: DataFrame, id_col: str = "id", keys_col: str = "ids", alpha: float = 0.05) -> DataFrame:
    """Every pair of items of at least one common record, with its surprise.

    Columns a < b, n, n_a, n_b, n_records (N), lift = n N / (n_a n_b), expected
    (under the null), log_p (ln of the upper tail), q (false-discovery rate, on
    the grid), surprising (q <= alpha). records: one row per record with distinct
    ascending keys. An empty table gives no rows. The fit sees a histogram of item
    frequencies and one of record sizes, never the items themselves.
    """
    sets = materialize(records.select(F.col(id_col).alias("id"), F.col(keys_col).alias("ids")), "sets")
    spark = sets.sparkSession
    counts = materialize(per_key(sets), "items")
    items = counts.where("key IS NOT NULL").select(F.col("key").cast("bigint").alias("key"), "n")
    first = counts.where("key IS NULL").select("n").first()
    total = first["n"] if first else 0
    pairs = materialize(pair_counts(sets, items), "pairs")
    freq = items.groupBy("n").count().collect()  # different frequencies: under the square root of twice all entries
    size = sets.where(F.size("ids") > 0).groupBy(F.size("ids").alias("s")).count().collect()
    fs, fm = np.array([r["n"] for r in freq], float), np.array([r["count"] for r in freq], float)
    ss, sm = np.array([r["s"] for r in size], float), np.array([r["count"] for r in size], float)
    n_items = int(fm.sum())
    fs, fm = binned(fs, fm)
    ss, sm = binned(ss, sm)
    x, y = fit_null(fs, fm, ss, sm) if total else (np.zeros(0), np.zeros(0))
    order = np.argsort(fs)
    known = (np.log(fs[order]), np.log(np.maximum(x[order], 1e-300)))
    tests = n_items * (n_items - 1) / 2

    joined = join_checked(pairs, items.select(F.col("key").alias("a"), F.col("n").alias("n_a")), ["a"])
    joined = join_checked(joined, items.select(F.col("key").alias("b"), F.col("n").alias("n_b")), ["b"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, na, nb = (np.asarray(batch.column(k)) for k in range(5))
            exp, logp = np.empty(len(n)), np.empty(len(n))
            for k in range(0, len(n), 20_000):
                s = slice(k, k + 20_000)
                xa, xb = (np.exp(np.interp(np.log(f[s]), *known)) for f in (na, nb))  # exact where frequencies aren't binned
                pa_, pb = np.outer(xa, y), np.outer(xb, y)
                q = (pa_ / (1 + pa_)) * (pb / (1 + pb))
                exp[s] = (q * sm).sum(axis=1)
                logp[s] = log_tail(q, sm, n[s])
            edge = np.minimum(np.searchsorted(GRID, logp), len(GRID) - 1).astype(np.int32)  # the first that isn't below
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, n, na, nb, exp, logp, edge)], names=["a", "b", "n", "n_a", "n_b", "expected", "log_p", "bin"])

    scored = joined.select("a", "b", "n", "n_a", "n_b").mapInArrow(score, "a bigint, b bigint, n bigint, n_a bigint, n_b bigint, expected double, log_p double, bin int")
    scored = materialize(scored, "scored")
    # Benjamini-Hochberg on the grid: the rate at an edge e is e * tests / (pairs with p <= e).
    bins = scored.groupBy("bin").count().collect()  # at most one row per edge
    per = np.zeros(len(GRID))
    for r in bins:
        per[r["bin"]] = r["count"]
    upto = np.cumsum(per)
    rate = np.minimum(1.0, np.exp(GRID) * tests / np.maximum(upto, 1))
    q = np.minimum.accumulate(rate[::-1])[::-1]
    look = F.lit([float(v) for v in q])
    return scored.withColumn("q", F.element_at(look, F.col("bin") + 1)).select(
        "a", "b", "n", "n_a", "n_b", F.lit(total).cast("bigint").alias("n_records"),
        (F.col("n") * F.lit(total) / (F.col("n_a") * F.col("n_b"))).alias("lift"), "expected", "log_p", "q", (F.col("q") <= alpha).alias("surprising"),
    )
