"""Most similar vectors for every vector (problem 5): cross-polytope hashing.

Unit vectors are turned by pseudo-rotations H D1 H D2 H D3 (H the Hadamard
transform, D random signs) and go to the nearest signed axis; where the collection
is large, further turned coordinates refine the bucket. Every table takes a vector
into its best and its second-best bucket (multiprobe), so close vectors meet in
some table with high probability. A table row carries its vector: buckets compare
exactly what they hold, by blocks of matrix products, and results are exact
cosines in double precision. Only candidates can be missed, never values.

Sizes. The number of buckets follows the number of rows so that buckets keep
their size, and a table is added for each doubling of the buckets. Buckets that
still exceed the bound (many near-copies) are cut into groups, and every pair of
groups meets in a cell of its own: an exact join in blocks, spread over tasks.
Exact copies are reduced to their smallest id before, by a map-side combining
aggregate, so copies never meet in a bucket at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import BROADCAST_ROWS, materialize, small_or_none, width

#: Rows (with probes) of a bucket that a cell takes whole.
TARGET = 16_384
#: Tables at the coarsest level.
TABLES = 3
#: A vector goes to its second-best bucket too if the two axes differ by less than GAP / sqrt(dim), else
#: across its smallest refining coordinate if that one is less than GAP / sqrt(dim).
GAP = 0.25
#: Rows of one side of a block of products.
BLOCK = 1024
#: Tolerance of single-precision products before the exact test.
SLACK = 1e-5
#: Longest vectors (padded) whose rotations are applied as matrices: up to there one product beats the butterflies.
DENSE = 256
#: Buckets that the driver places one by one; with more, it only knows the oversized ones.
PLACED = 100_000
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform along the last axis, a power of two."""
    x = x.copy()
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / x.dtype.type(np.sqrt(n))


class Hash:
    """Tables of cross-polytope buckets for vectors of `dim` elements and about `rows` rows."""

    def __init__(self, dim: int, rows: int, tables: int | None = None) -> None:
        self.dim, self.padded = dim, 1 << max(0, dim - 1).bit_length()
        self.levels = max(0, int(np.ceil(np.log2(max(1, 2 * rows / (2 * self.padded) / TARGET)))))
        self.tables = tables or TABLES + self.levels
        rng = np.random.default_rng(SEED)
        draw = lambda: np.stack([rng.choice([-1.0, 1.0], self.padded) for _ in range(3)]).astype(np.float32)
        self.signs = [draw() for _ in range(2 * self.tables)]  # of the axes, then of the refining coordinates
        self.matrices = None
        if self.padded <= DENSE:
            columns = [self.padded] * self.tables + [self.levels] * self.tables
            self.matrices = [self._turned(np.eye(self.padded), k)[:dim, :n].astype(np.float32) for k, n in enumerate(columns)]
        self.buckets = 2 * self.padded << self.levels

    def _turned(self, x: np.ndarray, k: int) -> np.ndarray:
        """H D3 H D2 H D1 x of padded vectors."""
        for signs in self.signs[k]:
            x = hadamard(x * signs)
        return x

    def turn(self, unit: np.ndarray, k: int) -> np.ndarray:
        if self.matrices is not None:
            return unit @ self.matrices[k]
        return self._turned(np.pad(unit, ((0, 0), (0, self.padded - self.dim))), k)

    def probes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, 2 * tables) numbers of the best and second-best bucket of each table, -1 for one not probed."""
        out = np.empty((len(unit), 2 * self.tables), np.int64)
        r = np.arange(len(unit))
        for t in range(self.tables):
            y = self.turn(unit, t)
            a = np.abs(y)
            first = a.argmax(axis=1)
            top = a[r, first]
            a[r, first] = -1
            second = a.argmax(axis=1)
            near = top - a[r, second] < GAP / np.sqrt(self.padded)
            sub = np.zeros(len(unit), np.int64)
            fine = self.turn(unit, self.tables + t)[:, : self.levels] if self.levels else np.zeros((len(unit), 0))
            for k in range(self.levels):
                sub = sub * 2 + (fine[:, k] < 0)
            for c, axis in enumerate((first, second)):
                out[:, 2 * t + c] = t * self.buckets + (((axis * 2 + (y[r, axis] < 0)) << self.levels) | sub)
            out[~near, 2 * t + 1] = -1
            if self.levels:
                close = np.abs(fine)
                k = close.argmin(axis=1)
                across = ~near & (close[r, k] < GAP / np.sqrt(self.padded))
                out[across, 2 * t + 1] = t * self.buckets + ((out[:, 2 * t] - t * self.buckets) ^ (1 << (self.levels - 1 - k)))[across]
        return out


def _tally(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(np.concatenate(more), return_counts=True)
    k, at = np.unique(np.concatenate([keys, u]), return_inverse=True)
    return k, np.bincount(at, np.concatenate([counts, n]), len(k)).astype(np.int64)


def usable(ids: pa.Array, vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors of the rows with an id and dim finite elements that aren't all zero."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    n = np.asarray(vecs.value_lengths().fill_null(-1))
    ok = (n == dim) & np.asarray(ids.is_valid())
    kept = vecs.filter(pa.array(ok))
    flat = kept.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)  # null elements become NaN
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.asarray(ids.filter(pa.array(ok)))[fine].astype(np.int64), x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(axis=1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the exact elements of each row (-0.0 as 0.0)."""
    w = (x + np.float32(0)).view(np.uint32).astype(np.uint64)
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(2):
        m = rng.integers(1, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = (w * m).sum(axis=1, dtype=np.uint64)
        h ^= h >> np.uint64(29)
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32))
        out.append(h.view(np.int64))
    return out[0], out[1]


class Collection:
    """The usable vectors of a table, with the classes of exact copies and the loads of the buckets."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dim: int, tables: int | None = None) -> None:
        self.vectors = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
        self.dim = dim
        self.rows = df.count()  # from the files' footers
        self.hash = Hash(dim, self.rows, tables)
        survey = materialize(self._survey(), "survey")
        self.buckets = survey.where("kind = 1").select(F.col("h1").alias("bucket"), "n")
        self.copies = survey.where("kind = 0").select("h1", "h2", F.col("low").alias("rep"))
        self.has_copies = self.copies.limit(1).count() > 0

    def _survey(self) -> DataFrame:
        """Classes of copies with different ids (kind 0) and loads of buckets (kind 1)."""
        h, dim = self.hash, self.dim

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["kind", "h1", "h2", "id", "n"]

            def loads(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
                none = pa.array(np.zeros(len(keys), np.int64))
                return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int8)), pa.array(keys), none, none, pa.array(counts)], names=names)

            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            held: list[np.ndarray] = []
            for b in batches:
                ids, x = usable(b.column(0), b.column(1), dim)
                if len(ids):
                    h1, h2 = fingerprint(x)
                    p = h.probes(unit(x)).ravel()
                    held.append(p[p >= 0])
                    if len(held) >= 16:
                        keys, counts = _tally(keys, counts, held)
                        held = []
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int8)), pa.array(h1), pa.array(h2), pa.array(ids), pa.array(np.ones(len(ids), np.int64))], names=names)
                if len(keys) > 10 * PLACED:  # let the shuffle add them up
                    yield loads(keys, counts)
                    keys, counts = keys[:0], counts[:0]
            if held:
                keys, counts = _tally(keys, counts, held)
            yield loads(keys, counts)

        rows = self.vectors.mapInArrow(f, "kind tinyint, h1 bigint, h2 bigint, id bigint, n bigint")
        per = rows.groupBy("kind", "h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("n"))
        return per.where("kind = 1 OR low < high").select("kind", "h1", "h2", "low", "n")

    def members(self) -> DataFrame:
        """Rows (id, rep) of all vectors that have a copy under another id; rep is the smallest id."""
        dim = self.dim

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, x = usable(b.column(0), b.column(1), dim)
                h1, h2 = fingerprint(x) if len(ids) else (ids, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h1), pa.array(h2)], names=["id", "h1", "h2"])

        prints = self.vectors.mapInArrow(f, "id bigint, h1 bigint, h2 bigint")
        side = F.broadcast(self.copies) if small_or_none(self.copies) else self.copies
        return prints.join(side, ["h1", "h2"]).select("id", "rep").distinct()

    def cells(self) -> tuple[dict[int, int], dict[int, list[int]] | None, int]:
        """Groups of each oversized bucket, the partition of each cell of each bucket, and the number of partitions.

        Up to PLACED buckets their cells are dealt out, the costliest first; with more, the placement is
        None and cells go where a hash sends them (place()), so what the driver and the tasks hold doesn't grow with the rows.
        """
        few = small_or_none(self.buckets, PLACED)
        rows = (self.buckets if few else self.buckets.where(F.col("n") > 2 * TARGET)).collect()  # at most PLACED, or the oversized ones
        groups = {r["bucket"]: -(-r["n"] // TARGET) for r in rows if r["n"] > 2 * TARGET}
        sent = sum(r["n"] * groups.get(r["bucket"], 1) for r in rows)
        count = sum(g * (g + 1) // 2 for g in groups.values()) + len(rows) - len(groups)
        if not few:
            rest = self.buckets.where(F.col("n") <= 2 * TARGET).agg(F.sum("n").alias("n"), F.count("*").alias("m")).first()
            sent, count = sent + (rest["n"] or 0), count + rest["m"]
        bytes_ = sent * (4 * self.dim + 8)
        parts = max(1, min(count, max(width(self.vectors.sparkSession), bytes_ // (48 << 20))))
        if not few:
            return groups, None, parts
        work = []
        for r in rows:
            g = groups.get(r["bucket"], 1)
            cost = (r["n"] / g) ** 2 + 2000 * r["n"] / g
            work += [(cost, r["bucket"], c) for c in range(g * (g + 1) // 2)]
        heap = [(0.0, p) for p in range(parts)]
        where: dict[int, dict[int, int]] = {}
        for cost, b, c in sorted(work, reverse=True):
            load, p = heapq.heappop(heap)
            where.setdefault(b, {})[c] = p
            heapq.heappush(heap, (load + cost, p))
        return groups, {b: [x[c] for c in range(len(x))] for b, x in where.items()}, parts

    def _sources(self) -> tuple[DataFrame, tuple | None]:
        """Vectors without other copies than the first, or the means to leave these out on the way."""
        if not self.has_copies:
            return self.vectors, None
        if small_or_none(self.copies, BROADCAST_ROWS):
            c = self.copies.collect()  # at most BROADCAST_ROWS rows
            h = np.array([(r["h1"], r["h2"], r["rep"]) for r in c], np.int64)
            return self.vectors, tuple(h[np.lexsort((h[:, 1], h[:, 0]))].T)
        other = self.members().where("id <> rep").select("id")
        return self.vectors.join(other, "id", "left_anti"), None

    def neighbours(self, k: int | None, least: float, spanning: bool = False) -> DataFrame:
        """Rows (id, other, sim) of candidates with a cosine of at least `least`, of one member of each class.

        For every id at least its k best met partners are there (from both sides); all of them if k is None.
        With `spanning`, partners also connect every set of vectors of a cell that
        is connected at `least`, however many there are.
        """
        h, dim = self.hash, self.dim
        source, known = self._sources()
        groups, where, parts = self.cells()
        send = self.vectors.sparkSession.sparkContext.broadcast((groups, where, known))  # the checked buckets and classes

        def place(where: dict[int, list[int]] | None, bucket: int, cell: int) -> int:
            if where is not None:
                return where[bucket][cell]
            mixed = (bucket * 0x9E3779B97F4A7C15 + cell * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
            return (mixed >> 20) % parts

        def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups, where, known = send.value
            for b in batches:
                ids, x = usable(b.column(0), b.column(1), dim)
                if known is not None and len(ids):
                    h1, h2 = fingerprint(x)
                    lo, hi = np.searchsorted(known[0], h1, "left"), np.searchsorted(known[0], h1, "right")
                    drop = np.zeros(len(ids), bool)
                    for r in np.flatnonzero(hi > lo):
                        for c in range(lo[r], hi[r]):
                            drop[r] |= known[1][c] == h2[r] and known[2][c] != ids[r]
                    ids, x = ids[~drop], x[~drop]
                if not len(ids):
                    continue
                p = h.probes(unit(x))
                row = np.repeat(np.arange(len(ids)), p.shape[1])[p.ravel() >= 0]
                p = p[p >= 0]
                order = np.argsort(p, kind="stable")
                buckets, at = np.unique(p[order], return_index=True)
                out: list[tuple] = []
                for bucket, rows in zip(buckets.tolist(), np.split(row[order], at[1:]), strict=True):
                    g = groups.get(bucket, 1)
                    if g == 1:
                        out.append((place(where, bucket, 0), bucket, 0, 0, ids[rows].tobytes(), x[rows].tobytes()))
                        continue
                    mine = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g
                    for own in np.unique(mine):
                        m = rows[mine == own]
                        data = (ids[m].tobytes(), x[m].tobytes())
                        for other in range(g):
                            i, j = min(own, other), max(own, other)
                            c = j * (j + 1) // 2 + i
                            out.append((place(where, bucket, int(c)), bucket, int(c), int(own == j), *data))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "bucket", "cell", "side", "ids", "vecs"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush(sides: dict[int, list]) -> Iterator[pa.RecordBatch]:
                got = []
                for s in sorted(sides):
                    i = np.frombuffer(b"".join(a for a, _ in sides[s]), np.int64)
                    v = np.frombuffer(b"".join(b for _, b in sides[s]), np.float32).reshape(-1, dim)
                    i, first = np.unique(i, return_index=True)  # a vector delivered twice, or met in both probes
                    got.append((i, v[first]))
                if got:
                    for a, b, s in compare(*got[0], *(got[1] if len(got) > 1 else got[0]), same=len(got) == 1, k=k, least=least, spanning=spanning):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["id", "other", "sim"])

            now, sides = None, {}
            for batch in batches:
                for bucket, cell, side, i, v in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    if (bucket, cell) != now:
                        yield from flush(sides)
                        now, sides = (bucket, cell), {}
                    # a cell of a group with itself has one side
                    sides.setdefault(side, []).append((i, v))
            yield from flush(sides)

        shipped = source.mapInArrow(ship, "part int, bucket bigint, cell int, side tinyint, ids binary, vecs binary")
        cells = shipped.repartitionById(parts, "part").sortWithinPartitions("bucket", "cell").select("bucket", "cell", "side", "ids", "vecs")
        return cells.mapInArrow(meet, "id bigint, other bigint, sim double")


def compare(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray, same: bool, k: int | None, least: float, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (id, other, sim) of two sides of a cell, in blocks; both directions. Without k, pairs leave as they are found."""
    ua, ub = unit(a), (unit(b) if not same else None)
    ub = ua if same else ub
    da, db = a.astype(np.float64), (a if same else b).astype(np.float64)
    na = np.sqrt((da * da).sum(axis=1))
    nb = na if same else np.sqrt((db * db).sum(axis=1))
    shift = 0 if same else len(ia)  # nodes of side b
    names = ia if same else np.concatenate([ia, ib])
    pi, pj, ps = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    for s in range(0, len(ua), BLOCK):
        for t in range(s if same else 0, len(ub), BLOCK):
            sim = ua[s : s + BLOCK] @ ub[t : t + BLOCK].T
            i, j = np.nonzero(sim >= least - SLACK) if least > -1 else np.indices(sim.shape).reshape(2, -1)
            if same and s == t:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            if len(i) > 16 * BLOCK and k is not None and not spanning:  # a dense block: nearly equal values at the edge stay for the exact test
                i, j = _block_best(sim, i, j, k + 16)
            i, j = i + s, j + t
            exact = np.empty(len(i))
            for c in range(0, len(i), 65536):
                x, y = i[c : c + 65536], j[c : c + 65536]
                exact[c : c + 65536] = np.einsum("ij,ij->i", da[x], db[y]) / (na[x] * nb[y])
            ok = exact >= least
            pi, pj, ps = np.concatenate([pi, i[ok]]), np.concatenate([pj, j[ok] + shift]), np.concatenate([ps, exact[ok]])
            if k is None and len(pi) > 64 * BLOCK:
                yield _both_ways(pi, pj, ps, names)
                pi, pj, ps = pi[:0], pj[:0], ps[:0]
            elif k is not None and len(pi) > 64 * BLOCK + 8 * k * len(names):
                pi, pj, ps = reduce_pairs(pi, pj, ps, names, k, spanning)
    if k is not None:
        pi, pj, ps = reduce_pairs(pi, pj, ps, names, k, spanning)
    if len(pi):
        yield _both_ways(pi, pj, ps, names)


def _both_ways(i: np.ndarray, j: np.ndarray, s: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([names[i], names[j]]), np.concatenate([names[j], names[i]]), np.concatenate([s, s])


def _block_best(sim: np.ndarray, i: np.ndarray, j: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs not below the m-th best of their row or of their column, less SLACK."""
    cut = []
    for axis in (1, 0):
        size = sim.shape[axis]
        cut.append(np.partition(sim, size - m, axis=axis).take(size - m, axis=axis) - SLACK if size > m else np.full(sim.shape[1 - axis], -2.0))
    v = sim[i, j]
    ok = (v >= cut[0][i]) | (v >= cut[1][j])
    return i[ok], j[ok]


def reduce_pairs(i: np.ndarray, j: np.ndarray, s: np.ndarray, names: np.ndarray, k: int, spanning: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs among the k best of either end and, with `spanning`, those of a spanning forest of best pairs."""
    if not len(i):
        return i, j, s
    keep = np.zeros(len(i), bool)
    both, other, sim = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])
    order = np.lexsort((names[other], -sim, both))
    sorted_ = both[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    keep[order[rank < k] % len(i)] = True
    if spanning and not keep.all():
        keep |= forest(i, j, s, len(names))
    return i[keep], j[keep], s[keep]


def forest(i: np.ndarray, j: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """Mask of a maximum spanning forest of the pairs (Boruvka's rounds; ties by position)."""
    label = np.arange(n)
    taken = np.zeros(len(i), bool)
    order = np.argsort(-s, kind="stable")
    while True:
        a, b = label[i[order]], label[j[order]]
        cross = a != b
        if not cross.any():
            return taken
        order, a, b = order[cross], a[cross], b[cross]
        place = np.full(n, len(order))
        np.minimum.at(place, a, np.arange(len(order)))
        np.minimum.at(place, b, np.arange(len(order)))
        best = np.unique(place[place < len(order)])
        taken[order[best]] = True
        parent = np.arange(n)
        x, y = a[best], b[best]
        while True:  # labels of the joined components, by repeated minima
            low = parent.copy()
            np.minimum.at(low, x, parent[y])
            np.minimum.at(low, y, parent[x])
            low = low[low]
            if (low == parent).all():
                break
            parent = low
        label = parent[label]


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, least: float = 0.85, tables: int | None = None) -> DataFrame:
    """Rows (id, rank, other, sim): for every usable vector its k most similar other vectors, from `least` on.

    Usable: dim finite elements, not all zero, and an id; other rows give nothing.
    Rows of one id are one vector. Equal cosines rank by id; copies under other ids
    have cosine 1. An empty table gives no rows. Vectors with no partner from
    `least` on have no row.
    """
    c = Collection(df, id_col, vec_col, dim, tables)
    met = c.neighbours(k + 1, least)
    best = (
        met.groupBy("id")
        .agg(F.sort_array(F.collect_set(F.struct((-F.col("sim")).alias("s"), "other"))).alias("x"))  # at most (k + 1) x cells of an id
        .select("id", F.slice("x", 1, k + 1).alias("x"))
    )
    if c.has_copies:
        members = materialize(c.members(), "members")
        w = Window.partitionBy("rep").orderBy("id")
        low = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        low = materialize(low, "low")
        flat = best.select("id", F.explode("x").alias("p")).select("id", F.col("p.s").alias("s"), F.col("p.other").alias("other"))
        j = flat.join(F.broadcast(low) if small_or_none(low) else low, flat["other"] == low["rep"], "left")
        wide = j.select("id", "s", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
        own = low.select(F.col("rep").alias("id"), F.lit(-1.0).alias("s"), F.explode("ids").alias("other"))
        every = wide.unionByName(own)
        w = Window.partitionBy("id").orderBy("s", "other")
        lists = every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", "other"))).alias("x"))
        alone = lists.select(F.col("id").alias("rep"), F.col("id"), "x")
        others = members.where("id <> rep").join(lists.select(F.col("id").alias("rep"), "x"), "rep").select("rep", "id", "x")
        best = alone.unionByName(others).select("id", F.filter("x", lambda p: p["other"] != F.col("id")).alias("x"))
    out = best.select("id", F.posexplode(F.slice("x", 1, k)).alias("pos", "p"))
    return out.select("id", (F.col("pos") + 1).alias("rank"), F.col("p.other").alias("other"), (-F.col("p.s")).alias("sim"))


def recall(df: DataFrame, found: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, least: float = 0.85, every: int = 100) -> DataFrame:
    """One row (queries, true_pairs, found_pairs, recall) against brute force for the ids divisible by `every`.

    The query vectors meet all rows in blocks of products; queries come in blocks of
    a bounded number, and each split of the rows keeps the k best per query.
    """
    q = df.where(F.col(id_col) % every == 0).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    spark = df.sparkSession
    n = q.count()
    blocks = max(1, -(-n // 20_000))
    parts = []
    for blk in range(blocks):
        own = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == blk) if blocks > 1 else q
        rows = own.toArrow()  # at most about 20,000 vectors
        qi, qx = usable(rows.column("id").combine_chunks(), rows.column("vec"), dim)
        qi, first = np.unique(qi, return_index=True)
        if not len(qi):
            continue
        qx = qx[first]
        send = spark.sparkContext.broadcast((qi, qx))

        def f(batches: Iterator[pa.RecordBatch], send=send) -> Iterator[pa.RecordBatch]:
            qi, qx = send.value
            uq = unit(qx)
            for b in batches:
                ids, x = usable(b.column(0), b.column(1), dim)
                if not len(ids):
                    continue
                i, j = np.nonzero(uq @ unit(x).T >= least - SLACK)
                ok = qi[i] != ids[j]
                i, j = i[ok], j[ok]
                a, c = qx[i].astype(float), x[j].astype(float)
                s = (a * c).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (c * c).sum(axis=1))
                good = s >= least
                yield pa.RecordBatch.from_arrays([pa.array(qi[i[good]]), pa.array(ids[j[good]]), pa.array(s[good])], names=["id", "other", "sim"])

        parts.append(df.select(F.col(id_col).cast("bigint"), vec_col).mapInArrow(f, "id bigint, other bigint, sim double"))
    empty = spark.createDataFrame([], "id bigint, other bigint, sim double")
    truth = empty
    for p in parts:
        truth = truth.unionAll(p)
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    truth = truth.groupBy("id", "other").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    hit = truth.join(found.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hit.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("true_pairs"), F.count("hit").alias("found_pairs"), (F.count("hit") / F.count("*")).alias("recall"))
