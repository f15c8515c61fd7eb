"""Filling fixed-capacity containers with items (problem 8), neighbours together.

Every text gets its size in tokens and a place on a Hilbert curve: its tokens are
hashed into a vector, the vector projected to a few dimensions and the point's
Hilbert key taken. The items are range-partitioned and sorted by that key, and
each partition packs its stretch of the curve window by window: within a window
the largest items go first, each into the fullest open container that takes it.
Like texts thus share containers, while a window is long enough that little
space stays unused. What a window leaves open goes on to the next one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.tokens import DEFAULT, vocabulary
from skein.runtime import materialize

CAPACITY = 2048
#: Hash buckets of the document vectors, dimensions and bits of the Hilbert curve.
BUCKETS, DIMS, BITS = 512, 4, 12
#: Items packed together along the curve, and full containers a partition is cut for. Over the reviews of sf0.1 windows of 100 to 3,000
#: items give the same used share (0.9997); a container's items span about a window, so it is short.
WINDOW, PER_PARTITION = 128, 2000
#: Open containers that a partition carries from window to window.
OPEN = 8


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (n, d) with 0 <= coordinate < 2**bits; d * bits <= 62."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the coarser levels
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((BUCKETS, DIMS))


def curve_keys(ids: list[list[int]]) -> np.ndarray:
    """Hilbert keys of token lists: hashed square-root counts, projected, spread evenly over the cube."""
    h = np.zeros((len(ids), BUCKETS))
    for r, x in enumerate(ids):
        a = (np.asarray(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS
        h[r] = np.sqrt(np.bincount(a, minlength=BUCKETS))
    h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
    z = h @ _projection()
    u = 1 / (1 + np.exp(-1.702 * z))  # near the normal distribution function
    return hilbert(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT) -> DataFrame:
    """Rows (id_col, n_tokens, key) of the texts that aren't null or empty."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                ids = [v.encode(t) for t in b.column(1).slice(k, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1000), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids), pa.int64())], names=[id_col, "n_tokens", "key"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).where(F.length(text_col) > 0).mapInArrow(f, f"`{id_col}` {kind}, n_tokens bigint, key bigint")


class Packer:
    """Best fit into open containers; ids count up from `first`."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: list[tuple[int, int]] = []  # (space left, container), ascending

    def put(self, size: int) -> int:
        at = bisect.bisect_left(self.open, (size, -1))
        if at < len(self.open):
            left, c = self.open.pop(at)
        else:
            left, c = self.capacity, self.next
            self.next += 1
        if left > size:
            bisect.insort(self.open, (left - size, c))
        return c

    def close(self, keep: int) -> None:
        """Keep the `keep` emptiest containers open."""
        self.open = self.open[max(0, len(self.open) - keep) :]


def pack(items: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Rows (container_id, id_col, piece, start, n_tokens).

    items: (id_col, n_tokens, key). An item over the capacity fills containers of
    its own with pieces of exactly `capacity` tokens; its rest is an item like
    others, with piece numbers and `start` (its first token) going on. Items of no
    tokens take no container. Repeated ids are separate items. The capacity is
    never exceeded.
    """
    kind = dict(items.dtypes)[id_col]
    items = materialize(items.where("n_tokens > 0"), "sized")
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, round(total / capacity / PER_PARTITION))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        held: list[tuple] = []

        def window(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for i, n in rows:
                whole = n // capacity
                for p in range(whole):
                    out.append((packer.next, i, p, p * capacity, capacity))
                    packer.next += 1
            rest = sorted(((n % capacity, r) for r, (_, n) in enumerate(rows) if n % capacity), key=lambda x: (-x[0], x[1]))
            for n, r in rest:
                whole = rows[r][1] // capacity
                out.append((packer.put(n), rows[r][0], whole, whole * capacity, n))
            packer.close(OPEN)
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], idtype), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())], names=["container_id", id_col, "piece", "start", "n_tokens"])

        idtype = None
        for b in batches:
            idtype = b.column(0).type
            held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            while len(held) >= WINDOW:
                yield window(held[:WINDOW])
                held = held[WINDOW:]
        if held:
            yield window(held)

    placed = items.repartitionByRange(parts, "key", id_col).sortWithinPartitions("key", id_col, "n_tokens")
    return placed.select(id_col, "n_tokens").mapInArrow(f, f"container_id bigint, `{id_col}` {kind}, piece int, start bigint, n_tokens int")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, least and mean used share."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("most_used"), (F.sum("used") / (F.count("*") * capacity)).alias("used_share"))
