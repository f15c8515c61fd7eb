"""The bounded cache of blocks as a fold over the schedule: hits, misses, evictions, prefetches.

An accounting model: it holds ids, never vectors, and never changes what a search
returns. One trace is serial by nature, so traces run side by side, one for each key;
a task reads its keys' rows as a sorted stream and holds the state of one cache.

For each query, at once: all gets in probe order; then, if blocks are missing, as many
victims as needed leave; then the missing blocks enter, largest first. With more missing
blocks than capacity, entering blocks push others out; capacity 0 caches nothing.

Policies (victim first):
- cost_freq: smallest latency x count, ties by recency; unknown latency is infinite.
- lru: least recently used. The scripts call this one FIFO.
- fifo: first in, first out; hits change nothing.
- window_top: smallest latency x count x (1 + accesses in the window); when a window
  ends, only its `top` most used blocks stay and the counts start anew.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("cost_freq", "lru", "fifo", "window_top")
TRACE = "hits array<int>, misses array<int>, evicted array<int>, prefetched array<int>, n_miss int, hit_ratio double, load_mb double"


class Cache:
    """State of one cache."""

    def __init__(self, capacity: int, policy: str, latency: dict[int, float], size_mb: dict[int, float], top: int = 10) -> None:
        if policy not in POLICIES:
            raise ValueError(f"policy is one of {POLICIES}")
        self.capacity, self.policy, self.top = max(0, capacity), policy, top
        self.latency, self.size_mb = latency, size_mb
        self.count: OrderedDict[int, int] = OrderedDict()  # by recency, or by entry for fifo
        self.window: dict[int, int] = {}

    def _leave(self, n: int) -> list[int]:
        n = min(max(0, n), len(self.count))
        if not n:
            return []
        order = list(self.count)
        if self.policy in ("cost_freq", "window_top"):
            latency, inf = self.latency.get, float("inf")
            weight = [latency(c, inf) * k for c, k in self.count.items()]
            if self.policy == "window_top":
                used = self.window.get
                weight = [w * (1 + used(c, 0)) for w, c in zip(weight, order, strict=True)]
            order = [order[i] for i in sorted(range(len(order)), key=weight.__getitem__)]  # stable: the least recent of equals first
        for c in order[:n]:
            del self.count[c]
        return order[:n]

    def get(self, c: int) -> bool:
        if c not in self.count:
            return False
        self.count[c] += 1
        if self.policy != "fifo":
            self.count.move_to_end(c)
        if self.policy == "window_top":
            self.window[c] = self.window.get(c, 0) + 1
        return True

    def load(self, ids: list[int]) -> list[int]:
        """Bring in ids, largest first; returns what left."""
        new = sorted((c for c in ids if c not in self.count), key=lambda c: -self.size_mb.get(c, 0.0))
        gone = self._leave(len(self.count) + len(new) - self.capacity)
        for c in new:
            if not self.capacity:
                break
            if len(self.count) >= self.capacity:
                gone += self._leave(1)
            self.count[c] = 1
            if self.policy == "window_top":
                self.window[c] = 1
        return gone

    def query(self, ids: list[int]) -> tuple[list[int], list[int], list[int]]:
        hits, misses = [], []
        for c in ids:
            (hits if self.get(c) else misses).append(c)
        return hits, misses, self.load(misses) if misses else []

    def expire(self) -> list[int]:
        """End of a window; returns what left. A window without accesses keeps the cache."""
        if self.policy != "window_top" or not self.window:
            return []
        order = {c: i for i, c in enumerate(self.window)}
        stay = sorted(self.window, key=lambda c: (-self.window[c], order[c]))[: self.top]
        gone = [c for c in self.count if c not in set(stay)]
        for c in gone:
            del self.count[c]
        self.window = {}
        return gone


def trace(scheduled: DataFrame, costs: DataFrame, capacity: int, policy: str, prefetch: str = "none", keys: list[str] | None = None, window_col: str = "window_id", top: int = 10, pipelined: bool = False) -> DataFrame:
    """The cache's trace: rows keys + (window, position, qid, hits, misses, evicted, prefetched, n_miss, hit_ratio, load_mb).

    scheduled: keys + (window, position, qid, group_id, cluster_ids); every combination of
    `keys` has a cache of its own. costs: (cluster_id, latency_sec, size_mb) of the index's
    fixed list of blocks. prefetch "first" loads, after a group's last query, the set of the
    next group's first query (of the same window); "balance" the blocks that the next group
    uses most (ties: met first), as many as fit beside what is cached, or all if nothing fits. What is
    cached isn't fetched again, and prefetched blocks are there before the next query. `pipelined` counts as a background
    prefetcher does: what was once submitted is never submitted again, even if it has left, a query first looks up the
    submitted ones of its blocks, and "balance" looks up every block it counts; these look-ups are uses like others.
    Null or empty sets have no hits and a null hit_ratio.
    """
    keys = keys or []
    if prefetch not in ("none", "first", "balance"):
        raise ValueError("prefetch is none, first or balance")
    rows = costs.select("cluster_id", "latency_sec", "size_mb").limit(1_000_001).collect()  # one row a block of the index
    if len(rows) > 1_000_000:
        raise ValueError("more than a million blocks")
    latency = {r["cluster_id"]: r["latency_sec"] for r in rows if r["latency_sec"] is not None}
    size = {r["cluster_id"]: r["size_mb"] for r in rows if r["size_mb"] is not None}
    send = scheduled.sparkSession.sparkContext.broadcast((latency, size))
    cols = [*keys, window_col, "position", "qid", "group_id", "cluster_ids"]
    types = dict(scheduled.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"`{window_col}` {types[window_col]}", "position int", "qid bigint", TRACE])
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latency, size = send.value
        key, window, cache = object(), object(), None
        group: list[tuple] = []  # the group being read
        waiting: tuple | None = None  # the last row of the group before, until what it prefetches is known
        out: list[tuple] = []
        submitted: set[int] = set()

        def there(c: int) -> bool:
            return cache.get(c) if pipelined and prefetch == "balance" else c in cache.count

        def run(rows: list[tuple], follows: bool) -> None:
            """Run a whole group; `follows`: it comes after `waiting` in the same window."""
            nonlocal waiting
            if waiting is not None:
                fetched, gone = [], []
                if follows and prefetch != "none":
                    if prefetch == "first":
                        fetched = [c for c in rows[0][-1] or [] if not there(c) and c not in submitted]
                    else:
                        freq: dict[int, int] = {}
                        for r in rows:
                            for c in r[-1] or []:
                                if not there(c) and c not in submitted:
                                    freq[c] = freq.get(c, 0) + 1
                        order = sorted(freq, key=lambda c: -freq[c])
                        free = cache.capacity - len(cache.count)
                        fetched = order[:free] if free > 0 else order
                    gone = cache.load(fetched)
                    if pipelined:
                        submitted.update(fetched)
                head, hits, misses, left = waiting
                done(head, hits, misses, left + gone, fetched)
                waiting = None
            for i, r in enumerate(rows):
                for c in submitted.intersection(r[-1] or []):
                    cache.get(c)
                hits, misses, left = cache.query(list(r[-1] or []))
                if i == len(rows) - 1:
                    waiting = (r[:-2], hits, misses, left)
                else:
                    done(r[:-2], hits, misses, left, [])

        def done(head: tuple, hits: list, misses: list, left: list, fetched: list) -> None:
            asked = len(hits) + len(misses)
            mb = sum(size.get(c, 0.0) for c in misses) + sum(size.get(c, 0.0) for c in fetched)
            out.append((*head, hits, misses, left, fetched, len(misses), len(hits) / asked if asked else None, mb))

        def close() -> None:
            nonlocal waiting
            if waiting is not None:
                head, hits, misses, left = waiting
                done(head, hits, misses, left, [])
                waiting = None

        last = object()
        fresh = True
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                k, w, g = r[:n], r[n], r[n + 3]
                if group and (k, w, g) != last:
                    run(group, not fresh)
                    fresh = False
                    group = []
                if k != key or cache is None:
                    close()
                    key, window, fresh = k, w, True
                    cache = Cache(capacity, policy, latency, size, top)
                    submitted.clear()
                elif w != window:
                    close()
                    window, fresh = w, True
                    cache.expire()
                group.append(r)
                last = (k, w, g)
                if len(out) >= 5000:
                    yield batch(out)
                    out.clear()
        if group:
            run(group, not fresh)
        close()
        if out:
            yield batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    rows = scheduled.select(*[F.col(c) for c in cols])
    parted = rows.repartition(*[F.col(k) for k in keys]) if keys else rows.repartition(1)
    return parted.sortWithinPartitions(*keys, window_col, "position").mapInArrow(fold, schema)


def totals(trace_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys + (queries, requests, hits, evictions, prefetches, load_mb, hit_ratio); the ratio of no requests is 0."""
    agg = [F.count("*").alias("queries"), F.sum(F.size("hits") + F.size("misses")).alias("requests"), F.sum(F.size("hits")).alias("hits"), F.sum(F.size("evicted")).alias("evictions"), F.sum(F.size("prefetched")).alias("prefetches"), F.round(F.sum("load_mb"), 4).alias("load_mb")]
    t = trace_rows.groupBy(*(keys or [])).agg(*agg)
    return t.withColumn("hit_ratio", F.round(F.coalesce(F.col("hits") / F.nullif(F.col("requests"), F.lit(0)), F.lit(0.0)), 6))
