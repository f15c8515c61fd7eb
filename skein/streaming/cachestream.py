"""The cache as a stateful stream operator: one state per key, kept between batches.

A key's state is its cache's ids, counts and window counts in order; the batch's rows of
a key are folded in order of seq. A row that comes in a later batch than one of a larger seq is folded when it
comes, as the cache of a running service would: put a watermark and a sort before, where order across batches matters. The state has one entry per cached or counted block and
never a vector. For window_top a window ends by event time: when a row comes `window_sec`
or more after the window's first row.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.cache import Cache

SCHEMA = "key string, qid bigint, seq bigint, n_hit int, n_miss int, n_evicted int"


def stream_trace(stream: DataFrame, latency: dict[int, float], size_mb: dict[int, float], capacity: int, policy: str, key_col: str, window_sec: float = 60.0) -> DataFrame:
    """Rows (key, qid, seq, n_hit, n_miss, n_evicted); stream: key_col, qid, seq, ts, cluster_ids. A null key is ''."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = Cache(capacity, policy, latency, size_mb)
        began = None
        if state.exists:
            kept = json.loads(state.get[0])
            cache.count = OrderedDict((int(k), v) for k, v in kept["count"])
            cache.window = {int(k): v for k, v in kept["window"]}
            began = kept["began"]
        rows = pd.concat(list(frames)).sort_values(["seq", "qid"])
        out = []
        for qid, seq, ts, ids in zip(rows["qid"], rows["seq"], rows["ts"], rows["cluster_ids"], strict=True):
            gone = []
            if pd.notna(ts):
                now = pd.Timestamp(ts).timestamp()
                if began is not None and now - began >= window_sec:
                    gone = cache.expire()
                    began = now
                began = now if began is None else began
            hits, misses, left = cache.query([] if ids is None else [int(c) for c in ids])
            out.append((key[0], qid, seq, len(hits), len(misses), len(left) + len(gone)))
        state.update((json.dumps({"count": list(cache.count.items()), "window": list(cache.window.items()), "began": began}),))
        yield pd.DataFrame(out, columns=["key", "qid", "seq", "n_hit", "n_miss", "n_evicted"])

    keyed = stream.select(F.coalesce(F.col(key_col), F.lit("")).alias("key"), "qid", "seq", F.col("ts").cast("timestamp").alias("ts"), "cluster_ids")
    return keyed.groupBy("key").applyInPandasWithState(fold, SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)
