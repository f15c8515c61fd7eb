import random

import pytest

from skein.operators import cache, metrics
from skein.streaming import windows

COSTS = {i: (float(i % 5 + 1), float(i % 7)) for i in range(30)}


def simulate(rows, capacity, policy, prefetch):
    """Independent simulator on plain lists. rows: (window, position, qid, group, ids) in order."""
    entries, wcount, out = [], {}, []  # entries: [id, count] from the least to the most recent

    def weight(e):
        w = COSTS.get(e[0], (float("inf"), 0))[0] * e[1]
        return w * (1 + wcount.get(e[0], 0)) if policy == "window_top" else w

    def evict(n):
        gone = []
        for _ in range(n):
            if not entries:
                break
            e = entries[0] if policy in ("lru", "fifo") else min(entries, key=weight)
            entries.remove(e)
            gone.append(e[0])
        return gone

    def load(ids):
        new = sorted([c for c in ids if all(e[0] != c for e in entries)], key=lambda c: -COSTS.get(c, (0, 0.0))[1])
        gone = evict(max(0, len(entries) + len(new) - capacity))
        for c in new:
            if capacity == 0:
                continue
            if len(entries) >= capacity:
                gone += evict(1)
            entries.append([c, 1])
            if policy == "window_top":
                wcount[c] = 1
        return gone

    for k, (window, position, qid, group, ids) in enumerate(rows):
        if k and rows[k - 1][0] != window and policy == "window_top" and wcount:
            order = list(wcount)
            stay = sorted(wcount, key=lambda c: (-wcount[c], order.index(c)))[:10]
            entries[:] = [e for e in entries if e[0] in stay]
            wcount = {}
        hits, misses = [], []
        for c in ids:
            e = next((e for e in entries if e[0] == c), None)
            if e is None:
                misses.append(c)
                continue
            hits.append(c)
            e[1] += 1
            if policy != "fifo":
                entries.remove(e)
                entries.append(e)
            if policy == "window_top":
                wcount[c] = wcount.get(c, 0) + 1
        gone = load(misses) if misses else []
        fetched = []
        nxt = [r for r in rows[k + 1 :] if r[0] == window]
        if prefetch != "none" and nxt and nxt[0][3] != group:
            g = [r for r in nxt if r[3] == nxt[0][3]]
            have = {e[0] for e in entries}
            if prefetch == "first":
                fetched = [c for c in g[0][4] if c not in have]
            else:
                n = {}
                for r in g:
                    for c in r[4]:
                        if c not in have:
                            n[c] = n.get(c, 0) + 1
                fetched = sorted(n, key=lambda c: -n[c])
                if capacity > len(entries):
                    fetched = fetched[: capacity - len(entries)]
            gone += load(fetched)
        out.append((window, position, qid, hits, misses, gone, fetched))
        assert len(entries) <= capacity
    return out


def trace_rows(seed, n=120):
    rng = random.Random(seed)
    rows, position = [], {}
    window, group = 1, 1
    for q in range(n):
        if rng.random() < 0.05:
            window, group = window + 1, 1
        elif rng.random() < 0.4:
            group += 1
        position[window] = position.get(window, 0) + 1
        rows.append((window, position[window], q, group, rng.sample(range(32), rng.randint(0, 6))))
    return rows


@pytest.mark.parametrize("policy", cache.POLICIES)
@pytest.mark.parametrize("prefetch", ["none", "first", "balance"])
def test_trace_equals_the_simulator(spark, policy, prefetch):
    costs = spark.createDataFrame([(k, *v) for k, v in COSTS.items()] + [(99, None, None)], "cluster_id int, latency_sec double, size_mb double")
    keyed = {("a", cap): trace_rows(cap) for cap in (0, 3, 8)}
    for (key, cap), rows in keyed.items():
        both = [(k, *r) for k in (key, None) for r in (rows if k else rows[:40])]
        df = spark.createDataFrame(both, "topic string, window_id bigint, position int, qid bigint, group_id bigint, cluster_ids array<int>").repartition(3)
        got = cache.trace(df, costs, cap, policy, prefetch, ["topic"]).collect()
        for k, want_rows in ((key, rows), (None, rows[:40])):
            mine = sorted((tuple(r[c] for c in ("window_id", "position", "qid", "hits", "misses", "evicted", "prefetched")) for r in got if r["topic"] == k), key=lambda r: r[:2])
            want = sorted(simulate(want_rows, cap, policy, prefetch), key=lambda r: r[:2])
            for m, w in zip(mine, want, strict=True):
                assert m[:5] == w[:5] and sorted(m[5]) == sorted(w[5]) and m[6] == w[6]
        for r in got:
            asked = len(r["hits"]) + len(r["misses"])
            assert r["n_miss"] == len(r["misses"]) and r["hit_ratio"] == (len(r["hits"]) / asked if asked else None)


def test_empty_null_and_totals(spark):
    costs = spark.createDataFrame([], "cluster_id int, latency_sec double, size_mb double")
    df = spark.createDataFrame([(1, 1, 5, 1, None), (1, 2, 6, 1, [3]), (1, 3, 7, 1, [3])], "window_id bigint, position int, qid bigint, group_id bigint, cluster_ids array<int>")
    rows = cache.trace(df, costs, 2, "lru").orderBy("position").collect()
    assert [(r["hits"], r["misses"], r["load_mb"]) for r in rows] == [([], [], 0.0), ([], [3], 0.0), ([3], [], 0.0)]
    assert cache.totals(cache.trace(df, costs, 2, "lru")).first()["hit_ratio"] == 0.5
    assert cache.trace(df.limit(0), costs, 2, "lru").collect() == []
    with pytest.raises(ValueError):
        cache.trace(df, costs, 2, "lru", "all")
    with pytest.raises(ValueError):
        cache.Cache(2, "random", {}, {})


def test_run_log(spark):
    rows = [("a", w, p, 10 * w + p, [1], [2] * p, [], [9] if p == 2 else [], p, None if p == 3 else 1 / (1 + p), 1.75) for w in range(2) for p in range(1, 4)]
    schema = "topic string, window_no bigint, position int, qid bigint, hits array<int>, misses array<int>, evicted array<int>, prefetched array<int>, n_miss int, hit_ratio double, load_mb double"
    t = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in metrics.run_log(t, ["topic"], warm=2).orderBy("seq").collect()]
    assert got == [("a", 1, 0, 3, 3, None, 3, 1, False), ("a", 2, 1, 11, 1, "50.000%", 3, 1, False), ("a", 3, 1, 12, 2, "33.333%", 3, 1, True), ("a", 4, 1, 13, 3, None, 3, 1, False)]
    assert metrics.run_log(t.limit(0), ["topic"]).collect() == []


def test_window_numbers_do_not_depend_on_spans(spark, monkeypatch):
    q = spark.createDataFrame([(i, (i * 37) % 101 if i % 10 else None, "a" if i % 3 else None) for i in range(100)], "qid bigint, seq bigint, topic string")
    want = sorted(tuple(r) for r in windows.count_windows(q, 7, ["topic"]).select("qid", "window_no").collect())
    monkeypatch.setattr(windows, "SPAN", 10)
    assert sorted(tuple(r) for r in windows.count_windows(q, 7, ["topic"]).select("qid", "window_no").collect()) == want
    assert windows.count_windows(q, 7, ["topic"]).groupBy("topic", "window_no").count().where("count > 7").count() == 0


def test_pipelined_prefetch_submits_once(spark):
    """Blocks 1 and 2 alternate in a cache of one: prefetched once each, then never again; look-ups count as uses."""
    rows = [(1, p, p, p, [1 + p % 2]) for p in range(8)]
    s = spark.createDataFrame(rows, "window_id int, position int, qid bigint, group_id bigint, cluster_ids array<int>")
    costs = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], "cluster_id int, latency_sec double, size_mb double")
    got = {}
    for pipelined in (False, True):
        t = cache.trace(s, costs, 1, "lru", "first", pipelined=pipelined).orderBy("position").collect()
        got[pipelined] = [r["prefetched"] for r in t]
    assert got[False] == [[2], [1]] * 3 + [[2], []]
    assert got[True] == [[2], [1]] + [[]] * 6
    t = cache.trace(s, costs, 2, "cost_freq", "balance", pipelined=True).orderBy("position").collect()
    assert [r["n_miss"] for r in t] == [1] + [0] * 7 and [r["prefetched"] for r in t] == [[2]] + [[]] * 7
