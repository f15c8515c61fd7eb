import itertools

import numpy as np
import pytest

from skein.operators import grouping, prefetch


def naive(sets, least, linkage):
    """Repeatedly merge the closest pair of groups, all distances from the definition."""

    def dist(i, j):
        a, b = sets[i], sets[j]
        return 1 - (len(a & b) / len(a | b) if a and b else 0.0)

    groups = [[i] for i in range(len(sets))]
    how = {"single": min, "complete": max, "average": lambda d: sum(d) / len(d)}[linkage]
    while len(groups) > 1:
        best = min(((round(how([dist(i, j) for i in a for j in b]), 10), min(a + b), sorted([a[0], b[0]]), x, y) for (x, a), (y, b) in itertools.combinations(list(enumerate(groups)), 2)), key=lambda t: (t[0], t[2]))
        if not best[0] < 1 - least - 1e-9:
            break
        a, b = groups[best[3]], groups[best[4]]
        groups = [g for k, g in enumerate(groups) if k not in (best[3], best[4])] + [sorted(a + b)]
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("linkage", grouping.LINKAGES)
def test_agglomeration_equals_the_naive_one(linkage):
    rng = np.random.default_rng(5)
    for _ in range(25):
        sets = [set(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(14)]
        sim = grouping._jaccard_matrix([np.array(sorted(s), int) for s in sets])
        got = grouping.agglomerate(sim, 0.3, linkage)
        assert dict(enumerate(got.tolist())) == naive(sets, 0.3, linkage)


def test_threshold_is_strict_and_empty_sets_stay_alone(spark):
    # similarity of the first two exactly 0.5, of the second two above
    rows = [(1, 1, 1, [1, 2, 3]), (1, 2, 2, [1, 2, 4]), (1, 3, 3, [1, 2, 4, 5]), (1, 4, 4, []), (1, 5, 5, []), (2, 6, 9, [1]), (None, 7, 1, None)]
    df = spark.createDataFrame(rows, "window_id bigint, qid bigint, seq bigint, cluster_ids array<int>")
    got = {r["qid"]: r["group_id"] for r in grouping.group_windows(df, 0.5, "single").collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 9, 7: 1}
    assert grouping.group_windows(df.limit(0), 0.5).collect() == []
    with pytest.raises(ValueError):
        grouping.group_windows(df, 0.5, "ward")


def test_jaccard_pairs_and_cap(spark):
    rows = [(1, 10 - i, i, [i, i + 1]) for i in range(8)]
    df = spark.createDataFrame(rows, "window_id bigint, qid bigint, seq bigint, cluster_ids array<int>")
    capped = grouping.cap_window(df, 3)
    assert sorted(r["seq"] for r in capped.collect()) == [0, 1, 2]
    assert grouping.cap_window(df, None).count() == 8
    pairs = {(r["qid_a"], r["qid_b"]): r["jaccard"] for r in grouping.jaccard_pairs(capped, 0.1).collect()}
    assert pairs == {(9, 10): pytest.approx(1 / 3), (8, 9): pytest.approx(1 / 3)}


def test_schedule_is_a_permutation_and_chunks(spark):
    rows = [(w, 100 * w + i, i, [i % 3, 50]) for w in (1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "window_id bigint, qid bigint, seq bigint, cluster_ids array<int>")
    s = grouping.schedule(grouping.group_windows(df, 0.4, "complete")).collect()
    for w in (1, 2):
        mine = sorted((r["position"], r["group_id"], r["seq"]) for r in s if r["window_id"] == w)
        assert [p for p, _, _ in mine] == list(range(1, 10))
        assert mine == sorted(mine, key=lambda x: (x[1], x[2]))
    c = grouping.chunks(df, 4).where("window_id = 1").orderBy("seq").collect()
    assert [r["chunk"] for r in c] == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r["position"] for r in grouping.pass_through(df).where("window_id = 1").orderBy("seq").collect()] == list(range(1, 10))


def test_prefetch_plans(spark):
    rows = [(1, 11, 1, 1, [1, 2]), (1, 12, 1, 2, [2, 3]), (1, 13, 5, 3, [4]), (1, 14, 5, 4, [5, 4]), (2, 15, 9, 1, [7])]
    s = spark.createDataFrame(rows, "window_id bigint, qid bigint, group_id bigint, position int, cluster_ids array<int>")
    ends = {(r["window_id"], r["group_id"]): r for r in prefetch.group_ends(s, 1).collect()}
    assert ends[1, 1]["first_qid"] == 11 and ends[1, 1]["last_set"] == [2, 3] and ends[1, 5]["last_qids"] == [14]
    plan = {(r["window_id"], r["group_id"]): (r["trigger_qid"], r["next_group_id"], r["targets"]) for r in prefetch.plan_first(prefetch.group_ends(s)).collect()}
    assert plan == {(1, 1): (12, 5, [4]), (1, 5): (14, None, None), (2, 9): (15, None, None)}
    bal = prefetch.plan_balanced(s, prefetch.group_ends(s), 1).collect()
    assert [(r["trigger_qid"], r["cluster_id"], r["n"]) for r in bal] == [(12, 4, 2)]
    top = prefetch.window_top(s.withColumnRenamed("position", "seq"), 1).orderBy("window_id").collect()
    assert [(r["window_id"], r["cluster_id"]) for r in top] == [(1, 2), (2, 7)]


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (50, 4)), rng.normal(5, 0.1, (50, 4))])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(100)], "qid bigint, qvec array<double>")
    g = {r["qid"]: r["group_id"] for r in grouping.kmeans_groups(df, 2, 4, 10).collect()}
    assert len(g) == 100 and set(g.values()) <= {0, 1}
    assert grouping.kmeans_groups(df.limit(0), 2, 4).collect() == []


def test_whole_windows(spark, tmp_path, monkeypatch):
    """Every query of a window larger than the cap is grouped and planned, by blocks as by one matrix."""
    from skein.plans import workload

    rng = np.random.default_rng(4)
    rows = []
    for q in range(330):
        ids = sorted(int(c) for c in rng.choice(400, int(rng.integers(0, 9)), replace=False)) if q % 3 else [q % 60, q % 60 + 1, q % 7 + 500]
        rows.append((q, None if q < 20 else 1 if q < 310 else 2, q * 3 % 331, "t", None, ids))
    df = spark.createDataFrame(rows, "qid bigint, window_id bigint, seq bigint, topic string, ts timestamp, cluster_ids_set array<int>")
    df.coalesce(1).write.parquet(str(tmp_path / "all_results.parquet"))
    want = {}
    for win in (None, 1, 2):
        own = sorted((r for r in rows if r[1] == win), key=lambda r: r[2])
        label = grouping.agglomerate(grouping._jaccard_matrix([np.array(r[5], np.int64) for r in own]), workload.LEAST, "single")
        want |= {r[0]: (win, own[g][2]) for r, g in zip(own, label, strict=True)}
    for block in (16, 1024):
        monkeypatch.setattr(grouping, "BLOCK", block)
        s = workload._scheduled_whole(spark, str(tmp_path)).collect()
        assert {r["qid"]: (r["window_id"], r["group_id"]) for r in s} == want and len(s) == 330
    assert 3 < len(set(want.values())) < 330
    plan = workload.prefetch_plan_first_whole(spark, str(tmp_path)).collect()
    assert {(r["window_id"], r["group_id"]) for r in plan} == set(want.values())
    assert workload.schedule_arrival_whole(spark, str(tmp_path)).count() == 330
    freq = workload.cluster_frequency_whole(spark, str(tmp_path)).toPandas()
    assert freq["n"].sum() == sum(len(r[5]) for r in rows)


def test_minibatch_follows_the_ticks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4)).round(2)
    tick = [None if i % 10 == 0 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, tick[i], [float(v) for v in x[i]]) for i in range(90)], "qid bigint, tick int, qvec array<float>").repartition(3)
    x = x.astype(np.float32).astype(float)
    c, seen, want = None, np.zeros(3), {}
    for t in (None, 0, 1, 2):
        own = [i for i in range(90) if tick[i] == t]
        c = x[own[:3]].copy() if c is None else c
        at = np.array([((c - x[i]) ** 2).sum(1).argmin() for i in own])
        for g in range(3):
            for i in np.array(own)[at == g]:  # one vector at a time
                seen[g] += 1
                c[g] += (x[i] - c[g]) / seen[g]
        want |= {i: int(((c - x[i]) ** 2).sum(1).argmin()) for i in own}
    assert {r["qid"]: r["group_id"] for r in grouping.minibatch_groups(df, "tick", 3, 4).collect()} == want
    assert grouping.minibatch_groups(df.limit(0), "tick", 3, 4).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_sparse_complete_linkage_equals_the_dense_one(seed):
    rng = np.random.default_rng(seed)
    sim = rng.integers(0, 8, (25, 25)) / 8  # many ties
    sim = np.triu(sim, 1) + np.triu(sim, 1).T + np.eye(25)
    a, b = np.nonzero(np.triu(1 - sim < 1 - 0.3 - 1e-12, 1))
    got = grouping.sparse_complete(a, b, (1 - sim)[a, b])
    assert [got.get(i, i) for i in range(25)] == grouping.agglomerate(sim.copy(), 0.3, "complete").tolist()


def test_whole_windows_by_complete_linkage(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for q in range(240):
        base = [list(range(10)), list(range(8, 20)), list(range(15, 30))][q % 3]
        keep = sorted(int(c) for c in rng.choice(base, int(rng.integers(0, len(base))), replace=False))
        rows.append((q, None if q < 15 else 1, q * 7 % 241, keep if q % 11 else None))
    df = grouping_table(spark, rows)
    want = {(r["qid"], r["group_id"]) for r in grouping.group_windows(df, 0.3, "complete").collect()}
    for block in (16, 1024):
        monkeypatch.setattr(grouping, "BLOCK", block)
        got = grouping.group_whole_windows(df, 0.3, "complete").collect()
        assert {(r["qid"], r["group_id"]) for r in got} == want and len(got) == 240
    assert 10 < len({g for _, g in want}) < 200
    assert grouping.group_whole_windows(df.limit(0), 0.3, "complete").collect() == []
    with pytest.raises(ValueError):
        grouping.group_whole_windows(df, 0.3, "average")


def grouping_table(spark, rows):
    from skein.runtime import materialize

    return materialize(spark.createDataFrame(rows, "qid bigint, window_id bigint, seq bigint, cluster_ids array<int>"), "windowed")
