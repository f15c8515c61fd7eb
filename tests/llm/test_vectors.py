import os
import numpy as np
import pytest

from skein.llm import clusters, vectors

DIM = 16


def table(spark, rows):
    # names that also occur inside the operators
    return spark.createDataFrame([(i, v, k, -1) for k, (i, v) in enumerate(rows)], "id bigint, vec array<float>, sim int, other int").repartition(5)


def sample(seed=0, groups=12, alone=150):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for _ in range(groups):
        c = rng.normal(size=DIM)
        for _ in range(rng.integers(2, 9)):
            rows.append((n, (c / np.linalg.norm(c) + rng.normal(0, 0.04, DIM)) * rng.uniform(0.1, 9)))
            n += 1
    for _ in range(alone):
        rows.append((n, rng.normal(size=DIM)))
        n += 1
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    for k in range(6):  # exact copies under other ids, among them copies of one vector of no group
        rows.append((n, rows[(k // 2) * 3][1]))
        n += 1
    rows.append((n, rows[-10][1]))
    rows += [(0, rows[0][1]), (None, rows[1][1]), (9000, None), (9001, []), (9002, [0.0] * DIM), (9003, [float("nan")] + [1.0] * (DIM - 1)), (9004, [1.0] * (DIM - 1)), (9005, [None] + [1.0] * (DIM - 1)), (9006, [float("inf")] + [1.0] * (DIM - 1))]
    return rows


def cosines(rows):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == DIM and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    for a in range(len(ids)):  # copies are exactly 1
        for b in range(len(ids)):
            if (good[ids[a]] == good[ids[b]]).all():
                s[a, b] = 1.0
    return ids, s


def truth_nearest(rows, k, least):
    ids, s = cosines(rows)
    out = {}
    for a in range(len(ids)):
        near = sorted((-round(s[a, b], 12), ids[b]) for b in range(len(ids)) if b != a and s[a, b] >= least)
        out[ids[a]] = [i for _, i in near[:k]]
    return out


def test_nearest_against_brute_force(spark):
    rows = sample()
    got = {}
    for r in vectors.nearest(table(spark, rows), "id", "vec", DIM, 4, 0.85, tables=8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    want = {i: v for i, v in truth_nearest(rows, 4, 0.85).items() if v}
    assert set(got) == set(want)
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == want


def test_recall_of_production_parameters(spark):
    rows = sample(3, 60, 600)
    df = table(spark, rows)
    near = vectors.nearest(df, "id", "vec", DIM, 10, 0.85).persist()
    r = vectors.recall(df, near, "id", "vec", DIM, 10, 0.85, every=3).first()
    assert r["queries"] > 50 and r["recall"] >= 0.9


def test_oversized_buckets_are_joined_in_cells(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c = rng.normal(size=DIM)
    rows = [(i, [float(x) for x in c + rng.normal(0, 0.01, DIM)]) for i in range(300)] + [(1000 + i, [float(x) for x in rng.normal(size=DIM)]) for i in range(300)]
    monkeypatch.setattr(vectors, "TARGET", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    col = vectors.Collection(table(spark, rows), "id", "vec", DIM)
    groups, where, parts = col.cells()
    assert max(groups.values()) >= 3 and all(len(where[b]) == g * (g + 1) // 2 for b, g in groups.items())
    got = {}
    for r in vectors.nearest(table(spark, rows), "id", "vec", DIM, 5, 0.9).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["other"]
    want = truth_nearest(rows, 5, 0.9)
    hits = sum(len(set(got.get(i, {}).values()) & set(want[i])) for i in range(300))
    assert hits >= 0.9 * 5 * 300 and all(len(got[i]) == 5 for i in range(300))
    g = clusters.vector_groups(table(spark, rows), "id", "vec", DIM, 0.9).where("id < 1000").collect()
    assert {r["group_id"] for r in g} == {0} and len(g) == 300


def test_many_copies(spark):
    v, w = [1.0] + [0.0] * (DIM - 1), [0.0] * (DIM - 1) + [2.0]
    rows = [(i, v) for i in range(100, 160)] + [(5, w)] + [(6, w)]
    got = {}
    for r in vectors.nearest(table(spark, rows), "id", "vec", DIM, 3, 0.5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["sim"]))
    assert sorted(got[100]) == [(1, 101, 1.0), (2, 102, 1.0), (3, 103, 1.0)] and sorted(got[101])[0] == (1, 100, 1.0)
    assert got[5] == [(1, 6, 1.0)] and len(got) == 62
    g = {r["id"]: r["group_id"] for r in clusters.vector_groups(table(spark, rows), "id", "vec", DIM, 0.9).collect()}
    assert set(g.values()) == {100, 5} and len(g) == 62


def test_empty_tables(spark):
    none = table(spark, [(1, None)]).where("id > 5")
    assert vectors.nearest(none, "id", "vec", DIM).collect() == []
    assert clusters.vector_groups(none, "id", "vec", DIM, 0.9).collect() == []
    assert clusters.vector_groups(table(spark, [(1, [1.0] * DIM)]), "id", "vec", DIM, 0.9).collect() == []


def components(ids, s, least):
    lab = list(range(len(ids)))
    for _ in ids:
        for a in range(len(ids)):
            lab[a] = min(lab[b] for b in range(len(ids)) if b == a or s[a, b] >= least)
    return {ids[a]: ids[lab[a]] for a in range(len(ids)) if sum(x == lab[a] for x in lab) > 1}


def test_groups_are_the_linked_ones(spark, monkeypatch):
    rows = sample(7)
    df = table(spark, rows)
    ids, s = cosines(rows)
    want = components(ids, s, 0.9)
    monkeypatch.setattr(vectors, "TABLES", 6)
    assert {r["id"]: r["group_id"] for r in clusters.vector_groups(df, "id", "vec", DIM, 0.9).collect()} == want
    # the same rounds over the cluster, for components too large for a task
    assert {r["id"]: r["group_id"] for r in clusters.vector_groups(df, "id", "vec", DIM, 0.9, local=2).collect()} == want
    d = {r["group_id"]: r for r in clusters.describe(df, clusters.vector_groups(df, "id", "vec", DIM, 0.9).persist(), "id", "vec", DIM).collect()}
    assert {g: r["size"] for g, r in d.items()} == {g: list(want.values()).count(g) for g in set(want.values())}
    assert all(want[t] == g for g, r in d.items() for t in r["typical"])


def test_groups_with_the_production_number_of_tables(spark):
    rows = sample(7)
    ids, s = cosines(rows)
    want = components(ids, s, 0.9)
    got = {r["id"]: r["group_id"] for r in clusters.vector_groups(table(spark, rows), "id", "vec", DIM, 0.9).collect()}
    assert set(got) <= set(want) and all(want[g] == want[v] for v, g in got.items())
    assert sum(got.get(v) == g for v, g in want.items()) >= 0.9 * len(want)


def naive_average(links, least):
    """Merge the best pair of clusters again and again; missing links count 0."""
    parts = [[v] for v in sorted({x for a, b, _ in links for x in (a, b)})]
    sim = {frozenset((a, b)): s for a, b, s in links}
    while True:
        best = None
        for x in range(len(parts)):
            for y in range(x + 1, len(parts)):
                m = sum(sim.get(frozenset((a, b)), 0) for a in parts[x] for b in parts[y]) / len(parts[x]) / len(parts[y])
                if m >= least and (best is None or m > best[0]):
                    best = (m, x, y)
        if not best:
            return {v: min(p) for p in parts for v in p}
        parts[best[1]] += parts.pop(best[2])


@pytest.mark.parametrize("seed", range(4))
def test_parallel_rounds_equal_one_merge_at_a_time(seed):
    rng = np.random.default_rng(seed)
    links = [(a, b, float(rng.uniform(0.3, 1))) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.6]
    a, b, s = (np.array(x) for x in zip(*links, strict=True))
    ids, c, rounds = clusters.link_rounds(a, b, s, 0.3, "all")
    assert dict(zip(ids.tolist(), c.tolist(), strict=True)) == naive_average(links, 0.3) and rounds >= 1


def test_average_over_all_links_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TABLES", 12)
    rng = np.random.default_rng(5)
    rows = []
    for size, noise in ((30, 0.03), (25, 0.06), (12, 0.075)):  # more than LINKS partners each
        c = rng.normal(size=DIM)
        c /= np.linalg.norm(c)
        rows += [(len(rows) + k, [float(x) for x in c + rng.normal(0, noise, DIM)]) for k in range(size)]
    rows += [(500 + k, rows[n][1]) for k, n in enumerate((1, 1, 31, 40, 40, 40, 56, 60))]  # copies weigh as many as they are
    ids, s = cosines(rows)
    links = [(ids[a], ids[b], s[a, b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if s[a, b] >= 0.9]
    want = naive_average(links, 0.9)
    want = {v: g for v, g in want.items() if list(want.values()).count(g) > 1}
    df = table(spark, rows)
    for local in (clusters.LOCAL, 2):  # in a task, and over the cluster
        got = {r["id"]: r["group_id"] for r in clusters.vector_groups(df, "id", "vec", DIM, 0.9, "all", local).collect()}
        assert got == want and max(list(want.values()).count(g) for g in want.values()) > 30


@pytest.mark.parametrize("local", [clusters.LOCAL, 2])
def test_star_and_chain_are_one_group(spark, monkeypatch, local):
    """A star merges one arm a round: beyond ROUNDS the rest is joined at once."""
    monkeypatch.setattr(clusters, "ROUNDS", 3)
    links = [(0, k, 0.95 + k / 1000) for k in range(1, 13)] + [(k, k + 1, 0.93) for k in range(100, 112)] + [(200, 201, 0.99)]
    df = clusters.materialize(spark.createDataFrame(links, "a bigint, b bigint, sim double"), "links")
    got = {r["v"]: r["c"] for r in clusters.linked_clusters(df, 0.92, "linked", local).collect()}
    assert got == {**{k: 0 for k in range(13)}, **{k: 100 for k in range(100, 113)}, 200: 200, 201: 200}
    assert {r["v"]: r["label"] for r in clusters.components(df).collect()} == got


def test_the_threshold_stops_merges():
    a, b, s = np.array([1, 1, 2, 3]), np.array([2, 3, 3, 4]), np.array([0.95, 0.93, 0.92, 0.5])
    for linkage, want in (("linked", {1: 1, 2: 1, 3: 1, 4: 4}), ("all", {1: 1, 2: 1, 3: 1, 4: 4})):
        ids, c, _ = clusters.link_rounds(a, b, s, 0.9, linkage)
        assert dict(zip(ids.tolist(), c.tolist(), strict=True)) == want
    ids, c, _ = clusters.link_rounds(a[:2], b[:2], s[:2], 0.9, "all")  # 2 and 3 aren't linked
    assert c.tolist() == [1, 1, 3]


def test_sixty_mutual_neighbours_are_one_group(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=DIM)
    rows = [(k, [float(x) for x in c / np.linalg.norm(c) + rng.normal(0, 0.01, DIM)]) for k in range(60)]
    for linkage in ("linked", "all"):
        for local in (clusters.LOCAL, 50):
            g = clusters.vector_groups(table(spark, rows), "id", "vec", DIM, 0.92, linkage, local).collect()
            assert len(g) == 60 and {r["group_id"] for r in g} == {0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_average_over_a_whole_table(spark):
    """Average linkage, one merge at a time, over the exact links of every usable vector."""
    cache = spark.read.parquet("/root/testdata/sf0.01/cluster_cache.parquet")
    rows = {r["vec_id"]: r["embeddings"] for r in cache.collect() if r["vec_id"] is not None and r["embeddings"] is not None}
    rows = {k: v for k, v in rows.items() if len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    links = [(ids[a], ids[b], float(s[a, b])) for a, b in zip(*np.nonzero(np.triu(s >= 0.92, 1)), strict=True)]
    part = components_of(links)
    want = {}
    for root in set(part.values()):
        want |= naive_average([q for q in links if part[q[0]] == root], 0.92)
    want = {v: g for v, g in want.items() if list(want.values()).count(g) > 1}
    got = {r["id"]: r["group_id"] for r in clusters.vector_groups(cache, "vec_id", "embeddings", 64, 0.92, "all").collect()}
    same = sum(got.get(v) == g for v, g in want.items())
    assert len(want) > 200 and same >= 0.98 * len(want) and len(got) <= len(want) + 2  # a link that hashing misses counts as 0
    linked = {r["id"]: r["group_id"] for r in clusters.vector_groups(cache, "vec_id", "embeddings", 64, 0.92).collect()}
    exact = {v: g for v, g in part.items()}
    assert sum(linked.get(v) == g for v, g in exact.items()) >= 0.99 * len(exact)


def components_of(links):
    part = {}
    for a, b, _ in links:
        part.setdefault(a, a), part.setdefault(b, b)
    for _ in part:
        new = dict(part)
        for a, b, _ in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == part:
            return part
        part = new
    return part


def test_hadamard_and_hash():
    x = np.eye(8)
    h = vectors.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(vectors.hadamard(h), x)
    h = vectors.Hash(DIM, 10_000_000)
    assert h.levels > 0 and h.tables == vectors.TABLES + h.levels
    p = h.probes(vectors.unit(np.random.default_rng(0).normal(size=(50, DIM)).astype(np.float32)))
    assert p.shape == (50, 2 * h.tables) and p.max() < h.tables * h.buckets and (p[:, 0] != p[:, 1]).all() and (p[:, ::2] >= 0).all()


def test_butterflies_equal_matrices(monkeypatch):
    x = vectors.unit(np.random.default_rng(3).normal(size=(200, 48)).astype(np.float32))
    dense = vectors.Hash(48, 5_000_000)
    monkeypatch.setattr(vectors, "DENSE", 16)
    fast = vectors.Hash(48, 5_000_000)
    assert dense.matrices is not None and fast.matrices is None and dense.levels > 0
    same = dense.probes(x) == fast.probes(x)
    assert same.mean() > 0.999  # rounding may turn a near tie


def test_placement_by_hash_changes_no_result(spark, monkeypatch):
    df = table(spark, sample(3))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    want = key(vectors.nearest(df, "id", "vec", DIM, 5, 0.5))
    monkeypatch.setattr(vectors, "PLACED", 3)
    assert key(vectors.nearest(df, "id", "vec", DIM, 5, 0.5)) == want
    monkeypatch.setattr(vectors, "TARGET", 20)  # oversized buckets are cut
    monkeypatch.setattr(vectors.Hash, "__init__", (lambda init: lambda self, dim, rows, tables=None: init(self, dim, 10, tables or 3))(vectors.Hash.__init__))
    assert key(vectors.nearest(df, "id", "vec", DIM, 5, 0.5)) == want


@pytest.mark.parametrize("cosine", [0.85, 0.92])
def test_recall_does_not_fall_with_the_number_of_rows(cosine):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 10_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = []
    for rows in (250_000, 4_000_000, 32_000_000):
        h = vectors.Hash(64, rows)
        p, q = h.probes(vectors.unit(a)), h.probes(vectors.unit(b))
        met.append((h.levels, ((p[:, :, None] == q[:, None]) & (p >= 0)[:, :, None]).any(axis=(1, 2)).mean()))
    assert [x for x, _ in met] == [0, 2, 5] and min(r for _, r in met[1:]) >= met[0][1]
