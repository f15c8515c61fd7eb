import itertools
import math

import numpy as np
import pytest

from skein.llm import cooccurrence as co


def counts(rows):
    out = {}
    for _, s in rows:
        for a, b in itertools.combinations(sorted(set(s or [])), 2):
            out[a, b] = out.get((a, b), 0) + 1
    return out


def sample(n=600):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        s = {int(x) for x in 30 * rng.random(rng.integers(0, 8)) ** 2}
        if rng.random() < 0.1:
            s |= {40, 41}
        rows.append((i, sorted(s) or None))
    return rows


@pytest.mark.parametrize("dense", [True, False])
def test_counts_lift_and_surprise(spark, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(co, "DENSE_ITEMS", 3)
        monkeypatch.setattr(co, "SPARSE_STEP", 100)
    rows = sample()
    df = spark.createDataFrame(rows, "id bigint, ids array<int>").repartition(4)
    got = {(r["a"], r["b"]): r for r in co.associations(df).collect()}
    want = counts(rows)
    assert {k: r["n"] for k, r in got.items()} == want
    total = sum(1 for _, s in rows if s)
    single = {}
    for _, s in rows:
        for x in s or []:
            single[x] = single.get(x, 0) + 1
    for (a, b), r in got.items():
        assert r["n_records"] == total and r["lift"] == pytest.approx(r["n"] * total / single[a] / single[b])
    best = got[40, 41]
    assert best["surprising"] and best["log_p"] == min(r["log_p"] for r in got.values())
    assert sum(r["surprising"] for r in got.values()) < 0.2 * len(got)


def test_long_records_in_steps(spark, monkeypatch):
    monkeypatch.setattr(co, "STEP", 7)
    rows = [(1, list(range(40))), (2, list(range(20, 60))), (3, [1, 2])]
    df = spark.createDataFrame(rows, "id bigint, ids array<int>")
    for dense in (True, False):
        monkeypatch.setattr(co, "DENSE_ITEMS", 100 if dense else 3)
        assert {(r["a"], r["b"]): r["n"] for r in co.associations(df).collect()} == counts(rows)


def test_fit_reproduces_frequencies_and_sizes():
    freq, items = np.array([5.0, 20, 50]), np.array([10.0, 4, 2])
    size, baskets = np.array([1.0, 2, 4]), np.array([60.0, 55, 15])
    x, y = co.fit_null(freq, items, size, baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * baskets).sum(1), freq, rtol=1e-6) and np.allclose((p * items[:, None]).sum(0), size, rtol=1e-6)


def exact_tail(q, m):
    dist = np.array([1.0])
    for qq, mm in zip(q, m, strict=True):
        for _ in range(int(mm)):
            dist = np.convolve(dist, [1 - qq, qq])
    return np.cumsum(dist[::-1])[::-1]


@pytest.mark.parametrize("q", [[0.01, 0.05, 0.3], [0.001, 0.002, 0.004], [0.5, 0.6, 0.9]])
def test_tail_against_the_exact_distribution(q):
    m = np.array([60.0, 30, 10])
    exact = exact_tail(q, m)
    for n in range(0, 100):
        got = co.log_tail(np.array([q]), m, np.array([n]))[0]
        if exact[n] > 1e-280:
            assert abs(got - math.log(exact[n])) < max(0.12, 0.02 * abs(math.log(exact[n])))
    assert co.log_tail(np.array([q]), m, np.array([0]))[0] == 0


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [5])], "id bigint, ids array<int>")
    assert co.associations(df).collect() == []
    assert co.associations(df.limit(0)).collect() == []


def test_binned_frequencies_change_expectations_little():
    rng = np.random.default_rng(0)
    freq = np.unique((np.exp(rng.uniform(0, 9, 3000))).astype(int))
    items = np.ones(len(freq))
    f, m = co.binned(freq, items, 400)
    assert len(f) <= 400 and m.sum() == len(freq) and abs((f * m).sum() / freq.sum() - 1) < 1e-12
    size, baskets = np.array([5.0, 20, 40]), np.array([1.0, 1, 1]) * freq.sum() / 65
    whole, _ = co.fit_null(freq, items, size, baskets)
    x, _ = co.fit_null(f, m, size, baskets)
    near = np.exp(np.interp(np.log(freq), np.log(f), np.log(x)))
    assert np.abs(near / whole - 1).max() < 0.02
    assert (co.binned(freq, items, 10_000)[0] == freq).all()
