from fractions import Fraction

import numpy as np
import pytest

from skein.llm import setjoin


def brute(rows, threshold, least):
    sets = {}
    for i, s in rows:
        s = frozenset(x for x in s or [] if x is not None and x >= 0)
        if i is not None and len(s) >= max(1, least):
            sets[i] = s
    t = Fraction(str(threshold))
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) * t.denominator >= t.numerator * len(sets[a] | sets[b])}


def sample(seed, n=400, universe=60):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            s = set(rows[rng.integers(len(rows))][1] or [])
            for x in rng.integers(0, universe, rng.integers(0, 4)).tolist():
                s ^= {x}
        else:
            s = set((universe * rng.random(rng.integers(0, 14)) ** 3).astype(int).tolist())
        rows.append((i, list(s)))
    rows += [(0, rows[0][1][::-1]), (None, [1, 2, 3, 4, 5]), (n, None), (n + 1, []), (n + 2, [-1, None, -1]), (n + 3, [1, 1, 2, None, -1, 3, 4, 5]), (n + 4, [5, 4, 3, 2, 1])]
    return rows


def table(spark, rows, kind="int"):
    return spark.createDataFrame([(i, s, 1, "x") for i, s in rows], f"qid bigint, items array<{kind}>, id int, ids string").repartition(3)


@pytest.mark.parametrize("threshold,least", [(0.7, 5), (0.5, 1), (0.8, 2), (1, 1), ("1/3", 1)])
def test_pairs_equal_brute_force(spark, threshold, least):
    for seed in range(2):
        rows = sample(seed)
        got = setjoin.similar_records(table(spark, rows), "qid", "items", threshold, least).collect()
        assert len(got) == len(set(got))
        assert {(r["a"], r["b"]) for r in got} == brute(rows, threshold, least)


def test_cut_lists_and_hashed_ranks(spark, monkeypatch):
    rows = sample(9)
    want = brute(rows, 0.7, 5)
    monkeypatch.setattr(setjoin, "LIST", 25)
    monkeypatch.setattr(setjoin, "STEP", 50)
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5).collect()} == want
    monkeypatch.setattr(setjoin, "GAPS", 1)
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5).collect()} == want
    monkeypatch.setattr(setjoin, "RANKED", 3)
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5).collect()} == want


def test_many_items_and_one_in_half_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "RANKED", 50)
    monkeypatch.setattr(setjoin, "LIST", 40)
    rng = np.random.default_rng(3)
    rows, big = [], 1 << 40
    for i in range(600):
        own = set(rng.integers(big, big + 4000, 4).tolist()) if i % 3 or not rows else set(rows[int(rng.integers(len(rows)))][1]) - {5}
        rows.append((i, sorted(own | ({5} if i % 2 else set()) | ({int(rng.integers(big, big + 4000))} if i % 5 == 0 else set()))))
    rows.append((600, [2**63 - 1, 2**63 - 2, 0, 5]))
    rows.append((601, [2**63 - 1, 2**63 - 2, 0, 6, 5]))
    rec = setjoin.Records(table(spark, rows, "bigint"), "qid", "items", 2)
    assert not setjoin.small_or_none(rec.items, setjoin.RANKED)
    spark.conf.set("spark.sql.shuffle.partitions", 32)  # cells
    shipped, cells, _, cut = setjoin.cells_of(rec, 0.5)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    most = shipped.selectExpr("cell", "length(ids) / 8 AS n").groupBy("cell").agg({"n": "sum"}).toPandas().iloc[:, 1].max()
    assert most <= 0.2 * len(rows)  # neither the frequent item's list nor that of the rest is one cell
    want = brute(rows, 0.5, 2)
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows, "bigint"), "qid", "items", 0.5, 2).collect()} == want
    monkeypatch.setattr(setjoin, "LIST", 1)  # every list is cut, those of items without a rank too
    rec = setjoin.Records(table(spark, rows[:150], "bigint"), "qid", "items", 2)
    assert setjoin.cells_of(rec, 0.5)[3]
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows[:150], "bigint"), "qid", "items", 0.5, 2).collect()} == brute(rows[:150], 0.5, 2)


def test_long_records(spark, monkeypatch):
    rows = sample(5)
    want = brute(rows, 0.7, 5)
    monkeypatch.setattr(setjoin, "LONG", 7)
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5).collect()} == want
    monkeypatch.undo()
    far = [(1, list(range(20_000))), (2, list(range(100, 20_000))), (3, list(range(30_000, 30_300))), (4, list(range(30_050, 30_300)))]
    assert {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, far), "qid", "items", 0.7, 5).collect()} == {(1, 2), (3, 4)}


def test_exactly_at_the_threshold(spark):
    rows = [(1, list(range(10))), (2, list(range(7)) + [10, 11, 12][:0]), (3, list(range(6))), (4, list(range(100, 117))), (5, list(range(103, 120)))]
    got = {(r["a"], r["b"]) for r in setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5).collect()}
    assert got == {(1, 2), (2, 3), (4, 5)}  # 7/10, 6/7, 14/20; not 6/10


def test_classes(spark):
    rows = [(3, [1, 2, 3, 4, 5]), (1, [5, 4, 3, 2, 1]), (2, [1, 2, 3, 4, 5, 6]), (4, [20, 21, 22, 23, 24]), (4, [24, 20, 21, 22, 23])]
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in setjoin.linked_classes(table(spark, rows), "qid", "items", 0.7, 5).collect()}
    assert got == {1: (1, 2, 1), 3: (1, 2, 1), 2: (2, 1, 1), 4: (4, 1, 0)}


def test_a_third_of_equal_sets(spark):
    rows = [(i, [7, 8, 9, 10, 11]) for i in range(60)] + [(100 + i, [20 + i * 5 + k for k in range(5)]) for i in range(120)]
    got = setjoin.similar_records(table(spark, rows), "qid", "items", 0.7, 5)
    assert got.count() == 60 * 59 // 2


def test_empty(spark):
    none = table(spark, [(1, [1])]).where("qid > 5")
    assert setjoin.similar_records(none, "qid", "items", 0.7, 5).collect() == []
    assert setjoin.linked_classes(none, "qid", "items", 0.7, 5).collect() == []


def test_gap_code():
    rng = np.random.default_rng(0)
    lens = rng.integers(1, 9, 50)
    flat = np.concatenate([np.sort(rng.choice(5000, n, replace=False)) for n in lens])
    assert (setjoin._ungaps(setjoin._gaps(flat, lens), lens) == flat).all()
