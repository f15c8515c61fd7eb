import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.sets import clean_ids, jaccard, record_sets
from skein.operators import hotkeys

ROWS = [(1, [3, 1, 3, None, -1], "x", 0), (1, [1, 3], "y", 1), (2, None, None, 2), (3, [], "z", 3), (4, [-1, None], "z", 4), (None, [5], "z", 5), (5, [9, 1], None, 6), (6, [1], "q", 7)]
# names that also occur inside the operators
SCHEMA = "qid bigint, cluster_ids_set array<int>, ids string, n int"


def test_record_sets_nulls_duplicates_and_clashing_names(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["id"]: r["ids"] for r in record_sets(df, "qid", "cluster_ids_set").collect()}
    assert got == {1: [1, 3], 5: [1, 9], 6: [1]}


def test_record_sets_disagreeing_copies_give_the_smallest(spark):
    df = spark.createDataFrame([(1, [7]), (1, [2, 9]), (1, [])], "qid bigint, s array<int>")
    assert [r["ids"] for r in record_sets(df, "qid", "s").collect()] == [[2, 9]]


def test_clean_and_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), (None, [1]), ([1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0, 1.0]
    assert [r[0] for r in df.select(clean_ids("a")).collect()] == [[1, 2, 3], [], [], [1]]


def brute(records):
    out = {}
    for i, ks in records:
        for k in ks or []:
            if k is not None:
                out.setdefault(k, []).append(i)
    return out


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_per_key_against_brute_force_with_a_hot_key(spark, kind):
    rng = np.random.default_rng(3)
    recs = []
    for i in range(3000):
        ks = {int(k) for k in rng.zipf(1.5, 4) if k < 200} | ({0} if i % 3 == 0 else set())
        recs.append((i, [str(k) if kind == "string" else k for k in ks] or None))
    df = spark.createDataFrame(recs, f"id bigint, ids array<{kind}>").repartition(7)
    got = {r["key"]: r for r in hotkeys.per_key(df).collect()}
    want = brute(recs)
    total = got.pop(None)
    assert total["n"] == sum(1 for _, k in recs if k)
    assert {k: (r["n"], r["id_sum"], r["id_min"], r["id_max"]) for k, r in got.items()} == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items()}


def test_per_key_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None])], "id bigint, ids array<int>")
    assert [(r["key"], r["n"]) for r in hotkeys.per_key(df).collect()] == [(None, 1)]
    none = spark.createDataFrame([], "id bigint, ids array<int>")
    assert sum(r["n"] for r in hotkeys.per_key(none).collect()) == 0
    assert hotkeys.frequent_keys(none, 0.1).collect() == []


def test_frequent_keys_at_the_threshold(spark):
    df = spark.createDataFrame([(i, [1] if i == 0 else [2]) for i in range(10)], "id bigint, ids array<int>")
    assert {r["key"] for r in hotkeys.frequent_keys(df, 0.1).collect()} == {1, 2}
    assert {r["key"] for r in hotkeys.frequent_keys(df, 0.11).collect()} == {2}


def test_postings_are_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "CHUNK", 16)
    recs = [(i, [0, i % 5 + 1]) for i in range(400)] + [(None, [7])]
    df = spark.createDataFrame(recs, "id bigint, ids array<int>").repartition(3)
    rows = hotkeys.postings(df).collect()
    assert all(len(r["record_ids"]) == r["n"] <= 16 for r in rows)
    assert len({(r["key"], r["part"]) for r in rows}) == len(rows)
    got = {}
    for r in rows:
        got.setdefault(r["key"], []).extend(r["record_ids"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(recs[:-1]).items()}
