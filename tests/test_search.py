import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.vectors import squared_l2, usable
from skein import runtime
from skein.operators import index, search

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (400, DIM)).astype(float)  # many equal distances
    c = rng.integers(-3, 4, (12, DIM)).astype(float)
    home = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    corpus = spark.createDataFrame([(i, int(home[i]), x[i].tolist()) for i in range(400)], "vec_id bigint, cluster_id int, embedding array<float>").repartition(5)
    cents = spark.createDataFrame([(i, c[i].tolist()) for i in range(12)] + [(None, c[0].tolist()), (99, None)], "cluster_id int, centroid array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 400, 9)], "qid bigint, qvec array<float>")
    return x, c, home, corpus, cents, queries


def test_coarse_probe_with_ties(data):
    x, c, _, _, cents, queries = data
    got = {}
    for r in search.coarse_probe(queries, cents, 4, DIM).collect():
        got.setdefault(r["qid"], {})[r["probe_rank"]] = (r["cluster_id"], round(r["dist"], 9))
    for q, ranks in got.items():
        d = ((x[q] - c) ** 2).sum(1)
        want = sorted(range(12), key=lambda i: (d[i], i))[:4]
        assert [ranks[i + 1] for i in range(4)] == [(i, round(float(d[i]), 9)) for i in want]


@pytest.mark.parametrize("block", [10_000, 20])
def test_flat_search_equals_brute_force(data, monkeypatch, block):
    monkeypatch.setattr(search, "QUERIES", block)
    x, _, _, corpus, _, queries = data
    rows = search.search(queries, corpus, 5, DIM).collect()
    got = {}
    for r in rows:
        got.setdefault(r["qid"], {})[r["rank"]] = (r["vec_id"], round(r["dist"], 9))
    assert len(got) == 45
    for q, ranks in got.items():
        d = ((x[q] - x) ** 2).sum(1)
        assert [ranks[i + 1] for i in range(5)] == [(i, round(float(d[i]), 9)) for i in sorted(range(400), key=lambda i: (d[i], i))[:5]]


def test_probing_every_block_equals_flat_and_blocks_may_be_missing(data):
    _, _, _, corpus, cents, queries = data
    probes = search.coarse_probe(queries, cents, 12, DIM)
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(search.search(queries, corpus, 5, DIM, probes)) == key(search.search(queries, corpus, 5, DIM))
    gone = search.search(queries, corpus.where("cluster_id > 5"), 5, DIM, probes)
    assert gone.where("cluster_id <= 5").count() == 0
    assert search.recall(search.search(queries, corpus, 5, DIM, probes), search.search(queries, corpus, 5, DIM)).first()["recall"] == 1.0


def test_per_cluster_topk(data):
    x, _, home, corpus, cents, queries = data
    probes = search.coarse_probe(queries, cents, 3, DIM)
    for r in search.search(queries, corpus, 2, DIM, probes, per_cluster=True).where("rank = 1").collect():
        d = ((x[r["qid"]] - x) ** 2).sum(1)
        mine = [i for i in range(400) if home[i] == r["cluster_id"]]
        assert min(mine, key=lambda i: (d[i], i)) == r["vec_id"]


def test_empty_inputs(spark, data):
    _, _, _, corpus, cents, queries = data
    none = queries.limit(0)
    assert search.search(none, corpus, 5, DIM).collect() == []
    assert search.search(queries, corpus.limit(0), 5, DIM).collect() == []
    assert search.coarse_probe(none, cents, 3, DIM).collect() == []
    assert search.coarse_probe(queries, cents.limit(0), 3, DIM).collect() == []
    assert search.recall(search.search(none, corpus, 5, DIM), search.search(none, corpus, 5, DIM)).first()["recall"] is None


def test_usable_and_distance(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([nan, 1.0],), ([inf, 1.0],), ([-inf, 1.0],), ([None, 1.0],), ([1.0],), ([],), (None,), ([-1.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(usable("v", 2)).collect()] == [True] + [False] * 8 + [True]
    d = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<double>")
    assert [r[0] for r in d.select(squared_l2(F.col("a"), F.col("b"))).collect()] == [25.0, None, None]


def test_corpus_keeps_the_latest_row(spark):
    import datetime as dt

    t = [dt.datetime(2026, 1, i + 1) for i in range(3)]
    v = [1.0] * DIM
    rows = [(1, 5, v, t[0]), (1, 6, v, t[1]), (1, 7, v, None), (2, None, v, t[0]), (None, 1, v, t[0]), (3, 4, [0.0] * DIM, t[0]), (4, 9, v, None), (4, 8, v, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, cluster_id int, embeddings array<float>, loaded_at timestamp")
    assert {(r["vec_id"], r["cluster_id"]) for r in index.corpus(df, DIM).collect()} == {(1, 6), (4, 8)}
    p = index.profile(index.corpus(df, DIM), DIM).collect()
    assert all(r["n_vectors"] == 1 and r["size_mb"] == DIM * 4 / 1048576 for r in p)


def test_costs_and_placement(spark):
    inf = float("inf")
    stats = spark.createDataFrame([(1, 0.5, 2.0), (1, 0.7, None), (2, None, 1.0), (3, inf, 0.0), (77, 1.0, 1.0), (None, 1.0, 1.0)], "cluster_id int, latency_sec double, size_mb double")
    cents = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "cluster_id int")
    got = {r["cluster_id"]: (r["latency_sec"], r["size_mb"]) for r in index.measured_costs(stats, cents).collect()}
    assert got == {1: (0.7, 2.0), 2: (inf, 1.0), 3: (inf, 0.0), 4: (inf, 0.0)}
    misses = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 1), (1, 3, 4), (1, 4, 55)], "qid bigint, probe_rank int, cluster_id int")
    order = index.placement(misses, index.measured_costs(stats, cents), ["qid"], 2).orderBy("load_rank").collect()
    assert [(r["cluster_id"], r["batch"]) for r in order] == [(1, 0), (2, 0), (3, 1), (4, 1), (55, 2)]


@pytest.mark.parametrize("cell", [20_000, 30])
def test_joined_search_equals_the_scan(spark, data, monkeypatch, cell):
    monkeypatch.setattr(search, "CELL", cell)
    _, _, _, corpus, cents, queries = data
    probes = search.coarse_probe(queries, cents, 3, DIM)
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"], r["cluster_id"], round(r["dist"], 9)) for r in df.collect())
    for per_cluster in (False, True):
        want = key(search.search(queries, corpus, 4, DIM, probes, per_cluster))
        assert key(search.search(queries, corpus, 4, DIM, probes, per_cluster, many=True)) == want
        monkeypatch.setattr(search, "QUERIES", 7)  # more queries than a task holds
        assert key(search.search(queries, corpus, 4, DIM, probes, per_cluster)) == want
        monkeypatch.setattr(search, "QUERIES", 10_000)
    assert search.search(queries.limit(0), corpus, 4, DIM, probes, many=True).collect() == []
    assert search.search(queries, corpus.limit(0), 4, DIM, probes, many=True).collect() == []


def test_written_index_is_read_by_its_directories(spark, data, tmp_path, monkeypatch):
    x, _, home, corpus, cents, queries = data
    monkeypatch.setattr(index, "SPAN", 4)
    index.write_index(corpus, str(tmp_path / "i"), DIM)
    blocks = spark.read.parquet(str(tmp_path / "i"))
    df = index.probed(blocks, [1, 3, 3])
    assert df.count() == int(((home == 1) | (home == 3)).sum())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "PushedFilters: [Or(EqualTo(cluster_id" in plan or "PushedFilters: [In(cluster_id" in plan
    probes = search.coarse_probe(queries, cents, 2, DIM)
    key = lambda df: sorted((r["qid"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(search.search(queries, blocks, 5, DIM, probes)) == key(search.search(queries, corpus, 5, DIM, probes))


def test_kept_tables_and_scratch(spark, tmp_path):
    import os

    src, wrote = str(tmp_path / "s"), []
    spark.range(5).write.parquet(src)

    def write(path):
        wrote.append(path)
        spark.read.parquet(src).write.parquet(path)

    with runtime.scratch(spark):
        assert runtime.kept(spark.read.parquet(src), "k", write).count() == 5
        t = runtime.materialize(spark.range(3), "three")
        (gone,) = {f[7:].rsplit("/", 2)[0] for f in t.inputFiles()}
        assert os.path.isdir(gone)
    assert not os.path.exists(gone)
    assert runtime.kept(spark.read.parquet(src), "k", write).count() == 5 and len(wrote) == 1
    spark.range(7).write.mode("overwrite").parquet(src)
    assert runtime.kept(spark.read.parquet(src), "k", write).count() == 7 and len(wrote) == 2


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_partitioned_corpus_prunes(spark, data, tmp_path):
    _, _, home, corpus, _, _ = data
    index.write_partitioned(corpus, str(tmp_path / "c"))
    df = index.read_blocks(spark, str(tmp_path / "c"), [1, 3])
    assert df.count() == int(((home == 1) | (home == 3)).sum())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan or "PartitionFilters: [cluster_id" in plan
