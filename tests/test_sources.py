import pytest
from pyspark.sql import functions as F

from skein.functions import encode, formats
from skein.operators import index, metrics, traffic
from skein.sources import readers, sinks
from skein.streaming import cachestream, windows


def test_lines(spark, tmp_path):
    good = ['{"_id": "q1", "text": "a b", "metadata": {}}', '{"text": ""}', '{"text": "x", "text2": "y"}']
    bad = ["", "   ", "// note", "# note", '{"_id": "q2", "text": "cut', '{"_id": "q3"}', '{"text": null}', "[]", None, "17"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "line_no bigint, raw_line string")
    assert [r["text"] for r in readers.parse_lines(df).orderBy("line_no").collect()] == ["a b", "", "x"]
    p = tmp_path / "q.jsonl"
    p.write_text("\n".join(x for x in good + bad if x is not None))
    assert sorted(r[0] for r in readers.jsonl(spark, str(p)).collect()) == ["", "a b", "x"]
    assert readers.jsonl(spark, str(tmp_path / "none.jsonl")).collect() == []
    assert readers.kafka_options("h:1", "t")["startingOffsets"] == "earliest"


def test_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, "0.5000", None), ("r2", 2, "0.2500", "66.667%")], "run_id string, seq bigint, duration string, chr string")
    path = sinks.result_path(str(tmp_path), "ds", "grouping", 100, 0.5, "complete", "dynamic", "vector", "t1", "fg")
    assert path.endswith("ds/grouping/100/0.5/complete/dynamic/vector/fg/t1")
    sinks.write_log(df, path, ["run_id"])
    sinks.write_log(df.where("seq = 1"), path, ["run_id"])
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 3 and back.where("chr = '66.667%' AND run_id = 'r2'").count() == 1
    with pytest.raises(ValueError):
        sinks.result_path("a", "b", "c", 1, 1, "", "", "", "")


def test_formats(spark):
    df = spark.createDataFrame([("66.667%", 0.66667, 3 << 20, " HotpotQA "), ("x", None, 100, "fever"), (None, 0.0, 0, " ")], "chr string, r double, b bigint, t string")
    rows = df.select(formats.parse_percent("chr").alias("p"), formats.whole_mb(F.col("b")).alias("m"), formats.topic_of("t").alias("t"), formats.percent(F.col("r")).alias("f")).collect()
    assert [(r["m"], r["t"]) for r in rows] == [(3, "hotpotqa"), (0, "fever_query"), (0, None)]
    assert rows[0]["p"] == pytest.approx(0.66667) and rows[1]["p"] is None and rows[2]["p"] is None
    assert rows[0]["f"] == "66.667%" and rows[2]["f"] == "0.000%"


def test_encoder(spark):
    df = spark.createDataFrame([("The cat sat",), ("the  CAT sat",), ("",), (None,), ("x" * 100_000,)], "text string")
    v = [r[0] for r in df.select(encode.encode("text")).collect()]
    assert v[0] == v[1] and len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1, abs=1e-5)
    assert set(v[2]) == {0.0} and v[3] is None
    assert encode.chunk_size(17, 8) == 3 and encode.chunk_size(0) == 1


def test_metrics(spark):
    nan = float("nan")
    rows = [("r", 1, 0, 7, -1.0, "50.000%"), ("r", 1, 0, 7, -1.0, "50.000%"), ("r", 21, 2, 8, 0.5, "bad"), ("r", 22, 2, 9, nan, None), (None, 1, None, 1, 0.25, "0.000%"), (None, 1, None, 2, 0.25, "0.000%")]
    base = spark.createDataFrame(rows, "run_id string, seq bigint, batch_seq bigint, qid bigint, duration double, chr string")
    for c in ("ebt", "flt", "clt", "slt", "evt", "put", "vst", "qg"):
        base = base.withColumn(c, F.lit(0.1))
    log = metrics.typed(base.withColumn("nmc", F.lit(1)).withColumn("num", F.lit(1)).withColumn("drs", F.lit(2)).withColumn("ts", F.lit(None).cast("timestamp")))
    got = {r["run_id"]: r for r in metrics.run_totals(log).collect()}
    assert (got["r"]["n_queries"], got["r"]["n_timed"], got["r"]["mean_duration"], got["r"]["mean_hit_ratio"]) == (3, 1, 0.5, 0.5)
    assert got[None]["n_queries"] == 2
    assert [r["log_seq"] for r in metrics.without_warm_up(log).orderBy("seq").collect()] == [1, 2]
    assert [(r["batch_seq"], r["n"]) for r in metrics.batch_totals(log).collect()] == [(2, 2)]
    assert {r["chr"] for r in metrics.formatted(log).collect()} == {"50.000%", "0.000%", None}
    assert metrics.run_totals(log.limit(0)).collect() == []


def test_settings_and_ordinals(spark):
    df = spark.createDataFrame([("a", "plain", " Mosswick", float("nan"), 1000, 16, 50, None, "STATIC ", None, None), ("b", "plain", None, 0.5, 1000, 16, 50, " Single", None, "loop", 1)], "run_id string, script string, topic string, float_value double, nlist int, nprobe int, cache_size int, linkage string, dynamic_thread string, jaccard_calculation string, num_thread int")
    a, b = metrics.settings(df.unionAll(df)).orderBy("run_id").collect()
    assert (a["topic_name"], a["linkage"], a["distance_threshold"], a["num_thread"], a["dynamic_thread"]) == ("mosswick_query", "complete", 0.7, 8, "static")
    assert (b["topic_name"], b["linkage"], b["distance_threshold"]) == (None, "single", 0.5)
    ids = spark.createDataFrame([(9,), (3,), (9,), (None,)], "cluster_id int")
    assert [(r[0], r[1]) for r in metrics.ordinals(ids).orderBy("ordinal").collect()] == [(3, 0), (9, 1)]


def test_adaptive_threads(spark):
    df = spark.createDataFrame([(10.0, 1.0, 4), (None, None, 3), (10.0, 1.0, 0), (1.0, 1.0, 50), (100.0, 1.0, 50)], "t double, a double, m int")
    assert [r[0] for r in df.select(index.adaptive_threads(F.col("t"), F.col("a"), F.col("m"))).collect()] == [4, 1, 1, 1, 8]


def test_traffic_does_not_depend_on_partitions(spark):
    a = traffic.targets(spark, 2000).toPandas().sort_values(["slot", "step"]).reset_index(drop=True)
    b = traffic.targets(spark, 2000).repartition(3).toPandas().sort_values(["slot", "step"]).reset_index(drop=True)
    assert a.equals(b)
    normal, burst = a[~a.burst].target, a[a.burst]
    assert normal.min() == 50 and normal.max() == 150 and abs(normal.mean() - 100) < 3
    assert 0.07 < a[a.burst].slot.nunique() / 2000 < 0.13
    assert (burst.groupby("slot").size() == 5).all() and (burst.groupby("slot").target.max() == 300).all() and burst.target.min() >= 100
    gaps = traffic.poisson_gaps(spark.range(5000).withColumnRenamed("id", "line_no")).toPandas().gap_sec
    assert abs(gaps.mean() - 1) < 0.1 and abs(gaps.var() - 1) < 0.15


def test_windows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2026-01-01 00:00:04', 'a'), (2, 2, timestamp'2026-01-01 00:00:05', 'a'), (3, 3, null, 'a') t(qid, seq, ts, topic)")
    w = [r[0] for r in windows.poll_windows(df).orderBy("seq").select(F.unix_timestamp("window_start") % 60).collect()]
    assert w == [0, 5, None]
    assert [r["window_no"] for r in windows.count_windows(df, 2, ["topic"]).orderBy("seq").collect()] == [0, 0, 1]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT id AS qid, id AS seq, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 7) AS ts, if(id % 3 = 0, null, 'a') AS topic, array(cast(id % 5 AS int), cast(id % 7 + 5 AS int), -1, null) AS cluster_ids_set FROM range(60)")
    src = str(tmp_path / "in")
    for k in range(3):  # three files, arriving in order
        rows.where(f"seq DIV 20 = {k}").coalesce(1).write.mode("append").parquet(src)
    stream = readers.stream_table(spark, src, rows.schema, 1)
    out = []
    windows.run_once(windows.probe_counts(stream), lambda b, e: out.extend((e, *r) for r in b.collect()), str(tmp_path / "c1"), "update")
    last = {}
    for _, day, c, n in sorted(out):
        last[day, c] = n
    want = {(r["day"], r["cluster_id"]): r["n"] for r in windows.probe_counts(rows).collect()}
    assert last == want
    lat, mb = {i: 1.0 + i for i in range(12)}, {i: 1.0 for i in range(12)}
    got = {}
    for per, name in ((1, "c2"), (10, "c3")):  # state carries over between batches
        s = readers.stream_table(spark, src, rows.schema, per).withColumn("cluster_ids", F.expr("filter(cluster_ids_set, x -> x >= 0)"))
        res = []
        windows.run_once(cachestream.stream_trace(s, lat, mb, 4, "window_top", "topic", 60.0), lambda b, e, res=res: res.extend(tuple(r) for r in b.collect()), str(tmp_path / name))
        got[per] = sorted(res)
    assert got[1] == got[10] and len(got[1]) == 60
    log = str(tmp_path / "log")
    each = sinks.log_batches(log)
    each(rows.select("qid"), 0)
    each(rows.select("qid"), 0)
    assert spark.read.option("header", True).csv(log).count() == 60


def test_stream_groups_equal_batch(spark, tmp_path):
    from skein.operators import grouping
    from skein.streaming import groups

    rows = spark.sql("SELECT id DIV 10 AS window_id, id AS qid, id AS seq, array(cast(id % 4 AS int), cast(id % 4 + 9 AS int)) AS cluster_ids FROM range(40)")
    src = str(tmp_path / "in")
    for k in range(4):
        rows.where(f"window_id = {k}").coalesce(1).write.mode("append").parquet(src)
    windows.run_once(readers.stream_table(spark, src, rows.schema, 1), groups.group_batches(str(tmp_path / "out"), 0.5, "complete"), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("epoch").collect())
    want = sorted(tuple(r) for r in grouping.schedule(grouping.group_windows(rows, 0.5, "complete")).collect())
    assert got == want


def test_stream_cache_windows_are_the_references(spark, tmp_path):
    """A window of the registered stream ends after 60 seconds, and all but its ten most used blocks leave."""
    from skein.plans import streams

    d = str(tmp_path)
    rows = spark.sql("SELECT id AS qid, id AS seq, 'a' AS topic, timestamp_seconds(1700000000 + 35 * id) AS ts, sequence(1, 14) AS cluster_ids_set FROM range(4)")
    rows.coalesce(1).write.parquet(f"{d}/all_results.parquet")
    spark.sql("SELECT cast(id AS int) AS cluster_id, 1.0D AS latency_sec, 1.0D AS size_mb FROM range(20)").write.parquet(f"{d}/cluster_stats.parquet")
    spark.sql("SELECT cast(id AS int) AS cluster_id FROM range(20)").write.parquet(f"{d}/centroids.parquet")
    got = sorted((r["seq"], r["n_hit"], r["n_miss"], r["n_evicted"]) for r in streams.stream_cache(spark, d).collect())
    assert got == [(0, 0, 14, 0), (1, 14, 0, 0), (2, 10, 4, 4), (3, 14, 0, 0)]


def test_stream_groups_of_windows_split_over_batches(spark, tmp_path):
    """Windows and redelivered queries spread over batches give the schedule of the whole table."""
    from skein.operators import grouping
    from skein.streaming import groups

    rows = spark.sql("SELECT id % 3 AS window_id, id AS qid, id AS seq, array(cast(id % 5 AS int), cast(id % 7 + 9 AS int)) AS cluster_ids FROM range(40)")
    again = rows.where("qid % 4 = 0").selectExpr("(window_id + 1) % 4 AS window_id", "qid", "seq + 100 * (qid % 8) - 50 AS seq", "cluster_ids")
    every, src = rows.unionByName(again), str(tmp_path / "in")
    for k in range(4):
        every.where(f"(qid + seq) DIV 3 % 4 = {k} OR (seq < 0 AND {k} = 3)").coalesce(1).write.mode("append").parquet(src)
    windows.run_once(readers.stream_table(spark, src, rows.schema, 1), groups.group_batches(str(tmp_path / "out"), 0.3, "single", 9), str(tmp_path / "c"))
    got = sorted(tuple(r) for r in groups.newest(spark, str(tmp_path / "out")).collect())
    first = {}
    for r in every.collect():
        if r["qid"] not in first or r["seq"] < first[r["qid"]]["seq"]:
            first[r["qid"]] = r
    one = spark.createDataFrame(list(first.values()), rows.schema)
    want = sorted(tuple(r) for r in grouping.schedule(grouping.group_windows(grouping.cap_window(one, 9), 0.3, "single")).collect())
    assert got == want and len({r[1] for r in got}) == len(got)
