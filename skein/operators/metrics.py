"""The result log: typed rows, warm-up, run totals, and the forms written to CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.formats import parse_percent, percent, seconds, topic_of, whole_mb
from skein.runtime import join_checked, materialize

WARM_UP = 20
#: Timed columns of the log.
TIMES = ("duration", "ebt", "flt", "clt", "slt", "evt", "put", "vst", "qg")


def typed(log: DataFrame) -> DataFrame:
    """Each logged query once: repeated rows dropped, hit_ratio from `chr`, times of -1 or NaN as null.

    (run_id, seq) names a row; rows with a null run_id are told apart by qid and ts besides.
    """
    one = log.dropDuplicates(["run_id", "seq", "qid", "ts"])
    out = one.withColumn("hit_ratio", parse_percent("chr"))
    for c in TIMES:
        out = out.withColumn(c, F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c)))
    return out


def without_warm_up(log: DataFrame, n: int = WARM_UP) -> DataFrame:
    """The rows after the first n of each run, numbered from 1 as log_seq; rows without a seq are dropped."""
    return log.where(F.col("seq") > n).withColumn("log_seq", F.col("seq") - n)


def run_totals(log: DataFrame) -> DataFrame:
    """(run_id, n_queries, n_timed, sum_duration, mean_duration, n_misses, loaded_mb, mean_hit_ratio) of typed rows."""
    return log.groupBy("run_id").agg(
        F.count("*").alias("n_queries"),
        F.count("duration").alias("n_timed"),
        F.round(F.sum("duration"), 4).alias("sum_duration"),
        F.round(F.avg("duration"), 6).alias("mean_duration"),
        F.sum("nmc").alias("n_misses"),
        F.sum("drs").alias("loaded_mb"),
        F.round(F.avg("hit_ratio"), 6).alias("mean_hit_ratio"),
    )


def batch_totals(log: DataFrame) -> DataFrame:
    """(run_id, batch_seq, n, first_seq, last_seq, n_misses) of the known batches of typed rows."""
    known = log.where(F.col("batch_seq") > 0)
    return known.groupBy("run_id", "batch_seq").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("nmc").alias("n_misses"))


def formatted(log: DataFrame) -> DataFrame:
    """The typed rows as text, in the forms of the log: seconds with 4 places, ratios in percent with 3."""
    keep = [F.col(c) for c in ("run_id", "seq", "batch_seq", "qid", "nmc", "num", "drs")]
    return log.select(*keep, *[seconds(F.col(c)).alias(c) for c in TIMES], percent(F.col("hit_ratio")).alias("chr"))


def run_log(trace: DataFrame, keys: list[str], window_col: str = "window_no", warm: int = WARM_UP) -> DataFrame:
    """The result log of traces (cache.trace): keys + (seq, batch_seq, qid, nmc, chr, num, drs, prefetch), one row a query.

    nmc blocks were missing, chr is the hit ratio in percent, num the queries of the batch, drs the whole MB read, prefetch whether
    the query set off a prefetch. The first `warm` queries of a key aren't logged; seq counts the others from 1.
    A query without blocks has a null chr. Times are the machine's and have no model here.
    Places come from the batches' sizes, which are summed up, so no key's rows are sorted in one task.
    """
    t = materialize(trace, "trace")
    sizes = t.groupBy(*keys, window_col).agg(F.count("*").alias("num"))
    w = Window.partitionBy(*keys).orderBy(window_col).rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.withColumn("_before", F.coalesce(F.sum("num").over(w), F.lit(0))), "batches")
    out = join_checked(t, sizes, [*keys, window_col])
    seq = F.col("_before") + F.col("position") - warm
    drs = whole_mb(F.col("load_mb") * 1048576)
    return out.where(seq > 0).select(*keys, seq.alias("seq"), F.col(window_col).alias("batch_seq"), "qid", F.col("n_miss").alias("nmc"), percent(F.col("hit_ratio")).alias("chr"), "num", drs.alias("drs"), (F.size("prefetched") > 0).alias("prefetch"))


def settings(configs: DataFrame) -> DataFrame:
    """Run settings in one spelling with defaults for what is missing.

    linkage complete, jaccard_calculation vector, dynamic_thread dynamic, float_value 0.3 (NaN counts as missing),
    num_thread 8; distance_threshold = 1 - float_value; topic_name by the rule for topics, null for a null or blank topic.
    Rows of one run_id that differ stay apart, equal rows are one.
    """

    def text(c: str, default: str):
        return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit(default)).alias(c)

    f = F.coalesce(F.when(~F.isnan("float_value"), F.col("float_value")), F.lit(0.3))
    return configs.select("run_id", F.lower(F.trim("script")).alias("script"), topic_of("topic").alias("topic_name"), f.alias("float_value"), F.round(1 - f, 6).alias("distance_threshold"), "nlist", "nprobe", "cache_size", text("linkage", "complete"), text("dynamic_thread", "dynamic"), text("jaccard_calculation", "vector"), F.coalesce("num_thread", F.lit(8)).alias("num_thread")).distinct()


def ordinals(probes: DataFrame, id_col: str = "cluster_id", span: int = 100_000) -> DataFrame:
    """(cluster_id, ordinal from 0) of the distinct ids, ascending. Ids are numbered within spans of `span` values and shifted by
    the sizes of the spans before, so however many ids there are, no task orders them all."""
    ids = probes.where(F.col(id_col).isNotNull()).select(id_col).distinct().withColumn("_s", F.floor(F.col(id_col) / span))
    ids = materialize(ids, "ids")
    before = F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))  # a row a span
    spans = materialize(ids.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(before, F.lit(0)).alias("_before")), "spans")
    w = Window.partitionBy("_s").orderBy(id_col)
    return join_checked(ids.withColumn("_r", F.row_number().over(w) - 1), spans, ["_s"]).select(id_col, (F.col("_before") + F.col("_r")).cast("int").alias("ordinal"))
