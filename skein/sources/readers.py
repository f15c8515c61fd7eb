"""Query corpora and query streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("_bad", T.StringType())])
#: Records and bytes of one poll of the log.
POLL_RECORDS, FETCH_BYTES = 300_000, 10 << 20


def parse_lines(lines: DataFrame, raw_col: str = "raw_line") -> DataFrame:
    """Adds `text` of JSON lines and keeps the lines that have one.

    Blank, commented, cut off and otherwise invalid lines are skipped, and so are lines
    without text or with a null one. An empty text is a text.
    """
    j = F.from_json(F.col(raw_col), _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_j", j).where("_j._bad IS NULL AND _j.text IS NOT NULL").withColumn("text", F.col("_j.text")).drop("_j")


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a JSON-lines file; a missing file is an empty corpus."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "text string")
        raise
    return parse_lines(lines, "value").select("text")


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(POLL_RECORDS), "kafka.max.partition.fetch.bytes": str(FETCH_BYTES), "failOnDataLoss": "false"}


def kafka_queries(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """(seq, text, ts) of a topic from its start; needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topic)).load()
    return raw.select(F.col("offset").alias("seq"), F.col("value").cast("string").alias("text"), F.col("timestamp").alias("ts"))


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, `per_trigger` files to a batch: the offline stand-in of a topic."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
