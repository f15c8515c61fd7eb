"""Offered load: a seeded generator of target sizes, uniform with Weibull bursts, and arrival times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the load model.
LOW, HIGH, BASE, PEAK, SHAPE, STEPS, CHANCE = 50, 150, 100, 3, 2.0, 5, 0.1


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only, not on partitions."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def weibull(u: Column, shape: float) -> Column:
    """The inverse distribution function: (-ln(1 - u)) ** (1 / shape)."""
    return F.pow(-F.log1p(-u), F.lit(1.0 / shape))


def targets(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Rows (slot, step, burst, target) of n slots.

    A slot is normal, one target uniform between LOW and HIGH inclusive, or with
    probability CHANCE a burst of STEPS targets int(BASE * (1 + (PEAK - 1) * w)), w the
    step's Weibull draw over the largest of the burst.
    """
    s = spark.range(n).withColumnRenamed("id", "slot").withColumn("burst", uniform(seed, F.lit("burst"), F.col("slot")) < CHANCE)
    normal = s.where("NOT burst").select("slot", F.lit(0).alias("step"), "burst", (LOW + F.floor(uniform(seed, F.lit("size"), F.col("slot")) * (HIGH - LOW + 1))).cast("int").alias("target"))
    draws = F.array(*[weibull(uniform(seed, F.lit("step"), F.col("slot"), F.lit(i)), SHAPE) for i in range(STEPS)])
    b = s.where("burst").withColumn("w", draws).select("slot", "burst", F.array_max("w").alias("m"), F.posexplode("w").alias("step", "w"))
    burst = b.select("slot", "step", "burst", F.floor(BASE * (1 + (PEAK - 1) * F.col("w") / F.col("m"))).cast("int").alias("target"))
    return normal.unionByName(burst)


def poisson_gaps(texts: DataFrame, seed: int = 1, mean: float = 1.0, id_col: str = "line_no") -> DataFrame:
    """Adds gap_sec: a Poisson(mean) draw by inversion of up to 12 terms, as pacing of a producer."""
    import math

    u = uniform(seed, F.lit("gap"), F.col(id_col))
    total, out = 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        out = out + (u > total).cast("int")
    return texts.withColumn("gap_sec", out)
