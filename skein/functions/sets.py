"""Sets held in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_ids(col: Column | str) -> Column:
    """Distinct non-null ids of at least 0, ascending; null becomes an empty array."""
    c = F.col(col) if isinstance(col, str) else col
    kept = F.array_sort(F.array_distinct(F.filter(c, lambda x: x >= 0)))
    return F.coalesce(kept, F.expr("cast(array() as array<int>)"))


def record_sets(df: DataFrame, id_col: str, set_col: str, least: int = 1) -> DataFrame:
    """One row (id, ids) of each record with at least `least` ids.

    Null record ids are left out (they name no record). A redelivered record
    counts once; if its copies disagree, the smallest cleaned array stands, so
    the result doesn't depend on order. The aggregate combines on the map side:
    a record delivered a million times costs one row per map task.
    """
    cleaned = df.select(F.col(id_col).alias("id"), clean_ids(set_col).alias("ids")).where(
        F.col("id").isNotNull() & (F.size("ids") >= least)
    )
    return cleaned.groupBy("id").agg(F.min("ids").alias("ids"))


def jaccard(a: Column, b: Column) -> Column:
    """|A ∩ B| / |A ∪ B| of two arrays taken as sets; 0 if either is empty or null."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(ok, inter / union).otherwise(F.lit(0.0))
