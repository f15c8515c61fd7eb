"""Forms of the result log: text of numbers, sizes, names of topics and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double")))


def percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.3f%%", c.cast("double") * 100))


def whole_mb(size: Column) -> Column:
    """Bytes as whole megabytes, cut off."""
    return F.floor(size / F.lit(1048576)).cast("int")


def parse_percent(c: Column | str) -> Column:
    """'66.667%' -> 0.66667; null, blank and other text give null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)%\s*$", 1).try_cast("double") / 100


def topic_of(dataset: Column | str, same: str = "hotpotqa") -> Column:
    """Topic of a dataset: its own name for `same`, otherwise the name with _query; trimmed and in lower case."""
    c = F.lower(F.trim(F.col(dataset) if isinstance(dataset, str) else dataset))
    return F.when(c == same, c).when(c != "", F.concat(c, F.lit("_query")))
