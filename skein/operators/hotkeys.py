"""Per-key results where a few keys hold most records (problem 2).

Each input split encodes its keys with a dictionary of its own and adds its
records into dense arrays indexed by code (numpy bincount), so a split's work
depends on its rows only, not on how they spread over keys. What leaves a split
is one entry per key it saw, in blocks of the key space; the blocks are summed
in two levels, so no task gets more than about the square root of the number of
splits times one block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.runtime import materialize, width

#: Blocks of the key space.
BLOCKS = 64
#: Record ids in one row of postings().
CHUNK = 4096
#: Block of the number of records.
TOTAL = -1
#: Rows collected before a split's arrays are brought up to date.
STEP = 200_000


def _block(keys: np.ndarray) -> np.ndarray:
    if keys.dtype.kind in "iu":
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BLOCKS
    return np.array([zlib.crc32(str(k).encode()) % BLOCKS for k in keys], dtype=np.int64)


class _Dense:
    """Arrays count, sum, low and high by code of a growing dictionary."""

    def __init__(self) -> None:
        self.keys = None
        self.arrays = (np.zeros(0, np.int64),) * 4

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        local, code = np.unique(keys, return_inverse=True)
        n = len(local)
        if not n:
            return
        count = np.bincount(code, minlength=n).astype(np.int64)
        order = np.argsort(code, kind="stable")
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        v = ids[order]
        self.merge(local, count, np.add.reduceat(v, at), np.minimum.reduceat(v, at), np.maximum.reduceat(v, at))

    def merge(self, keys: np.ndarray, *arrays: np.ndarray) -> None:
        if self.keys is None:
            allkeys, parts = keys, arrays
        else:
            allkeys = np.concatenate([self.keys, keys])
            parts = [np.concatenate(x) for x in zip(self.arrays, arrays, strict=True)]
        dic, code = np.unique(allkeys, return_inverse=True)
        top = np.iinfo(np.int64)
        out = (np.zeros(len(dic), np.int64), np.zeros(len(dic), np.int64), np.full(len(dic), top.max), np.full(len(dic), top.min))
        for ufunc, o, p in zip((np.add, np.add, np.minimum, np.maximum), out, parts, strict=True):
            ufunc.at(o, code, p)
        self.keys, self.arrays = dic, out


def per_key(records: DataFrame, id_col: str = "id", keys_col: str = "ids") -> DataFrame:
    """Rows (key, n, id_sum, id_min, id_max) for each key of an array column.

    records: one row per record, `keys_col` an array of distinct keys, `id_col`
    BIGINT. Null or empty arrays and null elements add nothing; the row with a
    null key holds the number of records with at least one key. An empty table
    gives that row alone, with n = 0. Sums wrap at 64 bits.
    """
    spark = records.sparkSession
    key_type = records.schema[keys_col].dataType.elementType
    fields = [("block", "int"), ("lane", "int"), ("keys", f"array<{key_type.simpleString()}>")] + [(c, "array<bigint>") for c in ("n", "s", "lo", "hi")]
    schema = ", ".join(f"{a} {b}" for a, b in fields)
    lanes = max(1, round(max(1, width(spark)) ** 0.5))

    def blocks(acc: _Dense, total: int, lane: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"block": [TOTAL], "lane": [lane], "keys": [[]], **{c: [[total]] for c in ("n", "s", "lo", "hi")}})
        if acc.keys is not None:
            b = _block(acc.keys)
            for x in np.unique(b):
                m = b == x
                yield pd.DataFrame({"block": [x], "lane": [lane], "keys": [acc.keys[m]], **{c: [a[m]] for c, a in zip(("n", "s", "lo", "hi"), acc.arrays, strict=True)}})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc, total, kk, ii, held = _Dense(), 0, [], [], 0
        for b in batches:
            lists = b.column(1)
            n = np.asarray(lists.value_lengths().fill_null(0))
            flat, rows = lists.flatten(), np.repeat(np.asarray(b.column(0).fill_null(0)), n)
            ok = np.asarray(flat.is_valid())
            total += int((n > 0).sum())
            kk.append(flat.to_numpy(zero_copy_only=False)[ok])
            ii.append(rows[ok])
            held += len(rows)
            if held >= STEP * 5:
                acc.add(np.concatenate(kk), np.concatenate(ii))
                kk, ii, held = [], [], 0
        if held:
            acc.add(np.concatenate(kk), np.concatenate(ii))
        for pdf in blocks(acc, total, TaskContext.get().partitionId() % lanes):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    def reduce(last: bool):
        def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            if key[0] == TOTAL:
                t = int(sum(x[0] for x in pdf["n"]))
                return next(blocks(_Dense(), t, 0)) if not last else pd.DataFrame({"key": [None], "n": [t], "id_sum": [None], "id_min": [None], "id_max": [None]})
            acc = _Dense()
            acc.merge(*(np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("keys", "n", "s", "lo", "hi")))
            if last:
                return pd.DataFrame(dict(zip(("key", "n", "id_sum", "id_min", "id_max"), (acc.keys, *acc.arrays), strict=True)))
            return pd.DataFrame({"block": [key[0]], "lane": [0], "keys": [acc.keys], **{c: [a] for c, a in zip(("n", "s", "lo", "hi"), acc.arrays, strict=True)}})

        return f

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    out = f"key {key_type.simpleString()}, n bigint, id_sum bigint, id_min bigint, id_max bigint"
    return (
        records.select(F.col(id_col).cast("bigint"), keys_col)
        .mapInArrow(split, schema)
        .groupBy("block", "lane")
        .applyInPandas(reduce(False), schema)
        .groupBy("block")
        .applyInPandas(reduce(True), out)
    )


def frequent_keys(records: DataFrame, share: float, id_col: str = "id", keys_col: str = "ids") -> DataFrame:
    """Rows (key, n, total) of the keys in at least `share` of the records that have any key."""
    counts = materialize(per_key(records, id_col, keys_col), "per_key")
    row = counts.where(F.col("key").isNull()).select("n").first()
    total = row["n"] if row else 0
    return counts.where(F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * F.lit(total)) & (F.lit(total) > 0)).select("key", "n", F.lit(total).cast("bigint").alias("total"))


def postings(records: DataFrame, id_col: str = "id", keys_col: str = "ids") -> DataFrame:
    """The records of every key, in rows (key, part, n, record_ids) of at most CHUNK ids.

    Lists stay where their records lie: `part` numbers the rows of a key within
    one split. A key of half of all records is spread over all splits, and no
    row, task or group grows with it.
    """
    key_type = records.schema[keys_col].dataType.elementType.simpleString()
    schema = f"key {key_type}, part bigint, n int, record_ids array<bigint>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        part = 0
        kk, ii, held = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal part
            k, i = np.concatenate(kk), np.concatenate(ii)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            at = np.flatnonzero(new)
            rank = np.arange(len(k)) - np.repeat(at, np.diff(np.append(at, len(k))))
            starts = np.flatnonzero(new | (rank % CHUNK == 0))
            n = np.diff(np.append(starts, len(k)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(k)), pa.int32()), pa.array(i, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(k[starts]).cast(arrow[0].type), pa.array(base + part + np.arange(len(starts))), pa.array(n.astype(np.int32)), lists], schema=arrow)
            part += len(starts)

        for b in batches:
            lists = b.column(1)
            n = np.asarray(lists.value_lengths().fill_null(0))
            flat, rows = lists.flatten(), np.repeat(np.asarray(b.column(0)), n)
            ok = np.asarray(flat.is_valid())
            kk.append(flat.to_numpy(zero_copy_only=False)[ok])
            ii.append(rows[ok])
            held += len(rows)
            if held >= STEP * 5:
                yield from emit()
                kk, ii, held = [], [], 0
        if held:
            yield from emit()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    return records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), keys_col).mapInArrow(split, schema)
