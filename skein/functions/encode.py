"""Text encoders: a name, a dimension and a function from texts to rows of floats."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ENCODERS: dict[str, tuple[int, Callable[[list[str]], np.ndarray]]] = {}
_WORD = re.compile(r"\w+")


def register(name: str, dim: int, f: Callable[[list[str]], np.ndarray]) -> None:
    """Add an encoder; f gets non-null texts and returns (len, dim). A model can be put in the place of the hashing one."""
    _ENCODERS[name] = (dim, f)


def hashing(dim: int) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of lower-cased words and word pairs, unit length; a text without words is the zero vector."""

    def f(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            words = _WORD.findall(t.lower())
            for w in words + [a + " " + b for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                out[r, h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return f


register("hashing64", 64, hashing(64))


def encode(text: Column | str, name: str = "hashing64") -> Column:
    """Vectors of a text column, one Arrow batch at a time; null texts give null."""
    _, f = _ENCODERS[name]

    @F.pandas_udf("array<float>")
    def udf(s: pd.Series) -> pd.Series:
        known = [t for t in s if t is not None]
        rows = iter(f(known).astype(np.float32) if known else ())
        return pd.Series([None if t is None else next(rows) for t in s], index=s.index, dtype=object)

    return udf(text)


def chunk_size(n: int, workers: int = 8) -> int:
    """Texts in a chunk when n texts are spread over the workers (n // workers + 1)."""
    return n // workers + 1
