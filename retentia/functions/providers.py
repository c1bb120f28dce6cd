"""Pluggable encoder, judge and reader with deterministic offline defaults.

An external model takes the place of a default by a function of the same shape; the pandas forms load it once a worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators.lexical import words


_WORD = re.compile("[a-z0-9]+")


def hashed_text(text: str | None, numbers: dict[str, int], dim: int) -> np.ndarray:
    """Signed feature hashing of a text's words; `numbers` keeps what words hash to."""
    at = []
    for w in _WORD.findall((text or "").lower()):
        h = numbers.get(w)
        if h is None:
            h = numbers[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
        at.append(h)
    h = np.array(at, dtype=np.int64)
    return np.bincount(h % dim, weights=1.0 - 2.0 * (h // dim % 2), minlength=dim) if len(h) else np.zeros(dim)


def hashing_vector(text: Column, dim: int = 64, unit: bool = False) -> Column:
    """The offline encoder: array<double> of `dim` values, zeros without words, scaled to length 1 with `unit`."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers: dict[str, int] = {}
        for batch in batches:
            if len(numbers) > 1 << 20:
                numbers.clear()
            out = []
            for body in batch:
                v = hashed_text(body, numbers, dim)
                norm = float(np.sqrt(v @ v))
                out.append(v / norm if unit and norm > 0 else v)
            yield pd.Series(out, index=batch.index, dtype=object)

    return encode(text)


def lexical_verdict(answer: Column, truth: Column, threshold: float = 0.5) -> Column:
    """YES where the share of the truth's different words in the answer reaches `threshold`, NEUTRAL without truth."""
    t, a = F.array_distinct(words(truth)), words(answer)
    share = F.size(F.array_intersect(t, a)) / F.size(t)
    return F.when(F.size(t) == 0, "NEUTRAL").when(share >= threshold, "YES").otherwise("NO")


def with_encoder(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "vector") -> DataFrame:
    """Adds the vectors of an external encoder; `load` runs once a worker, missing texts give null."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            known = batch.dropna()
            for i, v in zip(known.index, encoder(known.tolist())):
                out.at[i] = v
            yield out

    return df.withColumn(name, encode(F.col(text)))
