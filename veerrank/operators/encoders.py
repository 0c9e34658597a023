"""Encoders of texts: what one is, those that are known by name, and one that needs no weights."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Makes unit vectors of texts, as an Arrow function of a text column."""

    dim: int

    def encode(self, text: Column) -> Column: ...


class HashedWords:
    """Counts of hashed words with signs, normalised: no weights, the same everywhere; null and blank texts are zero vectors."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<float>")
        def apply(texts: pd.Series) -> pd.Series:
            import xxhash

            out = np.zeros((len(texts), dim), np.float32)
            for row, value in enumerate(texts):
                for word in (value or "").lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    out[row, h % dim] += 1 if h >> 63 else -1
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return pd.Series(list(out / np.where(size > 0, size, 1)))

        return apply(text)


#: Encoders by name; others are added by register().
ENCODERS: dict[str, Callable[[], Encoder]] = {"hashed_words": HashedWords}


def register(name: str, make: Callable[[], Encoder]) -> None:
    ENCODERS[name] = make


def encoder(name: str) -> Encoder:
    """The encoder that is registered by this name, else the one whose name the given one holds."""
    found = [n for n in ENCODERS if n == name] or [n for n in ENCODERS if n in name.lower()]
    if not found:
        raise ValueError(f"unknown encoder {name!r}; known: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[found[0]]()


def encoded(texts: DataFrame, name: str) -> DataFrame:
    """id and embedding of texts (id, text), each distinct text once."""
    once = texts.select("text").distinct()
    vectors = once.withColumn("embedding", encoder(name).encode(F.col("text")))
    return texts.join(vectors, texts.text.eqNullSafe(vectors.text)).select("id", "embedding")


def prepared(rows: DataFrame, name: str) -> DataFrame:
    """idx, role, sub_idx and embedding of training texts (idx, role, sub_idx, text): what a trainer reads."""
    keyed = rows.withColumn("id", F.struct("idx", "role", "sub_idx"))
    return encoded(keyed, name).select("id.*", "embedding")
