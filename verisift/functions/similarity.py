"""Sentence vectors and the repetition checks over a claim's history.

Cosines are computed in double precision by native array functions over vectors that were encoded once.
A threshold is exceeded only by a strictly larger cosine.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from string import ascii_lowercase
from typing import Protocol
from zlib import crc32

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.9
DIMENSIONS = 256


class Encoder(Protocol):
    """Gives a vector for each text."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashedNgrams:
    """Deterministic offline encoder: counts of hashed character 3-grams of words, divided by their length."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def _vector(self, text: str) -> list[float]:
        counts = [0.0] * self.dimensions
        for word in re.findall(r"\w+", text.lower()):
            padded = f" {word} "
            for i in range(len(padded) - 2):
                counts[crc32(padded[i : i + 3].encode()) % self.dimensions] += 1.0
        norm = math.sqrt(sum(c * c for c in counts))
        return [c / norm for c in counts] if norm else counts


class LetterCounts:
    """How often each of the letters a to z stands in a text, in either case: an encoder that SQL can repeat."""

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [[float(t.count(c) + t.count(c.upper())) for c in ascii_lowercase] for t in texts]


class SentenceTransformerEncoder:
    """A sentence-transformers model, loaded once in each worker."""

    def __init__(self, model: str = "sentence-transformers/all-MiniLM-L6-v2") -> None:
        self.name, self._model = model, None

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name)
        return self._model.encode(texts).tolist()

    def __getstate__(self) -> dict:
        return {"name": self.name, "_model": None}


def encode(text: Column, encoder: Encoder) -> Column:
    """Vector of a text; null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            given = batch.notna()
            vectors = iter(encoder.encode(batch[given].tolist()) if given.any() else [])
            yield pd.Series([next(vectors) if ok else None for ok in given], dtype=object)

    return run(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where one of them is 0."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def count_similar(vector: Column, history: Column, threshold: float = THRESHOLD) -> Column:
    """How many vectors of ``history`` have a larger cosine than ``threshold`` with ``vector``; 0 for none."""
    return F.coalesce(F.size(F.filter(history, lambda h: cosine(h, vector) > F.lit(threshold))), F.lit(0))


def last(history: Column, skip: int, count: int) -> Column:
    """``count`` elements of an array that end ``skip`` before its end; empty if there are not so many."""
    if count <= 0:
        return F.slice(history, 1, 0)
    enough = F.size(history) >= skip + count
    start = F.when(enough, F.size(history) - (skip + count) + 1).otherwise(1)
    return F.slice(history, start, F.when(enough, count).otherwise(0))


def repeats_query(query: Column, queries: Column, tolerance: int, threshold: float = THRESHOLD) -> Column:
    """Whether the proposed query is like each of the last ``tolerance - 1`` queries (vectors)."""
    n = tolerance - 1
    return (F.size(queries) >= n) & (count_similar(query, last(queries, 0, n), threshold) >= n)


def repeats_evidence(results: Column, tolerance: int, threshold: float = THRESHOLD) -> Column:
    """Whether the last result is like each of the ``tolerance - 1`` before it (vectors)."""
    n = tolerance - 1
    newest = F.get(results, F.size(results) - 1)
    return (F.size(results) >= tolerance) & (count_similar(newest, last(results, 1, n), threshold) >= n)


def similar_lately(history: Column, tolerance: int, threshold: float = THRESHOLD) -> Column:
    """Whether the newest element is like each of the ``tolerance - 2`` before it: the condition of a
    hint. With a tolerance of 2 nothing is compared, and one element is enough."""
    n = tolerance - 2
    newest = F.get(history, F.size(history) - 1)
    return (F.size(history) >= tolerance - 1) & (count_similar(newest, last(history, 1, n), threshold) >= n)
