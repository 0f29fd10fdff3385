"""Embeddings, cosine and layout."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from folioscope.functions.text import WORD

DIM = 128
_WORDS = re.compile(WORD)
_SLOTS = np.arange(16) * 11


def _hasher() -> Callable[[str | None], np.ndarray]:
    known: dict[str, np.ndarray] = {}

    def digest(w: str) -> np.ndarray:
        if w not in known:
            b = np.frombuffer(hashlib.sha256(w.encode()).digest()[:16], np.uint8).astype(np.int64)
            known[w] = np.bincount((_SLOTS + b) % DIM, weights=b, minlength=DIM)
        return known[w]

    def one(t: str | None) -> np.ndarray:
        out = np.zeros(DIM)
        for w in _WORDS.findall((t or "").lower()):
            out += digest(w)
        norm = math.sqrt(float(out @ out))
        return out / norm if norm else out

    return one


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """Unit vectors of hashed words. Each batch hashes a word once; built-in functions would deal out 16 rows a word."""
    return text.map(_hasher())


def embedding(text: Column | str, load: Callable[[], Callable[[str], Sequence[float]]] | None = None) -> Column:
    """Vectors of texts by a model, or by hashed words where there is none.

    load() makes the model, once in each task: a function from a text to its unit vector. If it can't be loaded all
    texts, and if it fails on a text that text, are hashed instead.
    """
    if load is None:
        return hash_embedding(text)

    @F.pandas_udf(ArrayType(DoubleType()))
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spare = _hasher()
        try:
            model = load()
        except Exception:
            model = spare

        def one(t: str | None) -> list[float]:
            try:
                return [float(x) for x in model(t or "")]
            except Exception:
                return spare(t).tolist()

        for texts in batches:
            yield texts.map(one)

    return encoded(text)


def embedded(text: str, load: Callable[[], Callable[[str], Sequence[float]]] | None = None) -> list[float]:
    """The vector of one text, as embedding() makes it."""
    try:
        return [float(x) for x in load()(text)] if load else _hasher()(text).tolist()
    except Exception:
        return _hasher()(text).tolist()


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequally long or zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def circle(i: Column, n: Column, cx: Column, cy: Column, r: Column, start: float) -> tuple[Column, Column]:
    """Place i (from 0) of n on a circle; the middle if it is alone."""
    angle = F.lit(start) + F.lit(2 * math.pi) * i / n
    return F.when(n == 1, cx).otherwise(cx + F.cos(angle) * r), F.when(n == 1, cy).otherwise(cy + F.sin(angle) * r)
