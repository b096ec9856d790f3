"""Vector functions, the vector codec, and a deterministic stand-in for an embedding model."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemosa.functions.text import col


VECTOR = T.ArrayType(T.FloatType())


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    v = col(v).cast("array<double>")
    return F.sqrt(_dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; 0 where the lengths differ, a vector is empty, null or all zero."""
    a, b = col(a).cast("array<double>"), col(b).cast("array<double>")
    length = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(usable, F.coalesce(F.try_divide(_dot(a, b), length), F.lit(0.0))).otherwise(F.lit(0.0))


def admissible(v: Column | str, model: Column | str, query: Column | str, query_model: Column | str) -> Column:
    """The vector where it can be compared with the query's: same length, and models equal or one unnamed; else null."""
    m, q = F.coalesce(col(model), F.lit("")), F.coalesce(col(query_model), F.lit(""))
    return F.when((F.size(v) == F.size(query)) & (F.size(v) > 0) & ((m == "") | (q == "") | (m == q)), col(v))


@F.pandas_udf(VECTOR)
def decode_vector(blobs: pd.Series) -> pd.Series:
    """Stored vectors: little-endian float32, or a JSON array; null where neither reads."""

    def one(b):
        if b is None or not len(b):
            return None
        if b[:1] == b"[" or len(b) % 4:
            try:
                return [float(x) for x in json.loads(b)]
            except (ValueError, TypeError):
                return None
        return np.frombuffer(b, "<f4").tolist()

    return blobs.map(one)


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian float32; an empty or null vector as no bytes."""
    return vectors.map(lambda v: b"" if v is None else np.asarray(v, "<f4").tobytes())


class Embedder(Protocol):
    """What turns texts into vectors. It runs on the workers, so it must pickle."""

    dimension: int
    model_name: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic unit vectors from hashed words and letter triples; for tests and work without a network."""

    def __init__(self, dimension: int = 64, model_name: str = "hash-embed"):
        self.dimension, self.model_name = dimension, model_name

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            low = (text or "").lower()
            for part in (*low.split(), *(low[j : j + 3] for j in range(max(0, len(low) - 2)))):
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1.0 if h >> 32 & 1 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0).tolist()


def check_embedder(embedder: Embedder) -> None:
    """Raises unless the embedder gives one finite vector of its dimension."""
    vectors = embedder.embed(["probe"])
    if len(vectors) != 1 or len(vectors[0]) != embedder.dimension or not np.isfinite(vectors[0]).all():
        raise ValueError(f"embedder {embedder.model_name} gives no finite vector of length {embedder.dimension}")


def embed_udf(embedder: Embedder, batch: int = 32) -> Callable[[Column | str], Column]:
    """A column function that embeds texts in batches; null for a null text."""

    @F.pandas_udf(VECTOR)
    def run(texts: pd.Series) -> pd.Series:
        there = texts[texts.notna()]
        vectors: list = []
        for at in range(0, len(there), batch):
            vectors += embedder.embed(there.iloc[at : at + batch].tolist())
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        for i, v in zip(there.index, vectors):
            out[i] = v
        return out

    return run


def backfill(facts: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """`facts` with vectors where they had none; the rest is untouched and isn't sent to the model."""
    embed = embed_udf(embedder)
    lacking = facts.filter(F.coalesce(F.size("embedding") <= 0, F.lit(True)))
    done = lacking.withColumn("embedding", embed(text)).withColumn("embedding_model", F.lit(embedder.model_name))
    return facts.filter(F.size("embedding") > 0).unionByName(done)


def reembed(facts: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """`facts` with all vectors made anew."""
    return facts.withColumn("embedding", embed_udf(embedder)(text)).withColumn("embedding_model", F.lit(embedder.model_name))
