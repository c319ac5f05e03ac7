"""Embedders: a protocol, a deterministic one made of token hashes, and how one is applied to a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.identifiers import identifier_tokens

#: Different words whose hashes a hashing embedder keeps.
KEPT_WORDS = 1 << 19


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A unit vector of token counts by hash, inside the JVM; a text without tokens is the first axis.  ``dim`` up to 256, a power of two."""
    if dim not in (2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("dim must be a power of two up to 256")
    slots = F.transform(identifier_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 31, 2), 16, 10).cast("int") % dim)
    axes = F.sequence(F.lit(0), F.lit(dim - 1))
    # one-element arrays bind an expression to a name, so that it is worked out once and not for every axis
    counts = F.get(F.transform(F.array(slots), lambda s: F.transform(axes, lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double"))), 0)
    axis = F.transform(axes, lambda i: (i == 0).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))
    pair = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.get(F.transform(pair, lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda c: c / p["n"])).otherwise(axis)), 0)


class HashEmbedder:
    """Counts of hashed words, normalised: no model, the same everywhere."""

    model_id = "hash-384"

    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return self.vectors(texts).tolist()

    def vectors(self, texts: Sequence[str]) -> np.ndarray:
        """The same as a matrix; each different word is hashed once."""
        import hashlib

        known, at = self.__dict__.setdefault("_known", {}), []
        for i, text in enumerate(texts):
            first = i * self.dim
            for w in text.lower().split():
                if (slot := known.get(w)) is None:
                    slot = known[w] = int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dim
                at.append(first + slot)
            if len(known) > KEPT_WORDS:
                known.clear()
        out = np.bincount(np.array(at, np.int64), minlength=len(texts) * self.dim).astype(float).reshape(len(texts), self.dim)
        out[~out.any(axis=1), 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


def embed(df: DataFrame, embedder: Embedder, keep: Sequence[str], text_col: str, batch: int = 64, prefix: str = "") -> DataFrame:
    """``(*keep, embedding)``; the embedder is made once per worker process batch and fed ``batch`` texts at a time.

    An embedder that has ``vectors``, a matrix for some texts, is asked for those.
    """
    matrix = getattr(embedder, "vectors", None)

    def one(texts: list[str]) -> pa.Array:
        if matrix is None:
            return pa.array(embedder.embed_documents(texts), pa.list_(pa.float64()))
        rows = matrix(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [prefix + (t or "") for t in b.column("_text").to_pylist()]
            vectors = [one(texts[lo : lo + batch]) for lo in range(0, len(texts), batch)]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.concat_arrays(vectors) if vectors else pa.array([], pa.list_(pa.float64()))], [*keep, "embedding"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{types}, embedding array<double>")
