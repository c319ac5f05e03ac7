"""Stored vectors of chunks: rows added, replaced and removed by id, and searched exactly."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame

from quillon.operators.search import cosine
from quillon.sources.tables import Merge, VersionedTables


class VectorStore(Protocol):
    def upsert(self, rows: DataFrame) -> None: ...

    def delete(self, ids: DataFrame) -> None: ...

    def count(self) -> int: ...

    def query(self, queries: DataFrame, k: int, only_paths: DataFrame | None = None) -> DataFrame: ...


class VectorTable:
    """Vectors ``(id, path, embedding)`` as one versioned table; all vectors have the same length."""

    def __init__(self, tables: VersionedTables, dim: int, name: str = "vectors"):
        self.tables, self.dim, self.name = tables, dim, name

    def _has(self) -> bool:
        return self.tables.has(self.name)

    def upsert(self, rows: DataFrame) -> None:
        wrong = rows.where(f"embedding is null or size(embedding) <> {self.dim}").limit(1).collect()
        if wrong:
            raise ValueError(f"vector of {wrong[0]['id']!r} is not of length {self.dim}")
        self.tables.commit({self.name: Merge(rows.select("id", "path", "embedding"), ["id"])})

    def delete(self, ids: DataFrame) -> None:
        if self._has():
            self.tables.commit({self.name: Merge(self.tables.read(self.name).limit(0), ["id"], ids.select("id"))})

    def count(self) -> int:
        return self.tables.read(self.name).count() if self._has() else 0

    def query(self, queries: DataFrame, k: int, only_paths: DataFrame | None = None) -> DataFrame:
        """The nearest ``k`` of each query; paths are kept before the search, and no paths give no hits."""
        rows = self.tables.read(self.name)
        if only_paths is not None:
            rows = rows.join(only_paths.select("path").distinct(), "path", "left_semi")
        return cosine(rows, queries, k, id_col="id")
