"""Versioned tables: new files beside the old ones become current by one small version file.

Tables with keys lie in ``PARTS`` parts by the hash of their key; a merge reads and writes only the parts it touches.  Versions are
numbered files that are never replaced: the highest number is current, and of two writers of one number the second fails and
changes nothing.  A run that dies leaves the old version current, so no write-ahead record is needed.  All access goes through the
Hadoop file system of the index's path.  ``expected`` metadata guards a reader against an index made with another model or chunker.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import FileSystem

CHUNKER_VERSION = "1"
PARTS = 64


class IndexMismatchError(Exception):
    """The index was made with other settings than the reader's."""


class ConcurrentCommitError(Exception):
    """Another writer made the same version first; nothing was changed, read again and repeat."""


@dataclass(frozen=True)
class Merge:
    """Rows to put in place of those with the same keys, and keys whose rows go."""

    rows: DataFrame
    keys: Sequence[str]
    gone: DataFrame | None = None


def _part(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


class VersionedTables:
    """Tables of one index under a directory on a file system that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = FileSystem(spark, self.root)

    def current(self) -> dict | None:
        for name in sorted(self.files.names(f"{self.root}/versions"), reverse=True):
            try:
                return json.loads(self.files.read(f"{self.root}/versions/{name}"))
            except ValueError:  # a version whose writer died while it wrote it
                continue
        return None

    def is_built(self) -> bool:
        return self.current() is not None

    def check(self, **expected: str) -> None:
        """Raise if a value of the index's metadata differs from what is expected."""
        state = self.current()
        for key, value in expected.items():
            if state and state["meta"].get(key) != value:
                raise IndexMismatchError(f"{key} is {state['meta'].get(key)!r}, not {value!r}; build the index anew")

    def has(self, name: str) -> bool:
        state = self.current()
        return bool(state and name in state["tables"])

    def read(self, name: str) -> DataFrame:
        state = self.current()
        if not state or name not in state["tables"]:
            raise FileNotFoundError(f"{self.root} has no table {name}")
        return self._rows(state["tables"][name])

    def _rows(self, table: dict, parts: Sequence[str] | None = None) -> DataFrame:
        places = [p for k, p in table["parts"].items() if parts is None or k in parts]
        if not places:
            return self.spark.createDataFrame([], table["schema"])
        return self.spark.read.schema(table["schema"]).parquet(*[f"{self.root}/{p}" for p in places])

    def commit(self, tables: Mapping[str, DataFrame | Merge], meta: Mapping[str, str] | None = None) -> int:
        """Write new versions of some tables and make them current together; the others stay.  Returns the version."""
        state = self.current() or {"version": 0, "tables": {}, "meta": {}}
        version, places = state["version"] + 1, dict(state["tables"])
        for name, new in tables.items():
            folder = f"{name}/v{version:08d}-{uuid.uuid4().hex[:8]}"
            if isinstance(new, Merge):
                places[name] = self._merge(places.get(name), new, folder)
            else:
                new.write.parquet(f"{self.root}/{folder}")
                places[name] = {"schema": _ddl(new), "parts": {"all": folder}}
        fresh = {"version": version, "tables": places, "meta": {**state["meta"], **(meta or {})}}
        if not self.files.create(f"{self.root}/versions/{version:08d}.json", json.dumps(fresh)):
            raise ConcurrentCommitError(f"{self.root}: version {version} was made by another writer")
        return version

    def _merge(self, table: dict | None, new: Merge, folder: str) -> dict:
        keys = list(new.keys)
        if table and "all" in table["parts"]:
            raise ValueError("the table was written without keys; write it as a whole")
        changed = new.rows.select(*keys)
        if new.gone is not None:
            changed = changed.unionByName(new.gone.select(*keys))
        touched = sorted(str(r["p"]) for r in changed.select(_part(keys).alias("p")).distinct().collect())  # at most PARTS
        rows = new.rows
        if table:
            stay = self._rows(table, touched).join(changed.distinct(), keys, "left_anti")
            rows = stay.select(rows.columns).unionByName(rows)
        rows.withColumn("_part", _part(keys)).repartition(min(PARTS, max(1, len(touched))), "_part").write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        written = {n.removeprefix("_part="): f"{folder}/{n}" for n in self.files.names(f"{self.root}/{folder}") if n.startswith("_part=")}
        kept = {k: p for k, p in (table["parts"] if table else {}).items() if k not in touched}
        return {"schema": _ddl(new.rows), "parts": {**kept, **written}}


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
