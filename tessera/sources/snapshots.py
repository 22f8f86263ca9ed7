"""A mutable table over immutable files: each change writes a new folder, then publishes a manifest that names it.

A version is its manifest: the folders that hold its rows. Folders have unique names, so writers never touch each
other's files; a manifest is created only if its number is free, so of two writers one wins and the other fails whole.
Readers see the version before or the one after, never a mixture. Every file operation goes through Hadoop's
FileSystem: the root may be local, HDFS or an object store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Marks the rows that a change meets while they pass.
HIT = "__hit"


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame | StructType) -> SnapshotTable:
        table = cls(spark, root)
        if table.versions():
            raise ValueError(f"a table exists at {root}")
        rows = spark.createDataFrame([], rows) if isinstance(rows, StructType) else rows
        folder = table._write(rows, [])
        table._publish(0, [folder], table._count(folder, rows.schema), rows.schema, [])
        return table

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._manifest(version))

    def insert(self, rows: DataFrame, columns: Sequence[str] | None = None) -> int:
        """Append; returns the number of rows. Only the new rows are written.

        columns: the names that the rows' columns go to, others become NULL; without it the number must match, as for SQL INSERT.
        """
        now = self._manifest()
        schema = StructType.fromJson(now["schema"])
        known = {f.name.lower(): f.name for f in schema}
        names = schema.names if columns is None else [known.get(c.lower()) for c in columns]
        if None in names or len(set(names)) < len(names):
            raise ValueError(f"insert names unknown or repeated columns: {list(columns or [])}")
        if len(rows.columns) != len(names):
            raise ValueError(f"insert has {len(rows.columns)} columns for {len(names)}")
        given = rows.toDF(*names)
        typed = given.select(*[(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        folder = self._write(typed, now["sorted"])
        n = self._count(folder, schema)
        self._publish(now["version"], [*now["folders"], folder], now["rows"] + n, schema, now["sorted"])
        return n

    def update(self, predicate: Column, changes: Mapping[str, object], alias: str = "t") -> int:
        """Set columns where the predicate is true; a NULL predicate leaves the row. Returns the changed rows.

        alias: what column references may call the table.
        """
        schema = self.read().schema
        known = {f.name.lower(): f.name for f in schema}
        if unknown := {c for c in changes if c.lower() not in known}:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        changes = {known[c.lower()]: v for c, v in changes.items()}
        now = self._manifest()
        rows = update_rows(self._marked(now, predicate, alias), F.col(HIT), changes)
        seen = Observation()
        # counted behind the exchange, whose sampling runs what lies before it twice
        watched = self._ranged(rows, now["sorted"]).observe(seen, F.sum(F.col(HIT).cast("bigint")).alias("n"))
        folder = self._write(watched.drop(HIT), now["sorted"], ranged=True)
        self._publish(now["version"], [folder], now["rows"], schema, now["sorted"])
        return seen.get["n"] or 0 if now["rows"] else 0

    def delete(self, predicate: Column, alias: str = "t") -> int:
        """Remove the rows for which the predicate is true; returns their number."""
        now = self._manifest()
        schema = StructType.fromJson(now["schema"])
        folder = self._write(delete_rows(self._marked(now, predicate, alias), F.col(HIT)).drop(HIT), now["sorted"])
        left = self._count(folder, schema)
        self._publish(now["version"], [folder], left, schema, now["sorted"])
        return now["rows"] - left

    def sort_by(self, *columns: str) -> None:
        """The counterpart of an index: files hold ranges of these columns, in order, so that a lookup reads few row
        groups. Later inserts and changes keep to it."""
        now = self._manifest()
        schema = StructType.fromJson(now["schema"])
        known = {f.name.lower(): f.name for f in schema}
        if unknown := [c for c in columns if c.lower() not in known]:
            raise ValueError(f"unknown columns: {unknown}")
        order = [known[c.lower()] for c in columns]
        self._publish(now["version"], [self._write(self._rows(now), order)], now["rows"], schema, order)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove all but the newest versions; manifests go first, so no reader picks a half-deleted one. Claims and drafts
        of writers that died go too: run it while no one writes."""
        known = self.versions()
        old, rest = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
        used = {f for v in rest for f in self._manifest(v)["folders"]}
        gone = {f for v in old for f in self._manifest(v)["folders"]} - used
        for v in old:
            self._fs.delete(self._path(f"{self.root}/v{v}.json"), False)
        for entry in self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []:
            if entry.getPath().getName().startswith(("claim-", "draft-")):
                self._fs.delete(entry.getPath(), False)
        for folder in sorted(gone):
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        return old

    def destroy(self) -> None:
        self.vacuum(keep=0)
        self._fs.delete(self._path(self.root), True)

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {'' if version is None else version} at {self.root}")
        number = known[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.root}/v{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*[f"{self.root}/{f}" for f in manifest["folders"]])

    def _marked(self, manifest: dict, predicate: Column, alias: str) -> DataFrame:
        return self._rows(manifest).alias(alias).select("*", F.coalesce(predicate, F.lit(False)).alias(HIT))

    def _count(self, folder: str, schema: StructType) -> int:
        """Rows of a written folder; Spark reads no column for it."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").count()

    def _ranged(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        return rows.repartitionByRange(*[F.col(f"`{c}`") for c in order]) if order else rows

    def _write(self, rows: DataFrame, order: Sequence[str], ranged: bool = False) -> str:
        if order:
            rows = (rows if ranged else self._ranged(rows, order)).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def _publish(self, before: int, folders: list[str], rows: int, schema: StructType, order: Sequence[str]) -> None:
        """Version before + 1, if no other writer has published it since `before` was read."""
        version = before + 1
        manifest = json.dumps({"version": version, "folders": folders, "rows": rows, "schema": schema.jsonValue(), "sorted": list(order)})
        draft = self._path(f"{self.root}/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(manifest.encode())
        stream.close()
        target, claim = self._path(f"{self.root}/v{version}.json"), self._path(f"{self.root}/claim-{version}")
        # the claim decides between writers, and only who holds it looks for a manifest: one published since then is seen
        claimed = self._fs.createNewFile(claim)
        published = claimed and version not in self.versions() and self._fs.rename(draft, target)  # a whole manifest appears at once
        if claimed:
            self._fs.delete(claim, False)
        if not published:
            self._fs.delete(draft, False)
            self._fs.delete(self._path(f"{self.root}/{folders[-1]}"), True)
            raise RuntimeError(f"version {version} was published by another writer")


def update_rows(df: DataFrame, predicate: Column, changes: Mapping[str, object]) -> DataFrame:
    """The rows after UPDATE, as a projection; all new values see the old row."""
    hit = F.coalesce(predicate, F.lit(False))
    types = {f.name: f.dataType for f in df.schema}
    new = {c: F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(types[c])).otherwise(F.col(c)) for c, v in changes.items()}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def delete_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows that DELETE leaves; a NULL predicate keeps the row."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
