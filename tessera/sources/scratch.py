"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage, is read by several plans without being made twice, and survives a lost executor.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a step's shuffle files at its end, not once the driver's collector happens to find them unreachable.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver does all work, may do without."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tessera-local"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it belongs to the run around it, if there is one."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    if (run := _run.get()) is not None:
        run.paths.append(path)
    return path


class Tables:
    """The tables that one run of an operator or stage writes on its way: deleted at its end, but for those it keeps."""

    def __init__(self, spark: SparkSession, outer: Tables | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, *tables: DataFrame) -> None:
        """These outlast the run; a run around this one, if there is any, owns them from here on."""
        for t in tables:
            self.paths.remove(t._tessera_path)
            if self.outer is not None:
                self.outer.paths.append(t._tessera_path)

    def drop_later(self, df: DataFrame) -> None:
        """Delete a table that save() wrote before this run, too."""
        if path := getattr(df, "_tessera_path", None):
            self.paths.append(path)


_run: ContextVar[Tables | None] = ContextVar("run", default=None)


@contextlib.contextmanager
def kept_tables(spark: SparkSession) -> Iterator[Tables]:
    """A run: what save() writes inside is deleted at its end unless it is kept. Runs of several threads don't meet."""
    tables = Tables(spark, _run.get())
    token = _run.set(tables)
    try:
        yield tables
    finally:
        _run.reset(token)
        for path in tables.paths:
            remove(spark, path)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back."""
    spark = df.sparkSession
    path = fresh(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what save() wrote; for tables that no later plan reads."""
    remove(df.sparkSession, getattr(df, "_tessera_path", None))


def remove(spark: SparkSession, path: str | None) -> None:
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder, those that results not yet read still need among them."""
    remove(spark, f"{shared_folder(spark)}/tessera")
