"""Statement router: Spark parses and plans everything; changes of tables become snapshots.

CREATE TABLE maps a bare VARCHAR to STRING. Names are compared without case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.snapshots import SnapshotTable

CREATE = re.compile(r"\s*CREATE\s+TABLE\s+(\w+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
TRANSACTION = re.compile(r"\s*(BEGIN|START\s+TRANSACTION|COMMIT|ROLLBACK|ABORT)\b[\s\w]*;?\s*$", re.I)
#: Parsed statements that change tables or files and have no form here.
REFUSED = ("InsertInto", "MergeInto", "Truncate", "Load", "Replace", "Alter", "CreateTable", "DropTable", "UpdateTable", "DeleteFrom", "Overwrite", "Append", "CompoundBody")


class SqlEngine:
    """Tables live under `root` as snapshots, those of earlier engines too, and are seen by queries as temporary views of their newest version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, SnapshotTable] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in fs.listStatus(path) if fs.exists(path) else []:
            name = entry.getPath().getName()
            if entry.isDirectory() and (table := SnapshotTable(spark, f"{self.root}/{name}")).versions():
                self.tables[name] = table
                self._show(name)

    def execute(self, statement: str) -> DataFrame:
        """SELECT gives its rows; changes give one row with their count; DDL gives no rows."""
        if m := CREATE.match(statement):
            return self._create(m[1].lower(), m[2])
        if m := TRANSACTION.match(statement):
            raise ValueError(f"{m[1].upper()}: there are no transactions; each statement publishes a snapshot of its own")
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        kind = plan.getClass().getSimpleName()
        if kind == "InsertIntoStatement" and not plan.overwrite():
            name = self._named(plan.table())
            columns = _list(plan.userSpecifiedCols())
            return self._changed(name, self._table(name).insert(self._rows(plan.query()), columns or None))
        if kind == "UpdateTable":
            name, alias = self._named(plan.table()), _alias(plan.table())
            sets = {_list(a.key().nameParts())[-1]: self._column(a.value()) for a in _list(plan.assignments())}
            where = self._column(plan.condition().get()) if plan.condition().isDefined() else F.lit(True)
            return self._changed(name, self._table(name).update(where, sets, alias or name))
        if kind == "DeleteFromTable":
            name, alias = self._named(plan.table()), _alias(plan.table())
            return self._changed(name, self._table(name).delete(self._column(plan.condition()), alias or name))
        if kind == "DropTable" and (name := self._named(plan.child(), must=False)) in self.tables:
            self.spark.catalog.dropTempView(name)
            self.tables.pop(name).destroy()
            return self._nothing()
        if kind == "CreateIndex":
            name = self._named(plan.table())
            self._table(name).sort_by(*[_list(c._1().name())[-1] for c in _list(plan.columns())])
            self._show(name)
            return self._nothing()
        if refused := [k for k in _kinds(plan) if k.startswith(REFUSED)]:
            raise ValueError(f"{refused[0]} is not supported here, or its table is unknown")
        return self.spark.sql(statement.strip().rstrip(";"))

    def _create(self, name: str, columns: str) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"table {name} already exists")
        schema = StructType.fromDDL(re.sub(r"\bVARCHAR\b(?!\s*\()", "STRING", columns, flags=re.I))
        self.tables[name] = SnapshotTable.create(self.spark, f"{self.root}/{name}", schema)
        self._show(name)
        return self._nothing()

    def _named(self, relation, must: bool = True) -> str:
        """The table that a parsed relation names."""
        while (kind := relation.getClass().getSimpleName()) == "SubqueryAlias":
            relation = relation.child()
        if kind not in ("UnresolvedRelation", "UnresolvedTable", "UnresolvedIdentifier"):
            raise ValueError(f"{kind} is no table's name")
        name = ".".join(_list(relation.nameParts() if kind == "UnresolvedIdentifier" else relation.multipartIdentifier())).lower()
        if must and name not in self.tables:
            raise ValueError(f"table {name} not found")
        return name

    def _table(self, name: str) -> SnapshotTable:
        return self.tables[name]

    def _rows(self, plan) -> DataFrame:
        made = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        return DataFrame(made, self.spark)

    def _column(self, expression) -> Column:
        return Column(self.spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def _show(self, name: str) -> None:
        self.tables[name].read().createOrReplaceTempView(name)

    def _changed(self, name: str, n: int) -> DataFrame:
        self._show(name)
        return self.spark.createDataFrame([(n,)], "cnt bigint")

    def _nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "cnt bigint")


def _alias(relation) -> str | None:
    return relation.alias() if relation.getClass().getSimpleName() == "SubqueryAlias" else None


def _list(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def _kinds(plan) -> list[str]:
    """Class names of a parsed plan, from the top."""
    return [plan.getClass().getSimpleName(), *[k for c in _list(plan.children()) for k in _kinds(c)]]
