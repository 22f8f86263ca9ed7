"""Scans and literal rows. Files are read by Spark's own readers, so pruning and pushdown reach them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scan(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Sequential scan of DIRECTORY/TABLE.parquet (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{table}.parquet")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """Any format that Spark reads. Pass a schema for CSV and JSON; inferring one costs a pass over the data."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def register(spark: SparkSession, directory: str, tables: Iterable[str] = TABLES) -> None:
    """Temporary views for SQL, one for each table."""
    for table in tables:
        scan(spark, directory, table).createOrReplaceTempView(table)


def values(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Literal rows as a relation."""
    return spark.createDataFrame(list(rows), schema)


def point_lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    """All rows with the value (typed comparison). On Parquet the predicate is pushed to row-group statistics."""
    return df.where(F.col(column) == F.lit(value))


def range_lookup(df: DataFrame, column: str, low: object) -> DataFrame:
    """Rows at or above low, in ascending order of the column."""
    return df.where(F.col(column) >= F.lit(low)).orderBy(column)


def employees(spark: SparkSession, rows: int, with_role: bool = False) -> DataFrame:
    """The benchmark table: a deterministic function of the row number, made on the executors."""
    i = F.col("id")
    columns = {
        "id": i,
        "age": i % 70 + 20,
        "salary": (i * 13) % 200000,
        "department_id": i % 20,
        "bonus": (i * 7) % 50000,
    }
    df = spark.range(rows).select(*[c.cast("int").alias(name) for name, c in columns.items()], *([((i * 17) % 1000).alias("k")] if with_role else []))
    return df.select("*", F.concat(F.lit("Role_"), F.col("k").cast("string")).alias("role")).drop("k") if with_role else df
