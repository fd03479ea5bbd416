"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literal rows."""
    return spark.createDataFrame(rows, schema)


def first_n(df: DataFrame, key: str, n: float) -> DataFrame:
    """The first rows in order of key; a fractional n counts up."""
    return df.orderBy(key).limit(-int(-n // 1))


def table_size_kb(df: DataFrame) -> DataFrame:
    """kb: four bytes a value, one a character of strings."""
    width = sum((F.coalesce(F.length(c), F.lit(0)) if t == "string" else F.lit(4) for c, t in df.dtypes), F.lit(0))
    return df.agg((F.coalesce(F.sum(width), F.lit(0)) / 1000).cast("double").alias("kb"))


def row_linearised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(pos, value): the values of each row one after the other. key must number the rows from 0."""
    each = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("k", "value")
    return df.select(key, each).select((F.col(key) * len(columns) + F.col("k")).alias("pos"), "value")


def column_linearised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(pos, value): the values of each column one after the other."""
    n = df.agg(F.count("*").alias("n"))
    each = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("k", "value")
    return df.select(key, each).join(F.broadcast(n)).select((F.col("k") * F.col("n") + F.col(key)).alias("pos"), "value")


def write(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, optionally partitioned by a column."""
    (df.write.partitionBy(by) if by else df.write).parquet(path)
