"""Several queries answered by one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tagged(df: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """Each row that some query wants, once, with the names of those queries as tags (array)."""
    tags = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in queries.items()]))
    return df.withColumn("tags", tags).where(F.size("tags") > 0)


def lists(df: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """A row for each pair of query and row: the queries' results behind one another."""
    return tagged(df, queries).select(F.explode("tags").alias("query"), *df.columns)


def counts(spark: SparkSession, df: DataFrame, queries: dict[str, Column]) -> DataFrame:
    """query, n: with 0 for queries without results. One aggregate over one scan."""
    row = df.agg(*[F.count_if(p).alias(n) for n, p in queries.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("query"), F.col(n).alias("n")) for n in queries])).alias("x")).select("x.*")


def by_index(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Equality queries(query, attribute, constant) as a table: an index over queries that the rows probe."""
    names = [r[0] for r in queries.select("attribute").distinct().collect()]  # names of columns of df
    values = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("constant")) for a in names])).alias("x")
    return df.select("*", values).select(*df.columns, "x.*").join(queries, ["attribute", "constant"]).select("query", *df.columns)


def clock_scan(df: DataFrame, position: str, size: DataFrame, queries: DataFrame) -> DataFrame:
    """query, step and the columns of df: when a cyclic scan over positions 0 .. n - 1 shows each row to queries(query, joined), that join it at some position.

    size is one row with n. Queries are few and travel to the rows, which are read once.
    """
    met = df.join(F.broadcast(size)).join(F.broadcast(queries))
    return met.withColumn("step", F.pmod(F.col(position) - F.pmod("joined", "n"), F.col("n")).cast("long")).drop("n", "joined")
