"""Joins, sorting, top-k, aggregates and prefix windows that don't meet in one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Below this many bytes, as Spark estimates them, a side may be broadcast.
BROADCAST_BYTES = 64 << 20


def size_in_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def if_small(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if its estimated size allows; otherwise the planner chooses."""
    return F.broadcast(df) if size_in_bytes(df) <= BROADCAST_BYTES else df


def hash_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, null_safe: bool = False) -> DataFrame:
    """Inner equi-join, the probe's columns first."""
    a, b = probe[probe_key], build[build_key]
    return probe.join(build, a.eqNullSafe(b) if null_safe else a == b)


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The left rows with a partner; none is doubled."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


def semi_reduced_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Ships the distinct keys of left, reduces right by them, and joins what is left."""
    keys = left.select(F.col(left_key).alias("__key")).distinct()
    return hash_join(right.join(keys, right[right_key] == F.col("__key"), "left_semi"), left, right_key, left_key)


def copartitioned_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, n: int | None = None) -> DataFrame:
    """Both sides dealt out by the key, then joined where they lie: one exchange a side, none for the join."""
    a, b = (df.repartition(*([n] if n else []), key) for df, key in ((left, left_key), (right, right_key)))
    return hash_join(b, a, right_key, left_key)


def nested_loop(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Every pair, filtered; for checks on small tables: the right side must be small enough to be broadcast."""
    if size_in_bytes(right) > BROADCAST_BYTES:
        raise ValueError("the right side of a nested-loop join is too large; use an equi-join or bins")
    return left.crossJoin(F.broadcast(right)).filter(condition)


def shipped(left: DataFrame, right: DataFrame, left_key: str, right_key: str, width: dict[str, int]) -> DataFrame:
    """strategy, rows, bytes: what a join of two tables on different machines sends over the network, for each strategy.

    send_all: all of left. semi_reduced: the distinct keys of left, and back the rows of right that have one of them.
    copartitioned: nothing, if both are dealt out by the key already. width: bytes of a row of left, of right, and of a key.
    """
    keys = left.select(F.col(left_key).alias("__key")).distinct()
    back = right.join(keys, right[right_key] == F.col("__key"), "left_semi")
    none = F.lit(0).cast("long")

    def told(name: str, rows: DataFrame, bytes_: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("strategy"), F.col("n").alias("rows"), bytes_.cast("long").alias("bytes"))

    count = lambda df: df.agg(F.count("*").alias("n"))
    both = count(keys).withColumnRenamed("n", "k").join(count(back).withColumnRenamed("n", "b")).withColumn("n", F.col("k") + F.col("b"))
    out = told("send_all", count(left), F.col("n") * width["left"])
    out = out.unionByName(told("semi_reduced", both, F.col("k") * width["key"] + F.col("b") * width["right"]))
    return out.unionByName(told("copartitioned", left.sparkSession.range(1).select(none.alias("n")), none))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """A bounded heap a task, then one merge (TakeOrderedAndProject). The order must break ties."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, with one machine, one of its own where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ranged(df: DataFrame, *order) -> DataFrame:
    """df dealt out by sampled ranges of an order, with __b, the number of a row's range: ranges of about equal depth, as many as shuffle partitions.

    It is checkpointed, as another sample might cut elsewhere.
    """
    return checkpointed(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))


def prefix(df: DataFrame, order: list[Column], totals: dict[str, tuple[Column, Column]], across: dict) -> DataFrame:
    """Running values over a global order (unique) without one task for all rows.

    totals: name -> (window aggregate over rows so far, the same aggregate over a range); across: name -> (aggregate that
    carries ranges forward, how to combine with the value in the range). Ranges are of about equal depth at any size of the
    table; only one row a range meets in the last window.
    """
    own = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    forward = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    df = ranged(df, *order)
    sums = df.groupBy("__b").agg(*[t.alias(n) for n, (_, t) in totals.items()])
    carried = sums.select("__b", *[across[n][0](F.col(n)).over(forward).alias(f"__{n}") for n in totals])
    out = df.withColumns({n: w.over(own) for n, (w, _) in totals.items()}).join(F.broadcast(carried), "__b")
    return out.withColumns({n: across[n][1](F.col(n), F.col(f"__{n}")) for n in totals}).drop("__b", *[f"__{n}" for n in totals])


def add(x: Column, y: Column) -> Column:
    return x + F.coalesce(y, F.lit(0))


def position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """The number of rows before each in a unique order, from 0."""
    out = prefix(df, list(order), {"__n": (F.count(F.lit(1)), F.count(F.lit(1)))}, {"__n": (F.sum, add)})
    return out.withColumn(name, F.col("__n") - 1).drop("__n")


def lower_bound(df: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """The number of rows with a smaller key. Equal keys are counted first, so one that many rows share costs one row; nulls come first."""
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__c"))
    upto = prefix(n, [F.col("__k")], {"__n": (F.sum("__c"), F.sum("__c"))}, {"__n": (F.sum, add)})
    upto = upto.select("__k", (F.col("__n") - F.col("__c")).alias(name))
    return df.join(upto, df[key].eqNullSafe(F.col("__k"))).drop("__k")
