"""Online aggregation: a value after each row, the last one exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import add, prefix


def running_max(df: DataFrame, key: str, column: str) -> DataFrame:
    """df with running_max in order of key (unique)."""
    return prefix(df, [F.col(key)], {"running_max": (F.max(column), F.max(column))}, {"running_max": (F.max, lambda x, y: F.greatest(x, y))})


def running_mean(df: DataFrame, key: str, column: str, z: float = 1.96) -> DataFrame:
    """df with n, mean and half: the mean so far and half the width of its confidence interval."""
    c = F.col(column)
    totals = {"n": (F.count(c), F.count(c)), "s1": (F.sum(c), F.sum(c)), "s2": (F.sum(c * c), F.sum(c * c))}
    out = prefix(df, [F.col(key)], totals, {k: (F.sum, add) for k in totals})
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return out.withColumns({"mean": F.col("s1") / F.col("n"), "half": z * F.sqrt(F.greatest(variance, F.lit(0.0)) / F.col("n"))}).drop("s1", "s2")
