"""Clauses that become Column expressions. Comparisons are two-valued: a null is unequal to every constant and in no order."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "==": lambda c, v: F.coalesce(c == v, F.lit(False)),
    "!=": lambda c, v: ~c.eqNullSafe(v),
    "<": lambda c, v: F.coalesce(c < v, F.lit(False)),
    "<=": lambda c, v: F.coalesce(c <= v, F.lit(False)),
    ">": lambda c, v: F.coalesce(c > v, F.lit(False)),
    ">=": lambda c, v: F.coalesce(c >= v, F.lit(False)),
}


def where(attribute: str, op: str, constant) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}")
    if not attribute.replace("_", "").isalnum() or attribute[0].isdigit():
        raise ValueError(f"bad attribute {attribute!r}")
    if isinstance(constant, str) and not constant.isalnum():
        raise ValueError("a string constant must be alphanumeric")
    # Null-rejecting comparisons stay plain in a filter, so that they reach the scan.
    return _OPS[op](F.col(attribute), F.lit(constant)) if op == "!=" else _plain(op, F.col(attribute), constant)


def _plain(op: str, c: Column, v) -> Column:
    return {"==": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]


def two_valued(attribute: str, op: str, constant) -> Column:
    """The clause as a value: true or false, never null."""
    where(attribute, op, constant)
    return _OPS[op](F.col(attribute), F.lit(constant))


def disjunction(*clauses: Column) -> Column:
    """False without clauses."""
    return reduce(or_, clauses, F.lit(False)) if clauses else F.lit(False)


TRUE, FALSE = (lambda: F.lit(True)), (lambda: F.lit(False))
