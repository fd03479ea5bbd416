"""Prepared queries: SQL texts with named parameters under ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if v is None or isinstance(v, (bool, int, float)):
        return "null" if v is None else repr(v).lower() if isinstance(v, bool) else repr(v)
    raise ValueError("parameters are texts, numbers, booleans or nulls")


class Prepared:
    def __init__(self, spark: SparkSession):
        self.spark, self.texts = spark, {}

    def prepare(self, text: str, params: tuple[str, ...] = ()) -> int:
        self.texts[len(self.texts) + 1] = text, tuple(params)
        return len(self.texts)

    def execute(self, id_: int, bindings: dict, **tables: DataFrame) -> DataFrame:
        """tables stand for the names in braces in the text."""
        if id_ not in self.texts:
            raise ValueError(f"no prepared query {id_}")
        text, params = self.texts[id_]
        if set(bindings) != set(params):
            raise ValueError(f"parameters are {params}")
        return self.spark.sql(text, args=bindings, **tables)

    def prepare_clause(self, text: str, params: tuple[str, ...] = ()) -> int:
        """A prepared WHERE clause; several over one table are answered by a shared scan, see clauses()."""
        return self.prepare(text, params)

    def clauses(self, batch: dict[str, tuple[int, dict]]) -> dict[str, Column]:
        """The clauses of a batch with their parameters bound, for sharedscan.lists, tagged or counts. Values are bound as literals, never as text of the clause."""
        out = {}
        for name, (i, bindings) in batch.items():
            if i not in self.texts:
                raise ValueError(f"no prepared query {i}")
            text, params = self.texts[i]
            if set(bindings) != set(params):
                raise ValueError(f"parameters are {params}")
            for k, v in bindings.items():
                text = re.sub(rf":{k}\b", lambda _, v=v: _literal(v), text)
            out[name] = F.expr(text)
        return out

    def execute_batch(self, batch: dict[str, tuple[int, dict]], **tables: DataFrame) -> dict[str, DataFrame]:
        return {name: self.execute(i, b, **tables) for name, (i, b) in batch.items()}


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def generated_code(df: DataFrame) -> str:
    """The code that whole-stage generation makes of a plan, operator pipelines fused."""
    return explain(df, "codegen")


def show(df: DataFrame, write=print, rows: int = 20) -> DataFrame:
    """Prints the first rows, and gives df on, as a sink that can stand within a chain."""
    write("\t".join(df.columns))
    for r in df.limit(rows).collect():  # as many as are shown
        write("\t".join(map(str, r)))
    return df
