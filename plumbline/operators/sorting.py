"""External sorting as a plan: runs of bounded memory with their metadata, the merges that their number needs, and ranks of the sorted rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import position


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with each row's place in a unique order, from 0. Ranges are sorted side by side, and spill by themselves."""
    return position(df, *order, name=name)


def runs(df: DataFrame, row: str, key: str, memory: int) -> DataFrame:
    """run, n_rows, low, high, place: the runs that `memory` rows at a time give, in order of the row number `row`.

    low and high are a run's least and largest sort key; place is the run's number by size, then creation, which is the order
    in which runs are merged. Runs are few (rows / memory), so one window over them is small.
    """
    from pyspark.sql import Window

    made = df.groupBy(F.floor(F.col(row) / memory).cast("long").alias("run")).agg(F.count("*").alias("n_rows"), F.min(key).alias("low"), F.max(key).alias("high"))
    return made.withColumn("place", (F.row_number().over(Window.orderBy("n_rows", "run")) - 1).cast("long"))


def merges(sizes: list[int], memory: int = 1000, fan_in: int = 10) -> list[tuple[tuple[int, ...], int]]:
    """The merges of runs of these sizes: (numbers of the runs merged, rows of the result); the result gets the next number.

    Smallest runs first, those made earlier before others of their size. Before the last, a merge takes just as many runs as it
    needs for the last to find fan_in. A merge holds a row of each run and one to write.
    """
    if fan_in < 2:
        raise ValueError("a merge needs two runs at least")
    if memory < fan_in + 1:
        raise ValueError("memory has to hold a row of each run that is merged, and one more")
    heap = [(n, i) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    done, fresh = [], len(sizes)
    while len(heap) > 1:
        surplus = len(heap) - fan_in
        some = [heapq.heappop(heap) for _ in range(len(heap) if surplus <= 0 else min(fan_in, surplus + 1))]
        total = sum(n for n, _ in some)
        done.append((tuple(i for _, i in some), total))
        heapq.heappush(heap, (total, fresh))
        fresh += 1
    return done


def merge_stream(runs_: Iterable[Iterable], memory: int) -> Iterator:
    """Sorted runs as one sorted stream, lazily; each run gets an equal part of memory. For streams of rows outside of tables."""
    runs_ = list(runs_)
    if runs_ and memory // len(runs_) < 1:
        raise ValueError("memory doesn't hold a row of each run")
    return heapq.merge(*runs_)
