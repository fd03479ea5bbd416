"""Boilerplate lines: those on more than a share of their host's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise

RATIO = 0.1
MIN_PAGES = 3


def _lines(text: str = "text"):
    return F.split(F.col(text), "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, key binary, n, pages: lines (by 128-bit digest) on more than ratio of the host's pages and on min_pages at least.

    A page counts once however often it repeats a line. Null hosts form a host of their own; blank lines are no lines; null
    texts count as pages without lines. Counts are added up before they are shuffled, so a common line or a large host costs
    one row a task.
    """
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    each = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(_lines())).alias("line")).where("trim(line) <> ''")
    n = each.groupBy("host", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")).agg(F.count("*").alias("n"))
    n = n.where(F.col("n") >= min_pages)
    on = n["host"].eqNullSafe(pages["host"])
    return n.join(pages, on).where(F.col("n") > ratio * F.col("pages")).select(n["host"], "key", "n", "pages")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs whose text lacks its host's boilerplate lines, with n_lines and n_removed (long); no row goes.

    A host has at most (lines of a page) / ratio such lines, so they travel as one array a host. Null texts stay null with
    0 lines; other columns stay, existing n_lines and n_removed are replaced.
    """
    lines = materialise(boilerplate(docs, host, ratio, min_pages).select("host", "key"), "lines")
    few = lines.count() <= BROADCAST_ROWS
    sets = lines.groupBy(F.col("host").alias("__host")).agg(F.collect_set("key").alias("__keys"))
    out = docs.join(F.broadcast(sets) if few else sets, docs[host].eqNullSafe(F.col("__host")), "left")
    kept = F.filter(_lines(), lambda x: ~F.array_contains(F.col("__keys"), F.unhex(F.md5(x.cast("binary")))))
    out = out.withColumn("__kept", F.when(F.col("__keys").isNull(), _lines()).otherwise(kept))
    n_lines, n_kept = (F.coalesce(F.size(F.when(F.col("text").isNotNull(), c)), F.lit(0)).cast("long") for c in (_lines(), F.col("__kept")))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.withColumns({"n_lines": n_lines, "n_removed": n_lines - n_kept, "text": F.array_join("__kept", "\n")}).select(*columns, "n_lines", "n_removed")
