"""What the operators of this package share: shared storage, table reads, hashing in numpy."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Tables with fewer rows than this may be broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000
#: And only if their bytes, by a plain estimate from the columns' types, are fewer than this.
BROADCAST_BYTES = 64 << 20
#: Bounds of an Arrow batch of texts.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(docs: DataFrame) -> DataFrame:
    """docs, after bounding the bytes of the batches that go to Python, as texts may be long. What the session sets otherwise stays."""
    conf = docs.sparkSession.conf
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        if conf.isModifiable(key) and key not in conf.getAll:
            conf.set(key, str(value))
    return docs


#: Caches that tasks leave in a worker's process for later tasks of the same operator, by its name.
CACHES: dict[str, dict] = {}


@contextmanager
def lean(operator: str = "") -> Iterator[None]:
    """Around a task in a Python worker: caches of other operators go before it, and what it freed goes back to the system after it.

    Workers live on from stage to stage, and an executor's memory is shared with all of them.
    """
    for name, cache in CACHES.items():
        if name != operator:
            cache.clear()
    trim()
    try:
        yield
    finally:
        trim()


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(_LIBC, "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)


_LIBC = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where there is one machine, a local one if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_plumbline_path", None)
        if not path:
            continue
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _bytes(kind: DataType) -> int:
    """Of a value, as far as its type tells: numbers 16 with their place in a row, texts 64, collections of few items 256."""
    if isinstance(kind, StructType):
        return sum(_bytes(f.dataType) for f in kind.fields)
    return 256 if isinstance(kind, (ArrayType, MapType)) else 64 if isinstance(kind, (StringType, BinaryType)) else 16


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast if its counted rows, and the bytes that these take by their types, are few; otherwise the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * _bytes(df.schema) <= BROADCAST_BYTES else df


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public-domain splitmix64 generator, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
