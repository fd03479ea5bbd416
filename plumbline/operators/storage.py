"""Storage models: block assignment, array costs, failures, nesting, and layered caches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def assignment(spark: SparkSession, level: int, blocks: int, disks: int) -> DataFrame:
    """block, disk, row, parity: where each logical block and its parity lie in RAID 0, 1, 4 or 5."""
    if level in (4, 5) and disks < 3:
        raise ValueError("parity needs three disks")
    b = spark.range(blocks).select(F.col("id").alias("block"))
    if level == 1:
        return b.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(disks - 1).cast("long"))).alias("disk"), F.col("block").alias("row"), F.lit(False).alias("parity"))
    data = disks if level == 0 else disks - 1
    row, slot = F.floor(F.col("block") / data).cast("long"), F.pmod(F.col("block"), F.lit(data))
    if level == 0:
        return b.select("block", slot.alias("disk"), row.alias("row"), F.lit(False).alias("parity"))
    other = F.lit(disks - 1).cast("long") if level == 4 else F.pmod(row - 1, F.lit(disks))
    own = slot if level == 4 else F.when(slot >= other, slot + 1).otherwise(slot)
    two = F.explode(F.array(F.struct(own.alias("disk"), F.lit(False).alias("parity")), F.struct(other.alias("disk"), F.lit(True).alias("parity")))).alias("x")
    return b.select("block", row.alias("row"), two).select("block", "x.disk", "row", "x.parity")


@dataclass(frozen=True)
class Device:
    name: str
    read: int
    write: int
    read_iops: int
    write_iops: int
    blow_up: float = 1.0

    def devices(self) -> tuple[Device, ...]:
        return (self,)

    def survives(self, failed: frozenset) -> bool:
        return self not in failed


@dataclass(frozen=True)
class Array:
    """RAID 0, 1 or 5 over devices or arrays."""

    level: int
    members: tuple

    def __post_init__(self):
        if self.level == 5 and len(self.members) < 3:
            raise ValueError("RAID 5 needs three members")

    def devices(self) -> tuple[Device, ...]:
        return tuple(d for m in self.members for d in m.devices())

    def _of(self, name: str) -> list:
        return [getattr(m, name) for m in self.members]

    @property
    def read(self) -> int:
        return sum(self._of("read")) if self.level == 1 else min(self._of("read")) * (len(self.members) - (self.level == 5))

    @property
    def write(self) -> int:
        return min(self._of("write")) * {0: len(self.members), 1: 1, 5: len(self.members) - 1}[self.level]

    @property
    def read_iops(self) -> int:
        return sum(self._of("read_iops")) if self.level == 1 else min(self._of("read_iops")) * len(self.members)

    @property
    def write_iops(self) -> int:
        if self.level == 1:
            return min(self._of("write_iops"))
        if self.level == 0:
            return min(self._of("write_iops")) * len(self.members)
        pairs = list(zip(self._of("read_iops"), self._of("write_iops")))
        return 0 if any(0 in p for p in pairs) else round(min(len(pairs) / (2 / r + 2 / w) for r, w in pairs))

    @property
    def blow_up(self) -> float:
        n, total = len(self.members), sum(self._of("blow_up"))
        return total if self.level == 1 else total / n if self.level == 0 else total / (n - 1)

    def survives(self, failed: frozenset) -> bool:
        alive = sum(m.survives(failed) for m in self.members)
        return alive >= {0: len(self.members), 1: 1, 5: len(self.members) - 1}[self.level]

    def survived(self, k: int) -> tuple[int, int]:
        """(failures of k devices that the data survives, all such failures)."""
        cases = list(combinations(self.devices(), k))
        return sum(self.survives(frozenset(c)) for c in cases), len(cases)


def factorisations(k: int) -> Iterator[list[int]]:
    """Ordered products of two or more factors that give k."""
    for first in range(2, k):
        if k % first == 0:
            yield [first, k // first]
            yield from ([first, *rest] for rest in factorisations(k // first))


def nested(factors: list[int], level: int, device: Device) -> Array:
    """Arrays of arrays, the outermost first; devices get numbers."""
    count = iter(range(10**9))

    def build(rest: list[int]):
        if not rest:
            i = next(count)
            return Device(f"{device.name}{i}", device.read, device.write, device.read_iops, device.write_iops, device.blow_up)
        return Array(level, tuple(build(rest[1:]) for _ in range(rest[0])))

    if not factors or min(factors) < 1:
        raise ValueError("factors are numbers of at least 1")
    return build(factors)


def survivable_masks(spark: SparkSession, level: int, disks: int) -> DataFrame:
    """failed, survived, cases: for each number of failed disks how many failure sets a single-level array survives."""
    masks = spark.range(1 << disks).select(F.bit_count("id").cast("long").alias("failed"))
    most = {0: 0, 1: disks - 1, 4: 1, 5: 1}[level]
    return masks.groupBy("failed").agg(F.count_if(F.col("failed") <= most).alias("survived"), F.count("*").alias("cases"))


def readable_blocks(layout: DataFrame, failed: list[int]) -> DataFrame:
    """block, readable: data blocks that lie on a working disk, or are the only missing block of their parity row."""
    lost = F.col("disk").isin(failed) if failed else F.lit(False)
    cells = layout.select("row", "disk", lost.alias("lost"), "parity").distinct().groupBy("row").agg(F.count_if("lost").alias("missing"), F.count_if("parity").alias("p"))
    data = layout.where("not parity").groupBy("block", "row").agg(F.count_if(~lost).alias("copies"))
    one = data.join(cells, "row")
    return one.select("block", ((F.col("copies") > 0) | ((F.col("p") > 0) & (F.col("missing") == 1))).alias("readable"))


class Layer:
    """A read-through, write-through cache of bounded size over another layer or a dict; evicts the largest unfixed key."""

    def __init__(self, below, capacity: int):
        self.below, self.capacity, self.pages, self.fixed = below, capacity, {}, set()

    def get(self, key):
        if key not in self.pages:
            self._room()
            self.pages[key] = self.below[key] if isinstance(self.below, dict) else self.below.get(key)
        return self.pages[key]

    def put(self, key, value) -> None:
        if key not in self.pages:
            self._room()
        self.pages[key] = value
        if isinstance(self.below, dict):
            self.below[key] = value
        else:
            self.below.put(key, value)

    def fix(self, key) -> None:
        self.get(key)
        self.fixed.add(key)

    def unfix(self, key) -> None:
        self.fixed.discard(key)

    def evict(self):
        """Drops the largest key that isn't fixed, and gives it; its value is below already."""
        free = [k for k in self.pages if k not in self.fixed]
        if not free:
            raise RuntimeError("all pages are fixed")
        gone = max(free)
        del self.pages[gone]
        return gone

    def delete(self, key) -> None:
        """From here and from below; a fixed key stays and is an error."""
        if key in self.fixed:
            raise RuntimeError("a fixed page can't be deleted")
        self.pages.pop(key, None)
        if isinstance(self.below, dict):
            del self.below[key]
        else:
            self.below.delete(key)

    @property
    def size(self) -> int:
        return len(self.pages)

    def _room(self) -> None:
        if len(self.pages) >= self.capacity:
            self.evict()
