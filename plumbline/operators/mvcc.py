"""Snapshots, conflicts and validation over a version log, and a small transactional store for the driver.

A log has object_id, start (commit timestamp), is_delete, value. A transaction table has ta, begin, commit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(log: DataFrame, ts) -> DataFrame:
    """object_id, start, value: of each object the newest version that began before ts, unless it is a deletion. One partial aggregate."""
    last = log.where(F.col("start") < ts).groupBy("object_id").agg(F.max_by(F.struct("start", "is_delete", "value"), "start").alias("v"))
    return last.where(~F.col("v.is_delete")).select("object_id", F.col("v.start").alias("start"), F.col("v.value").alias("value"))


def history(log: DataFrame) -> DataFrame:
    """Each version with the number of its object's version and the start of the next one."""
    w = Window.partitionBy("object_id").orderBy("start")
    return log.withColumns({"version": F.row_number().over(w).cast("long"), "end": F.lead("start").over(w)})


def with_old_values(log: DataFrame) -> DataFrame:
    """Each version with the value it replaced (null if there was none)."""
    w = Window.partitionBy("object_id").orderBy("start")
    deleted, value = F.lag("is_delete").over(w), F.lag("value").over(w)
    return log.withColumn("old", F.when(~deleted, value))


def overlapping(tas: DataFrame, span: int, left: list[str], right: list[str], on: list[str] | None = None) -> DataFrame:
    """Pairs of transactions (columns a_*, b_*) with a.begin < b.begin < a.commit, or equal begins and a.ta < b.ta.

    Binned by time, in bins of `span` ticks: a transaction is in each bin that it touches, so the join stays an equi-join, and
    no pair is lost however long a transaction runs. A span about as long as most transactions makes few copies. `on` names
    columns that have to be equal as well. Null begins and commits have no partners.
    """
    on = on or []
    one = tas.select(*[F.col(c).alias(f"a_{c}") for c in dict.fromkeys([*left, *on])], _bins(span))
    two = tas.select(*[F.col(c).alias(f"b_{c}") for c in dict.fromkeys([*right, *on])], F.floor(F.col("begin") / span).alias("bin"))
    later = (F.col("a_begin") < F.col("b_begin")) | ((F.col("a_begin") == F.col("b_begin")) & (F.col("a_ta") < F.col("b_ta")))
    both = [one["bin"] == two["bin"], *[F.col(f"a_{c}") == F.col(f"b_{c}") for c in on]]
    return one.join(two, both).where(later & (F.col("b_begin") < F.col("a_commit"))).drop("bin")


def _bins(span: int) -> Column:
    first, last = F.floor(F.col("begin") / span), F.floor(F.col("commit") / span)
    return F.explode(F.sequence(first, F.greatest(first, last))).alias("bin")


def write_conflicts(writes: DataFrame, span: int) -> DataFrame:
    """first, second, object_id: overlapping transactions that write one object. writes: ta, begin, commit, object_id."""
    pairs = overlapping(writes.dropDuplicates(["ta", "object_id"]), span, ["ta", "begin", "commit"], ["ta", "begin"], ["object_id"])
    return pairs.select(F.col("a_ta").alias("first"), F.col("b_ta").alias("second"), F.col("a_object_id").alias("object_id"))


def read_conflicts(tas: DataFrame, log: DataFrame, clause: Callable[[Column], Column], span: int) -> DataFrame:
    """reader, writer, object_id: versions committed while a transaction runs that change what its clause selects.

    log has ta, start, old, value, is_delete. A version counts if it differs from the one it replaced and either satisfies the
    clause.
    """
    old, new = F.col("old"), F.when(~F.col("is_delete"), F.col("value"))
    changed = log.where(~old.eqNullSafe(new) & (F.coalesce(clause(old), F.lit(False)) | F.coalesce(clause(new), F.lit(False))))
    one = tas.select(F.col("ta").alias("reader"), "begin", "commit", _bins(span))
    two = changed.select(F.col("ta").alias("writer"), "start", "object_id", F.floor(F.col("start") / span).alias("bin"))
    hit = (F.col("start") > F.col("begin")) & (F.col("start") < F.col("commit")) & (F.col("reader") != F.col("writer"))
    return one.join(two, "bin").where(hit).select("reader", "writer", "object_id")


def write_skew(reads: DataFrame, writes: DataFrame, span: int) -> DataFrame:
    """one, two: overlapping transactions of which each reads what the other writes, while they write no object in common.

    reads and writes have ta, begin, commit, object_id. Partners are found by time bins and objects, never as all pairs.
    """
    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        bins = _bins(span)
        a = x.dropDuplicates(["ta", "object_id"]).select(F.col("ta").alias("a"), F.col("begin").alias("ab"), F.col("commit").alias("ac"), "object_id", bins)
        b = y.dropDuplicates(["ta", "object_id"]).select(F.col("ta").alias("b"), F.col("begin").alias("bb"), F.col("commit").alias("bc"), "object_id", bins)
        both = a.join(b, ["object_id", "bin"]).where((F.col("a") != F.col("b")) & (F.least("ac", "bc") > F.greatest("ab", "bb")))
        return both.select("a", "b").distinct()

    cross = meet(reads, writes)
    pairs = cross.where("a < b").join(cross.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi")
    return pairs.join(meet(writes, writes), ["a", "b"], "left_anti").select(F.col("a").alias("one"), F.col("b").alias("two"))


def same_result(log: DataFrame, clause: Column, begin, commit) -> DataFrame:
    """same: whether a read of the clause gives at commit what it gave at begin; by order-independent digests of both snapshots."""

    def digest(ts, name: str) -> DataFrame:
        own = snapshot(log, ts).where(clause)
        return own.agg(F.count("*").alias(f"n_{name}"), F.coalesce(F.bit_xor(F.xxhash64("object_id", "value")), F.lit(0)).alias(f"x_{name}"))

    both = digest(begin, "a").join(digest(commit, "b"))
    return both.select(((F.col("n_a") == F.col("n_b")) & (F.col("x_a") == F.col("x_b"))).alias("same"))


def replay(journal: DataFrame) -> DataFrame:
    """The state after a journal(seq, ta, kind, object_id, value): the last write of each object by a committed transaction, in commit order."""
    commits = journal.where("kind = 'commit'").select("ta", F.col("seq").alias("at"))
    writes = journal.where("kind in ('update', 'delete')").join(commits, "ta")
    last = writes.groupBy("object_id").agg(F.max_by(F.struct("kind", "value"), F.struct("at", "seq")).alias("v"))
    return last.where("v.kind = 'update'").select("object_id", F.col("v.value").alias("value"))


def serial_order(tas: DataFrame) -> DataFrame:
    """ta, point: committed transactions with their serialization point: a writer's commit, a reader's begin."""
    return tas.where("committed").select("ta", F.when(F.col("writes") > 0, F.col("commit")).otherwise(F.col("begin")).alias("point"))


def interleavings(lengths: list[int]) -> list[tuple[int, ...]]:
    """All orders of transactions' operations in which each keeps its own order and transaction i begins after i - 1."""

    def go(left: tuple[int, ...], done: tuple[int, ...]):
        if not any(left):
            yield done
        for i, n in enumerate(left):
            if n and (i == 0 or left[i - 1] < lengths[i - 1]):
                yield from go(left[:i] + (n - 1,) + left[i + 1 :], done + (i,))

    return list(go(tuple(lengths), ()))


class Aborted(Exception):
    """The transaction conflicts with another and was rolled back."""


@dataclass
class _Transaction:
    begin: int
    writes: dict[str, dict | None] = field(default_factory=dict)
    reads: list[Callable[[dict], bool]] = field(default_factory=list)


class Store:
    """Multi-version objects with transactions; metadata-sized, on the driver.

    isolation: 'serializable', 'snapshot', or 'none', under which only an uncommitted write of the same object stops another and
    nothing is validated. autocommit: whether put, get, delete and bulkload are transactions of their own at any time; without it
    they load and look at objects before the first transaction. index: attributes whose equality reads go through an index, which
    gives candidates, of which the snapshot decides.
    """

    def __init__(self, isolation: str = "serializable", autocommit: bool = False, index: tuple[str, ...] = ()):
        if isolation not in ("serializable", "snapshot", "none"):
            raise ValueError(f"unknown isolation {isolation!r}")
        self.isolation, self.clock, self.autocommit = isolation, 1, autocommit
        self.versions: dict[str, list[tuple[int, dict | None]]] = {}
        self.active: dict[int, _Transaction] = {}
        self.journal: list[tuple] = []
        self.index: dict[str, dict[object, set[str]]] = {a: {} for a in index}

    def _keep(self, key: str, at: int, value: dict | None) -> None:
        self.versions.setdefault(key, []).append((at, value))
        for a, entries in self.index.items():
            if value is not None and a in value:
                entries.setdefault(value[a], set()).add(key)

    def _alone(self, work):
        """Runs work(ta) as a transaction of its own, which is rolled back as a whole where it fails."""
        ta = self.begin()
        try:
            out = work(ta)
            self.commit(ta)
            return out
        except Exception:
            if ta in self.active:
                self.abort(ta)
            raise

    def _loading(self, what: str) -> None:
        if self.clock > 1:
            raise RuntimeError(f"without autocommit, {what} comes before the first transaction")

    def put(self, key: str, value: dict) -> None:
        if self.autocommit:
            self._alone(lambda ta: self.update(ta, key, value))
        else:
            self.load({key: value})

    def bulkload(self, objects: dict[str, dict]) -> None:
        """All of them or none."""
        if self.autocommit:
            self._alone(lambda ta: [self.update(ta, k, v) for k, v in objects.items()])
        else:
            self.load(objects)

    def get(self, key: str) -> dict | None:
        if not self.autocommit:
            self._loading("get")
            return self._seen(key, self.clock)
        return self._alone(lambda ta: self.read(ta).get(key))

    def remove(self, key: str) -> None:
        if not self.autocommit:
            raise RuntimeError("without autocommit, objects are deleted by transactions only")
        self._alone(lambda ta: self.delete(ta, key))

    def load(self, objects: dict[str, dict]) -> None:
        self._loading("load")
        for k, v in objects.items():
            self._keep(k, 0, dict(v))

    def lookup(self, ta: int, attribute: str, value) -> dict[str, dict]:
        """The objects whose attribute is value, in order of their keys as texts: through the index where there is one."""
        t = self.active[ta]
        clause = lambda v: v.get(attribute) == value
        if attribute not in self.index:
            return self.read(ta, clause)
        t.reads.append(clause)
        near = {*self.index[attribute].get(value, ()), *t.writes}
        now = {k: t.writes[k] if k in t.writes else self._seen(k, t.begin) for k in sorted(near, key=str)}
        return {k: v for k, v in now.items() if v is not None and clause(v)}

    def _tick(self) -> int:
        self.clock += 1
        return self.clock - 1

    def begin(self) -> int:
        ta = self._tick()
        self.active[ta] = _Transaction(ta)
        self.journal.append(("begin", ta))
        return ta

    def _seen(self, key: str, ts: int) -> dict | None:
        return next((v for at, v in reversed(self.versions.get(key, [])) if at < ts), None)

    def read(self, ta: int, clause: Callable[[dict], bool] = lambda _: True) -> dict[str, dict]:
        t = self.active[ta]
        t.reads.append(clause)
        keys = {*self.versions, *t.writes}
        now = {k: t.writes[k] if k in t.writes else self._seen(k, t.begin) for k in sorted(keys)}
        return {k: v for k, v in now.items() if v is not None and clause(v)}

    def update(self, ta: int, key: str, value: dict | None) -> None:
        t = self.active[ta]
        other = any(key in x.writes for k, x in self.active.items() if k != ta)
        late = self.isolation == "snapshot" and any(at > t.begin for at, _ in self.versions.get(key, []))
        if other or late:
            self.abort(ta)
            raise Aborted(f"{ta}: {key} is being or was written")
        t.writes[key] = value
        self.journal.append(("delete" if value is None else "update", ta, key, value))

    def delete(self, ta: int, key: str) -> None:
        if key not in self.versions and key not in self.active[ta].writes:
            raise KeyError(key)
        self.update(ta, key, None)

    def commit(self, ta: int) -> int:
        t, at = self.active[ta], self._tick()
        if self.isolation == "serializable" and t.writes:
            for key, log in self.versions.items():
                for when, new in log:
                    if when > t.begin:
                        old = self._seen(key, when)
                        if old != new and any(v is not None and c(v) for c in t.reads for v in (old, new)):
                            self.abort(ta)
                            raise Aborted(f"{ta}: {key} changed under a read")
        for key, value in t.writes.items():
            self._keep(key, at, value)
        del self.active[ta]
        self.journal.append(("commit", ta, at))
        return at

    def abort(self, ta: int) -> None:
        del self.active[ta]
        self.journal.append(("abort", ta))


Step = tuple[int, str, tuple]  # transaction, operation (read, update, delete, commit, abort) and its arguments


@dataclass
class Run:
    """What came of a schedule: each transaction's reads in their order, what it wrote, when it was serialised, and the last state."""

    reads: dict[int, list[dict[str, dict]]]
    steps: dict[int, list[Step]]
    points: dict[int, int]
    state: dict[str, dict]
    aborted: set[int]


def run_schedule(initial: dict[str, dict], schedule: list[Step], isolation: str = "serializable") -> Run:
    """Runs a schedule on a fresh store. Transactions begin at their first step; steps after an abort are left out."""
    s = Store(isolation)
    s.load(initial)
    tas: dict[int, int] = {}
    out = Run({}, {}, {}, {}, set())
    for t, what, args in schedule:
        if t in out.aborted:
            continue
        if t not in tas:
            tas[t] = s.begin()
            out.reads[t], out.steps[t] = [], []
        try:
            if what == "read":
                out.reads[t].append(s.read(tas[t], *args))
            elif what == "abort":
                s.abort(tas[t])
                out.aborted.add(t)
            elif what == "commit":
                wrote = bool(s.active[tas[t]].writes)
                at = s.commit(tas[t])
                out.points[t] = at if wrote else tas[t]
            else:
                getattr(s, what)(tas[t], *(a(out.reads[t]) if callable(a) else a for a in args))
            out.steps[t].append((t, what, args))
        except Aborted:
            out.aborted.add(t)
    out.state = {k: v for k in sorted(s.versions) if (v := s._seen(k, s.clock)) is not None}
    return out


def verdict(initial: dict[str, dict], run: Run) -> str:
    """Whether a run's committed transactions read and left what some serial order of them gives: 'nothing committed', 'serializable',
    'serializable in another order' than that of their serialization points, or 'not serializable'.
    """
    done = sorted(run.points, key=run.points.get)
    if not done:
        return "nothing committed"
    for k, order in enumerate(permutations(done)):  # the first is that of the points
        again = run_schedule(initial, [step for t in order for step in run.steps[t]])
        if again.state == run.state and all(again.reads[t] == run.reads[t] for t in done):
            return "serializable in another order" if k else "serializable"
    return "not serializable"


def _plus(key: str, n: int):
    """A value computed from the transaction's last read."""
    return lambda reads: {"v": reads[-1][key]["v"] + n}


_ACCOUNTS = {"x": {"v": 50}, "y": {"v": 50}}
_HIGH = lambda v: v["v"] > 40
#: name -> (objects, schedule): what may go wrong when transactions overlap.
SCENARIOS: dict[str, tuple[dict[str, dict], list[Step]]] = {
    "serial": (_ACCOUNTS, [(1, "read", ()), (1, "update", ("x", _plus("x", 1))), (1, "commit", ()), (2, "read", ()), (2, "update", ("x", _plus("x", 1))), (2, "commit", ())]),
    "lost update": (_ACCOUNTS, [(1, "read", ()), (2, "read", ()), (1, "update", ("x", _plus("x", 1))), (1, "commit", ()), (2, "update", ("x", _plus("x", 5))), (2, "commit", ())]),
    "dirty write": (_ACCOUNTS, [(1, "read", ()), (2, "read", ()), (1, "update", ("x", _plus("x", 1))), (2, "update", ("x", _plus("x", 5))), (1, "commit", ()), (2, "commit", ())]),
    "write skew": (_ACCOUNTS, [(1, "read", ()), (2, "read", ()), (1, "update", ("x", _plus("y", -90))), (2, "update", ("y", _plus("x", -90))), (1, "commit", ()), (2, "commit", ())]),
    "phantom": (_ACCOUNTS, [(1, "read", (_HIGH,)), (2, "update", ("z", {"v": 60})), (2, "commit", ()), (1, "update", ("n", lambda reads: {"v": len(reads[-1])})), (1, "commit", ())]),
    "read-only": (_ACCOUNTS, [(1, "read", ()), (2, "update", ("x", {"v": 7})), (2, "commit", ()), (1, "read", ()), (1, "commit", ())]),
    "own abort": (_ACCOUNTS, [(1, "update", ("x", {"v": 7})), (1, "abort", ()), (2, "read", ()), (2, "delete", ("y",)), (2, "commit", ())]),
}
