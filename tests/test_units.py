import datetime

import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.functions import z_decode, z_encode, z_text
from plumbline.operators import indexes, mvcc, predicates, relational, resultdb, sorting, storage
from plumbline.plans import joinorder
from plumbline.plans.catalog import Prepared, explain, generated_code, show
from plumbline.registry import _CARDS

from .conftest import canon


def test_join_order_goldens():
    for algo, pairs in (("dpsize", 73), ("dpsub", 42), ("dpccp", 20)):
        assert joinorder.plan(algo, joinorder.chain(5), _CARDS) == (10770, ((((3, 2), 1), 0), 4), pairs)
        assert joinorder.plan(algo, joinorder.chain(1), {1: 7}) == (7, 0, 0)
    import random

    random.seed(42)
    cards = {s: random.randint(0, 1000) for s in range(1, 16)}
    for algo, pairs in (("dpsize", 44), ("dpsub", 23), ("dpccp", 18)):
        assert joinorder.plan(algo, joinorder.cycle(4), cards) == (2011, (3, ((1, 0), 2)), pairs)
    with pytest.raises(ValueError):
        joinorder.JoinGraph(2).add(0, 5)


@pytest.mark.parametrize("graph", [joinorder.chain(6), joinorder.star(6), joinorder.cycle(6), joinorder.clique(5)])
def test_connected_sets_and_pairs_are_complete(graph):
    every = [s for s in range(1, 1 << graph.n) if graph.connected(s)]
    found = list(joinorder.connected_sets(graph))
    assert sorted(found) == every
    pairs = {frozenset(p) for p in joinorder.connected_pairs(graph)}
    assert len(pairs) == len(list(joinorder.connected_pairs(graph)))
    assert pairs == {frozenset((a, b)) for a in every for b in every if a < b and not a & b and graph.joined(a, b)}


def _schools(spark):
    """Pupils who attend courses that take place in rooms, with rows that no join reaches on each side."""
    pupils = [(k, f"p{k}") for k in range(9)]
    attends = [(k % 7, (k * k) % 11) for k in range(30)] + [(77, 1), (2, 99)]
    courses = [(k, 20 + 7 * k % 40) for k in range(13)]
    rels = {"pupils": spark.createDataFrame(pupils, "id long, name string"), "attends": spark.createDataFrame(attends, "pupil long, course long"), "courses": spark.createDataFrame(courses, "nr long, seats long").where("seats < 45")}
    joined = [(p, a, c) for a in attends for p in pupils if p[0] == a[0] for c in courses if c[0] == a[1] and c[1] < 45]
    return rels, joined, attends


@pytest.mark.parametrize("root", ["pupils", "attends", "courses"])
def test_result_database_is_what_the_join_uses(spark, root):
    g = resultdb.graph_of([("pupils", "id", "attends", "pupil"), ("attends", "course", "courses", "nr")])
    rels, joined, attends = _schools(spark)
    r = resultdb.reduce_fully(rels, g, root)
    assert sorted(map(tuple, r["pupils"].collect())) == sorted({p for p, _, _ in joined}) and sorted(map(tuple, r["courses"].collect())) == sorted({c for _, _, c in joined})
    used = {a for _, a, _ in joined}
    assert sorted(map(tuple, r["attends"].collect())) == sorted(a for a in attends if a in used)
    assert resultdb.yannakakis(rels, g, root).count() == len(joined)


def test_long_transactions_lose_no_partner(spark):
    import random

    rng = random.Random(7)
    tas = [(k, b, b + rng.choice([1, 5, 40, 300])) for k in range(60) for b in [rng.randrange(400)]] + [(99, None, None)]
    log = [(rng.randrange(60), rng.randrange(700), float(rng.randrange(4)), False, f"o{k % 5}", float(rng.randrange(4))) for k in range(80)]
    t = spark.createDataFrame(tas, "ta long, begin long, commit long")
    pairs = {(a, c) for a, b, e in tas for c, d, _ in tas if b is not None and d is not None and (b < d < e or (b == d < e and a < c))}
    hits = {(r, w, o) for r, b, e in tas for w, at, old, _, o, new in log if b is not None and b < at < e and r != w and old != new and (old > 1 or new > 1)}
    for span in (1, 16, 1000):
        got = [tuple(r) for r in mvcc.overlapping(t, span, ["ta", "begin", "commit"], ["ta", "begin"]).select("a_ta", "b_ta").collect()]
        assert len(got) == len(set(got)) and set(got) == pairs
        logs = spark.createDataFrame(log, "ta long, start long, old double, is_delete boolean, object_id string, value double")
        assert {tuple(r) for r in mvcc.read_conflicts(t, logs, lambda v: v > 1, span).collect()} == hits


def test_reduction_order_and_cycles(spark):
    star = resultdb.graph_of([("r0", "a", "r3", "a"), ("r0", "a", "r1", "a"), ("r0", "a", "r2", "a")])
    assert resultdb.reduction_order(star, "r3") == [("r3", "r0"), ("r0", "r1"), ("r0", "r2")]
    ring = resultdb.graph_of([("r", "b", "s", "b"), ("s", "c", "t", "c"), ("t", "a", "r", "a")])
    with pytest.raises(ValueError):
        resultdb.reduction_order(ring, "r")
    with pytest.raises(ValueError):
        resultdb.result_database({}, ring, "r")


def test_predicates(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert df.where(predicates.where("x", "!=", 1)).count() == 2
    assert df.select(predicates.two_valued("x", "<", 2).alias("b")).collect() == [(True,), (False,), (False,)]
    assert df.where(predicates.disjunction()).count() == 0
    for bad in (("x", "~", 1), ("x;", "==", 1), ("x", "==", "a b")):
        with pytest.raises(ValueError):
            predicates.where(*bad)


def test_pushdown_and_topk(spark):
    from .conftest import DATA

    part = spark.read.parquet(f"{DATA}/part.parquet")
    text = explain(part.filter(predicates.where("p_size", "<", 9)).select("p_partkey"))
    assert "PushedFilters: [IsNotNull(p_size), LessThan(p_size,9)]" in text and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text
    assert "TakeOrderedAndProject" in explain(relational.top_k(part, 3, F.col("p_partkey")))


def test_prepared(spark):
    p = Prepared(spark)
    q = p.prepare("select :a + 1 as x", ("a",))
    assert p.execute(q, {"a": 4}).collect() == [(5,)]
    for bad in ((99, {}), (q, {})):
        with pytest.raises(ValueError):
            p.execute(*bad)


def test_z_codes(spark):
    row = spark.range(1).select(z_encode(F.lit(2), F.lit(1), 3).alias("z")).select(z_text(F.col("z"), 3), *z_decode(F.col("z"), 3)).first()
    assert tuple(row) == ("000110", 2, 1)


def test_positions_across_ranges(spark):
    values = [5, 1, 1, 9, 30, 30, 12, *range(100, 400, 3)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v int").repartition(5)
    got = {r.i: r.pos for r in relational.lower_bound(df, "v").collect()}
    assert got == {-1: 0} | {i: 1 + sum(w < v for w in values) for i, v in enumerate(values)}
    got = [r.i for r in sorting.ranked(df, F.col("v"), F.col("i")).orderBy("rank").collect()]
    assert got == [-1, *sorted(range(len(values)), key=lambda i: (values[i], i))]
    assert relational.position(df.limit(0), F.col("i")).count() == 0


def test_merges_take_just_enough_runs():
    assert sorting.merges([5], 1000, 10) == [] and sorting.merges([3, 1, 2], 1000, 3) == [((1, 2, 0), 6)]
    # Four runs, three at a time: two first, so that three are left.
    assert sorting.merges([4, 4, 4, 4], 1000, 3) == [((0, 1), 8), ((2, 3, 4), 16)]
    for n in range(1, 40):
        for fan_in in (2, 3, 10):
            done = sorting.merges([7] * n, 1000, fan_in)
            assert not done or done[-1][1] == 7 * n and max(len(m) for m, _ in done) <= fan_in and (n <= fan_in or len(done[-1][0]) == fan_in)
    for bad in ({"fan_in": 1}, {"memory": 3, "fan_in": 3}):
        with pytest.raises(ValueError):
            sorting.merges([1, 2], **bad)
    assert list(sorting.merge_stream([[1, 4], [2], []], 3)) == [1, 2, 4]
    with pytest.raises(ValueError):
        sorting.merge_stream([[1], [2]], 1)


def _bits(spark, sets):
    return spark.createDataFrame([(k, p) for k, own in sets.items() for p in own], "key string, row long")


def _words(df):
    return sorted(map(tuple, df.select("key", "chunk", "kind", "run", "bits").collect()))


@pytest.mark.parametrize("n", [1, 7, 50, 700])
def test_wah_algebra_matches_sets(spark, n):
    """Results have the right bits, and are the words that compressing them gives."""
    import random

    rng = random.Random(n)
    dense = lambda: {p for p in range(n) if rng.random() < rng.choice([0.02, 0.5, 0.98])}
    stretch = lambda: {p for lo in [rng.randrange(n)] for p in range(lo, rng.randrange(lo, n) + 1)}
    one, two = ({k: f() | {rng.randrange(n)} for k, f in (("a", dense), ("b", stretch), ("c", stretch))} for _ in range(2))
    one["only"] = {0}
    words = [indexes.wah_words(_bits(spark, x), "key", "row", n, 8) for x in (one, two)]
    for op, f in (("and", set.__and__), ("or", set.__or__), ("xor", set.__xor__)):
        got = relational.checkpointed(indexes.wah_combine(*words, op, n, 8))
        want = {k: f(one[k], two[k]) for k in two}
        assert {tuple(r) for r in indexes.wah_positions(got, n, 8).collect()} == {(k, p) for k, own in want.items() for p in own}
        some = {k: v for k, v in want.items() if v}
        assert [w for w in _words(got) if w[0] in some] == _words(indexes.wah_words(_bits(spark, some), "key", "row", n, 8)) or not some
        ends = {r.key: (r.n_set, r.first, r.last) for r in indexes.wah_ends(got, n, 8).collect()}
        assert ends == {k: (len(v), min(v), max(v)) for k, v in some.items()}
    flipped = {k: set(range(n)) - v for k, v in one.items()}
    back = indexes.wah_not(words[0], n, 8)
    assert {tuple(r) for r in indexes.wah_positions(back, n, 8).collect()} == {(k, p) for k, v in flipped.items() for p in v}
    assert _words(indexes.wah_not(back, n, 8)) == _words(words[0])


def test_bloom_grows_with_its_keys(spark):
    assert [indexes.bloom_bits(n) for n in (0, 1, 1000, 10**12)] == [1 << 10, 1 << 10, 1 << 14, indexes.MOST_BITS]
    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "k")
    bits = indexes.bloom_bits(10_000)
    k = indexes.bloom_shape(10_000, bits)
    got = indexes.maybe_in(spark.range(20_000).withColumnRenamed("id", "k"), "k", indexes.bloom_filter(keys, "k", bits, k), bits, k)
    assert got.where("k % 2 = 0").count() == 10_000 and got.where("k % 2 = 1").count() < 500


def test_leaves_prune_and_hold_their_invariants(spark, tmp_path):
    df = spark.range(5_000).selectExpr("id * 7 % 5003 as k", "id as v", "0 as seq")
    leaves = indexes.Leaves.build(df, "k", str(tmp_path / "a"), 4)
    assert leaves.invariants().first() == (True, True, 5_000) and leaves.nodes().count() == 4
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,77)]" in explain(leaves.get(77)) and leaves.get(77).count() == 1
    more = spark.createDataFrame([(77, -1, 1), (99_999, -2, 1)], "k long, v long, seq int")
    new = leaves.put(more, "seq", str(tmp_path / "b"))
    assert new.invariants().first() == (True, True, 5_001) and new.get(77).first().v == -1 and [r.v for r in new.range(5_003, 10**6).collect()] == [-2]
    spark.createDataFrame([(9,), (3,)], "k long").coalesce(1).write.parquet(str(tmp_path / "c"))
    broken = indexes.Leaves(spark, str(tmp_path / "c"), "k", "k long")
    assert broken.invariants().first() == (False, True, 2)


def _at_ranks(values, parts):
    v = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
    return [v[-(-k * len(v) // parts) - 1] for k in range(1, parts)] if v else []


@pytest.mark.parametrize("kind, values", [
    ("double", [k * 7919 % 60013 / 8 for k in range(60_000)]),
    ("double", [5.0] * 3000 + [k / 3 for k in range(9)] + [None] * 1000),
    ("double", [float("nan")] * 40 + [float("inf"), float("-inf"), 0.0, 0.25] * 10 + [None]),
    ("long", [2**60 + k * 37 % 1009 for k in range(1009)]),
    ("date", [datetime.date(1990, 1, 1) + datetime.timedelta(k * 37 % 1009) for k in range(1009)]),
    ("double", [7.0]), ("double", [None, None]), ("double", []),
])
def test_depth_bounds_are_exact_where_the_sketch_is_not(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}").repartition(5)
    for parts, accuracy in ((4, 20), (7, 20), (4, 10_000), (1, 20)):
        assert str(indexes.depth_bounds(df, "k", parts, accuracy)) == str(_at_ranks(values, parts))


@pytest.mark.parametrize("name", ["equi_depth_counts", "equi_depth_from_sample"])
def test_equi_depth_counts_null_keys_apart(spark, tmp_path, name):
    import duckdb

    some = [None if k % 5 == 0 else float("nan") if k % 7 == 0 else k * 7919 % 5003 * 100.0 for k in range(5000)]
    for at, prices in (("odd", some), ("null", [None, None]), ("empty", [])):
        spark.createDataFrame([(p,) for p in prices], "o_totalprice double").write.parquet(f"{tmp_path}/{at}/orders.parquet")
        with duckdb.connect() as c:
            c.execute(f"create view orders as from '{tmp_path}/{at}/orders.parquet/*.parquet'")
            assert canon(registry.QUERIES[name](spark, f"{tmp_path}/{at}").toPandas()) == canon(c.sql(registry.ORACLE_SQL[name]).df())


def test_tries_route_keys_that_fit(spark):
    df = spark.createDataFrame([(0,), (5,), (26,), (None,)], "k long")
    t = indexes.RadixTrie(3, 3)
    assert sorted(map(tuple, t.route(df, "k").collect()), key=str) == sorted([(0, 0, 0, 0), (5, 0, 1, 2), (26, 2, 2, 2), (None, None, None, None)], key=str)
    with pytest.raises(Exception, match="doesn't fit"):
        t.route(spark.createDataFrame([(27,)], "k long"), "k").collect()
    mapped = indexes.RadixTrie(2, 1, lambda c: F.length(c) % 2)
    words = mapped.route(spark.createDataFrame([("a",), ("bb",), ("a",), ("ccc",)], "w string"), "w")
    assert mapped.get(words, "w", "a").count() == 2
    with pytest.raises(ValueError):
        indexes.RadixTrie(1, 3)


def test_layer_sizes():
    assert indexes.layer_sizes(1, 10) == [10] and indexes.layer_sizes(3, 5) == [1, 3, 5]
    for layers, models in ((2, 100), (3, 12), (3, 1_000), (5, 77)):
        sizes = indexes.layer_sizes(layers, models)
        assert sizes[0] == 1 and sum(sizes) == models and sizes == sorted(sizes)


def test_prepared_clauses_are_bound_as_values(spark):
    p = Prepared(spark)
    i = p.prepare_clause("name = :n or k > :k", ("n", "k"))
    df = spark.createDataFrame([("it's", 1), ("x' or '1'='1", 2), ("y", 9)], "name string, k int")
    for value, n in (("it's", 2), ("x' or '1'='1", 2), ("none", 1), (None, 1)):
        assert df.where(p.clauses({"q": (i, {"n": value, "k": 5})})["q"]).count() == n
    for bad in ((99, {}), (i, {"n": 1})):
        with pytest.raises(ValueError):
            p.clauses({"q": bad})


def test_shown_rows_and_generated_code(spark):
    told = []
    df = spark.range(3)
    assert show(df, told.append, 2) is df and told == ["id", "0", "1"]
    assert "WholeStageCodegen" in generated_code(df.where("id > 1"))


def test_nested_loops_of_large_tables_are_refused(spark):
    with pytest.raises(ValueError):
        relational.nested_loop(spark.range(5), spark.range(1 << 40), F.lit(True))


def test_store_lost_update_and_write_skew():
    s = mvcc.Store()
    s.load({"x": {"v": 1}, "y": {"v": 1}})
    a, b = s.begin(), s.begin()
    s.read(a), s.read(b)
    s.update(a, "x", {"v": 0})
    with pytest.raises(mvcc.Aborted):
        s.update(b, "x", {"v": 5})
    s.commit(a)
    assert s.read(s.begin()) == {"x": {"v": 0}, "y": {"v": 1}}
    for isolation, fails in (("serializable", True), ("snapshot", False)):
        s = mvcc.Store(isolation)
        s.load({"x": {"v": 1}, "y": {"v": 1}})
        a, b = s.begin(), s.begin()
        s.read(a), s.read(b)
        s.update(a, "x", {"v": 0}), s.update(b, "y", {"v": 0})
        s.commit(a)
        if fails:
            with pytest.raises(mvcc.Aborted):
                s.commit(b)
        else:
            s.commit(b)


def test_store_runs_are_serializable():
    """Every interleaving of two transactions that read both objects and write one gives what some serial order gives."""
    for plan in mvcc.interleavings([2, 2]):
        s = mvcc.Store()
        s.load({"x": {"v": 1}, "y": {"v": 2}})
        tas, step, done = {}, {0: 0, 1: 0}, set()
        for t in plan:
            tas.setdefault(t, s.begin()) if t not in tas else None
            try:
                if step[t] == 0:
                    total = sum(o["v"] for o in s.read(tas[t]).values())
                    s.update(tas[t], "xy"[t], {"v": total})
                elif tas[t] in s.active:
                    s.commit(tas[t])
                    done.add(t)
            except mvcc.Aborted:
                pass
            step[t] += 1
        final = {k: v["v"] for k, v in s.read(s.begin()).items()}
        serial = {frozenset(): {"x": 1, "y": 2}, frozenset({0}): {"x": 3, "y": 2}, frozenset({1}): {"x": 1, "y": 3}}
        assert final in ([{"x": 3, "y": 5}, {"x": 4, "y": 3}] if len(done) == 2 else [serial[frozenset(done)]])


def test_store_with_autocommit_and_index():
    s = mvcc.Store(autocommit=True, index=("v",))
    s.bulkload({"a": {"v": 1}, "b": {"v": 2}})
    s.put("c", {"v": 1})
    assert s.get("a") == {"v": 1} and s.get("none") is None
    ta = s.begin()
    s.update(ta, "a", {"v": 9})
    with pytest.raises(mvcc.Aborted):
        s.bulkload({"d": {"v": 1}, "a": {"v": 3}})  # all or nothing
    assert s.get("d") is None and s.lookup(ta, "v", 1) == {"c": {"v": 1}} and s.lookup(ta, "v", 9) == {"a": {"v": 9}}
    old = s.begin()
    s.commit(ta)
    assert set(s.lookup(old, "v", 1)) == {"a", "c"} and s.lookup(old, "v", 9) == {}
    s.remove("c")
    assert s.get("c") is None and set(s.lookup(s.begin(), "v", 1)) == set()
    plain = mvcc.Store()
    plain.put("a", {"v": 1})
    assert plain.get("a") == {"v": 1}
    with pytest.raises(RuntimeError):
        plain.remove("a")
    plain.begin()
    for late in (lambda: plain.put("b", {}), lambda: plain.get("a"), lambda: plain.bulkload({})):
        with pytest.raises(RuntimeError):
            late()
    with pytest.raises(ValueError):
        mvcc.Store("dirty")


def test_indexed_reads_are_the_scans():
    import random

    rng = random.Random(3)
    stores = [mvcc.Store(index=x) for x in ((), ("v",))]
    for s in stores:
        s.load({str(k): {"v": k % 3} for k in range(12)})
    for _ in range(60):
        key, v, drop = str(rng.randrange(12)), rng.randrange(3), rng.random() < 0.2
        got = []
        for s in stores:
            ta = s.begin()
            s.delete(ta, key) if drop else s.update(ta, key, {"v": v})
            got.append([s.lookup(ta, "v", x) for x in range(3)])
            s.commit(ta)
        assert got[0] == got[1]


def test_no_schedule_of_two_validated_transactions_is_unserializable():
    bodies = {0: [("read", ()), ("update", ("x", mvcc._plus("y", 1))), ("commit", ())], 1: [("read", ()), ("update", ("y", mvcc._plus("x", 1))), ("commit", ())]}
    found = set()
    for order in mvcc.interleavings([3, 3]):
        at = {0: iter(bodies[0]), 1: iter(bodies[1])}
        schedule = [(t, *next(at[t])) for t in order]
        objects = {"x": {"v": 1}, "y": {"v": 5}}
        assert mvcc.verdict(objects, mvcc.run_schedule(objects, schedule)).startswith("serializable")
        found.add(mvcc.verdict(objects, mvcc.run_schedule(objects, schedule, "none")))
    assert "not serializable" in found


def test_layers_evict_and_delete():
    disk = {i: str(i) for i in range(5)}
    layer = storage.Layer(disk, 3)
    layer.fix(4), layer.get(0), layer.get(2)
    assert layer.size == 3 and layer.evict() == 2 and layer.evict() == 0
    with pytest.raises(RuntimeError):
        layer.evict()
    with pytest.raises(RuntimeError):
        layer.delete(4)
    layer.unfix(4), layer.delete(4)
    assert layer.size == 0 and set(disk) == {0, 1, 2, 3}


def test_layers_and_nesting():
    disk = {i: str(i) for i in range(5)}
    layer = storage.Layer(disk, 2)
    layer.fix(0), layer.get(3), layer.get(1)
    assert set(layer.pages) == {0, 1}
    layer.put(4, "x")
    assert disk[4] == "x" and set(layer.pages) == {0, 4}
    assert sorted(storage.factorisations(12)) == [[2, 2, 3], [2, 3, 2], [2, 6], [3, 2, 2], [3, 4], [4, 3], [6, 2]]
    assert len(storage.nested([4, 8], 0, storage.Device("d", 1, 1, 1, 1)).devices()) == 32
