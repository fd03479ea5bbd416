"""All queries outside the llm subpackage, and their SQL equivalents. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions, streaming
from .operators import indexes, mvcc, online, predicates, relational, resultdb, sharedscan, sorting, storage
from .plans import catalog, joinorder
from .sources import column_linearised, first_n, relation, row_linearised, table, table_size_kb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def each(build: Callable[[str], tuple[Callable, str | None]], names: list[str]) -> None:
    for n in names:
        f, sql = build(n)
        query(sql, n)(f)


# Scans and sinks


@query("select * from customer")
def scan_relation(spark, d):
    return table(spark, d, "customer")


@query("select * from part order by p_partkey limit 101")
def scan_first_n(spark, d):
    return first_n(table(spark, d, "part"), "p_partkey", 100.5)


@query("select (sum(4 + 4 + 8 + length(c_name) + length(c_mktsegment) - 4) / 1000.0)::double as kb from customer")
def table_size_kb_(spark, d):
    return table_size_kb(table(spark, d, "customer"))


QUERIES["table_size_kb"], ORACLE_SQL["table_size_kb"] = QUERIES.pop("table_size_kb_"), ORACLE_SQL.pop("table_size_kb_")

_LAYOUT = ["p_name", "p_brand", "p_size"]


@query("select p_partkey * 3 + k as pos, [p_name, p_brand, p_size::varchar][k + 1] as value from part, (select unnest([0, 1, 2]) as k)")
def layout_row_linearised(spark, d):
    return row_linearised(table(spark, d, "part"), "p_partkey", _LAYOUT)


@query("select k * (select count(*) from part) + p_partkey as pos, [p_name, p_brand, p_size::varchar][k + 1] as value from part, (select unnest([0, 1, 2]) as k)")
def layout_column_linearised(spark, d):
    return column_linearised(table(spark, d, "part"), "p_partkey", _LAYOUT)


@query("select count(*) as num_tuples from lineitem")
def count_sink(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("num_tuples"))


# Filters


@query("select * from lineitem where l_quantity > 45 and (l_discount < 0.02 or l_returnflag = 'R')")
def filter_expr(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45 and (l_discount < 0.02 or l_returnflag = 'R')")


def _where(name):
    op, sql = {"eq": ("==", "="), "ne": ("!=", "<>"), "lt": ("<", "<"), "le": ("<=", "<="), "gt": (">", ">"), "ge": (">=", ">=")}[name[6:]]
    return (lambda spark, d: table(spark, d, "part").filter(predicates.where("p_size", op, 25))), f"select * from part where p_size {sql} 25"


each(_where, ["where_eq", "where_ne", "where_lt", "where_le", "where_gt", "where_ge"])


@query("select * from orders where o_orderstatus = 'F' or o_totalprice < 5000 or o_custkey = 7")
def where_disjunction(spark, d):
    w = predicates.where
    return table(spark, d, "orders").filter(predicates.disjunction(w("o_orderstatus", "==", "F"), w("o_totalprice", "<", 5000), w("o_custkey", "==", 7)))


@query("select * from nation")
def where_true(spark, d):
    return table(spark, d, "nation").filter(predicates.TRUE())


@query("select * from nation where false")
def where_false(spark, d):
    return table(spark, d, "nation").filter(predicates.disjunction(predicates.FALSE(), predicates.FALSE()))


@query("select * from part where p_brand = 'Brand#2' and p_type = 'ECONOMY'")
def mask_and(spark, d):
    p = table(spark, d, "part").withColumns({"m1": F.col("p_brand") == "Brand#2", "m2": F.col("p_type") == "ECONOMY"})
    return p.filter(F.col("m1") & F.col("m2")).drop("m1", "m2")


@query("select o_custkey, o_totalprice from orders order by o_orderkey limit 314 offset 100")
def project_limit_offset(spark, d):
    return relational.page(table(spark, d, "orders"), 100, 314, F.col("o_orderkey")).select("o_custkey", "o_totalprice")


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey = 42")
def prepared_point_query(spark, d):
    p = catalog.Prepared(spark)
    q = p.prepare("select c_custkey, c_name, c_acctbal from {customer} where c_custkey = :key", ("key",))
    return p.execute(q, {"key": 42}, customer=table(spark, d, "customer"))


@query("select 'cheap' as query, count(*) as n from part where p_retailprice < 1000 union all select 'large', count(*) from part where p_size > 40")
def prepared_batch(spark, d):
    """Both queries are answered by one scan."""
    p = catalog.Prepared(spark)
    a, b = p.prepare_clause("p_retailprice < :most", ("most",)), p.prepare_clause("p_size > :least", ("least",))
    return sharedscan.counts(spark, table(spark, d, "part"), p.clauses({"cheap": (a, {"most": 1000}), "large": (b, {"least": 40})}))


@query("select 'cheap' as query, p_partkey from part where p_retailprice < 1000 union all select 'large', p_partkey from part where p_size > 40 union all select 'none', p_partkey from part where p_size = -1")
def prepared_batch_rows(spark, d):
    p = catalog.Prepared(spark)
    a, b = p.prepare_clause("p_retailprice < :most", ("most",)), p.prepare_clause("p_size > :least", ("least",))
    c = p.prepare_clause("p_size = :size", ("size",))
    return sharedscan.lists(table(spark, d, "part"), p.clauses({"cheap": (a, {"most": 1000}), "large": (b, {"least": 40}), "none": (c, {"size": -1})})).select("query", "p_partkey")


# Joins


def _customers_orders(spark, d):
    return table(spark, d, "customer"), table(spark, d, "orders")


@query("select orders.*, customer.* from orders join customer on o_custkey = c_custkey")
def hash_join_inner(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.hash_join(c, o, "c_custkey", "o_custkey")


@query("select orders.*, customer.* from orders join customer on o_custkey = c_custkey where o_totalprice < 10000")
def hash_join_filtered(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.hash_join(c, o.filter(predicates.where("o_totalprice", "<", 10000)), "c_custkey", "o_custkey")


@query("""select n.n_name, n.k, r.r_name from (select n_name, nullif(n_regionkey, 0) as k from nation) n
join (select r_name, nullif(r_regionkey, 0) as k from region) r on n.k is not distinct from r.k""")
def hash_join_null_safe(spark, d):
    n = table(spark, d, "nation").select("n_name", F.nullif("n_regionkey", F.lit(0)).alias("k"))
    r = table(spark, d, "region").select("r_name", F.nullif("r_regionkey", F.lit(0)).alias("rk"))
    return relational.hash_join(r, n, "rk", "k", null_safe=True).drop("rk")


@query("select * from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def semi_join(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.semi_join(c, o.filter("o_totalprice > 400000"), "c_custkey", "o_custkey")


@query("select * from customer where c_custkey in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 49)")
def semi_join_over_join(spark, d):
    c, o = _customers_orders(spark, d)
    l = table(spark, d, "lineitem").filter("l_quantity > 49")
    return relational.semi_join(c, relational.hash_join(l, o, "l_orderkey", "o_orderkey"), "c_custkey", "o_custkey")


@query("select c_name, o_orderkey, p_name, l_quantity from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size > 45")
def three_way_join(spark, d):
    c, o = _customers_orders(spark, d)
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size > 45")
    x = relational.hash_join(p, l, "p_partkey", "l_partkey")
    x = relational.hash_join(o, x, "o_orderkey", "l_orderkey")
    return relational.hash_join(c, x, "c_custkey", "o_custkey").select("c_name", "o_orderkey", "p_name", "l_quantity")


@query("select * from nation, region where n_regionkey <= r_regionkey")
def nested_loop_oracle(spark, d):
    return relational.nested_loop(table(spark, d, "nation"), table(spark, d, "region"), F.col("n_regionkey") <= F.col("r_regionkey"))


_DIST = "select c_name, o_totalprice from customer join orders on c_custkey = o_custkey where c_acctbal < 0"


@query(_DIST)
def dist_join_broadcast(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.hash_join(relational.if_small(c.filter("c_acctbal < 0")), o, "c_custkey", "o_custkey").select("c_name", "o_totalprice")


@query(_DIST)
def dist_join_semi_reduced(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.semi_reduced_join(c.filter("c_acctbal < 0"), o, "c_custkey", "o_custkey").select("c_name", "o_totalprice")


@query("select distinct c_name, o_totalprice from customer join orders on c_custkey = o_custkey where c_acctbal < 0")
def dist_join_copartitioned(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.copartitioned_join(c.filter("c_acctbal < 0"), o, "c_custkey", "o_custkey").select("c_name", "o_totalprice").distinct()


@query("""with c as (select * from customer where c_acctbal < 0), k as (select distinct c_custkey from c), o as (select * from orders where o_custkey in (select c_custkey from k))
select 'send_all' as strategy, (select count(*) from c) as rows, (select count(*) * 40 from c) as bytes union all
select 'semi_reduced', (select count(*) from k) + (select count(*) from o), (select count(*) * 8 from k) + (select count(*) * 48 from o) union all select 'copartitioned', 0, 0""")
def dist_join_shipped(spark, d):
    c, o = _customers_orders(spark, d)
    return relational.shipped(c.filter("c_acctbal < 0"), o, "c_custkey", "o_custkey", {"left": 40, "right": 48, "key": 8})


@query("select c_mktsegment as x from customer union select o_orderpriority from orders")
def union_distinct(spark, d):
    c, o = _customers_orders(spark, d)
    return c.select(F.col("c_mktsegment").alias("x")).union(o.select("o_orderpriority")).distinct()


# Result sub-databases

_GRAPH = resultdb.graph_of([("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
_RDB_WHERE = "c_mktsegment = 'BUILDING' and o_totalprice < 30000 and l_quantity > 40"
_RDB_FROM = f"from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where {_RDB_WHERE}"


def _relations(spark, d):
    c, o = _customers_orders(spark, d)
    return {"customer": c.filter("c_mktsegment = 'BUILDING'"), "orders": o.filter("o_totalprice < 30000"), "lineitem": table(spark, d, "lineitem").filter("l_quantity > 40")}


def _resultdb(name):
    _, how, rel = name.split("_")

    def run(spark, d):
        rels = _relations(spark, d)
        if how == "yannakakis":
            return resultdb.result_database(rels, _GRAPH, "orders")[rel].distinct()
        joined = resultdb.join_all(rels, _GRAPH, "orders")
        return resultdb.dynamic(relational.checkpointed(joined) if how == "materialized" else joined, rels[rel].columns)

    return run, f"select distinct {rel}.* {_RDB_FROM}"


each(_resultdb, [f"resultdb_{h}_{r}" for h in ("dynamic", "materialized", "yannakakis") for r in ("customer", "orders", "lineitem")])


@query(f"select c_name, o_orderkey, l_linenumber, l_quantity {_RDB_FROM}")
def yannakakis_join(spark, d):
    return resultdb.yannakakis(_relations(spark, d), _GRAPH, "orders").select("c_name", "o_orderkey", "l_linenumber", "l_quantity")


@query("""select distinct s.s_suppkey, s.s_nationkey from supplier s join lineitem l on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey
join customer c on c_custkey = o_custkey and c_nationkey = s_nationkey""")
def resultdb_cyclic_fallback(spark, d):
    c, o = _customers_orders(spark, d)
    rels = {"supplier": table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "lineitem": table(spark, d, "lineitem"), "orders": o, "customer": c}
    g = resultdb.graph_of([("supplier", "s_suppkey", "lineitem", "l_suppkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "supplier", "s_nationkey")])
    j = relational.hash_join(o, relational.hash_join(rels["supplier"], rels["lineitem"], "s_suppkey", "l_suppkey"), "o_orderkey", "l_orderkey")
    j = j.join(c, (c["c_custkey"] == j["o_custkey"]) & (c["c_nationkey"] == j["s_nationkey"]))
    return resultdb.result_database(rels, g, "supplier", j)["supplier"]


# Aggregates and online aggregation


@query("select coalesce(max(l_quantity), '-infinity'::double) as max_b from lineitem")
def max_agg(spark, d):
    return table(spark, d, "lineitem").agg(F.coalesce(F.max("l_quantity"), F.lit(float("-inf"))).alias("max_b"))


@query("select round(avg(c_acctbal), 4) as avg_x from customer")
def avg_single_column(spark, d):
    return table(spark, d, "customer").agg(F.round(F.avg("c_acctbal"), 4).alias("avg_x"))


@query("select l_linenumber, count(*) as n from lineitem group by l_linenumber")
def group_count(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("select cast(floor(o_totalprice / 25000) as bigint) as bin, count(*) as n from orders group by 1")
def histogram_equi_width(spark, d):
    return table(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 25000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select event_id, value, max(value) over (order by event_id) as running_max from events")
def online_max_running(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return online.running_max(e, "event_id", "value")


@query("""with s as (select event_id, count(*) over w as n, sum(round(value * 100)) over w as s1, sum(round(value * 100) * round(value * 100)) over w as s2 from events window w as (order by event_id))
select event_id, n, s1 / n as mean, round(1.96 * sqrt(greatest((s2 - s1 * s1 / n) / nullif(n - 1, 0), 0) / n), 4) as half from s""")
def online_avg_ci(spark, d):
    # In whole cents, so that sums don't depend on the order of addition.
    e = table(spark, d, "events").select("event_id", F.round(F.col("value") * 100).alias("cents"))
    return online.running_mean(e, "event_id", "cents").select("event_id", "n", "mean", F.round("half", 4).alias("half"))


@query("select event_type, max(value) as max_value, count(*) as n from events group by event_type")
def stream_online_max(spark, d):
    return streaming.online_max(spark, f"{d}/events*.parquet", table(spark, d, "events").schema, "value", "event_type")


# Sorting and top-k


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (order by {', '.join(_LINE_ORDER)}) - 1 as rank from lineitem")
def external_sort(spark, d):
    """Ranks make the order a part of the result; rows that are equal in all keys are alike but for their ranks."""
    return sorting.ranked(table(spark, d, "lineitem").select(*_LINE_ORDER), *map(F.col, _LINE_ORDER)).drop("l_suppkey")


@query("""with r as (select cast(floor(o_orderkey / 1000) as bigint) as run, count(*) as n_rows, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1)
select *, row_number() over (order by n_rows, run) - 1 as place from r""")
def sort_run_metadata(spark, d):
    return sorting.runs(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 1000)


_TOPK = "select c_name, c_custkey from customer order by c_name desc, c_custkey limit 10"


@query(_TOPK)
def topk_sort_cut(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_custkey")
    return c.orderBy(F.desc("c_name"), "c_custkey").limit(10)


@query(_TOPK)
def topk_heap(spark, d):
    return relational.top_k(table(spark, d, "customer").select("c_name", "c_custkey"), 10, F.desc("c_name"), F.col("c_custkey"))


# Shared scans

_SHARED_SQL = {"q1": "l_linenumber = 7", "q2": "l_quantity = 32", "q3": "l_quantity = 1", "q4": "l_linenumber = 99"}


def _shared():
    return {n: F.expr(p) for n, p in _SHARED_SQL.items()}


_KEYS = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]


@query(" union all ".join(f"select '{n}' as query, {', '.join(_KEYS)} from lineitem where {p}" for n, p in _SHARED_SQL.items()))
def shared_scan_lists(spark, d):
    return sharedscan.lists(table(spark, d, "lineitem").select(*_KEYS), _shared())


@query(f"select {', '.join(_KEYS)}, tags from (select *, concat_ws(',', {', '.join(f'case when {p} then {chr(39)}{n}{chr(39)} end' for n, p in _SHARED_SQL.items())}) as tags from lineitem) where tags <> ''")
def shared_scan_tagged(spark, d):
    return sharedscan.tagged(table(spark, d, "lineitem").select(*_KEYS), _shared()).withColumn("tags", F.array_join("tags", ","))


@query(" union all ".join(f"select '{n}' as query, count(*) as n from lineitem where {p}" for n, p in _SHARED_SQL.items()))
def shared_scan_counts(spark, d):
    return sharedscan.counts(spark, table(spark, d, "lineitem"), _shared())


@query(" union all ".join(f"select '{n}' as query, {', '.join(_KEYS)} from lineitem where {p}" for n, p in _SHARED_SQL.items()))
def shared_scan_query_index(spark, d):
    queries = relation(spark, [("q1", "l_linenumber", 7.0), ("q2", "l_quantity", 32.0), ("q3", "l_quantity", 1.0), ("q4", "l_linenumber", 99.0)], "query string, attribute string, constant double")
    return sharedscan.by_index(table(spark, d, "lineitem").select(*_KEYS), queries)


@query("""with n as (select count(*) as n from events), q as (select * from (values ('a', 0::bigint), ('b', 4711), ('c', 99)) t(query, joined))
select query, event_id, cast((event_id - joined % n + n) % n as bigint) as step from events, n, q where event_type = 'purchase'""")
def clock_scan_order(spark, d):
    """Queries that join a cyclic scan at different places: one scan serves all, and each is done after a full round."""
    e = table(spark, d, "events")
    joined = relation(spark, [("a", 0), ("b", 4711), ("c", 99)], "query string, joined long")
    return sharedscan.clock_scan(e.where("event_type = 'purchase'"), "event_id", e.agg(F.count("*").alias("n")), joined).select("query", "event_id", "step")


# Indexes


@query("select s_nationkey, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as vals from supplier group by s_nationkey")
def multimap_lookup(spark, d):
    m = indexes.multimap(table(spark, d, "supplier"), "s_nationkey", "s_suppkey")
    return m.select("s_nationkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("vals"))


@query("select p_partkey, p_size from part where p_size <> 7 and p_retailprice < 1200 union all select -1, 3")
def index_get_all_where(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    i = indexes.Index(p, "p_size").remove(relation(spark, [(7,)], "p_size int")).put(relation(spark, [(-1, 3, 1.0)], "p_partkey long, p_size int, p_retailprice double"))
    return i.get_all(predicates.where("p_retailprice", "<", 1200)).select("p_partkey", "p_size")


@query("select p_partkey from part where p_size between 10 and 12 or p_size = 40")
def index_get_and_range(spark, d):
    i = indexes.Index(table(spark, d, "part"), "p_size")
    return i.range(10, 12).union(i.get(40)).select("p_partkey")


def _sizes(spark, d):
    return indexes.bitmap_index(table(spark, d, "part"), "p_size", "p_partkey")


@query("select p_size as key, count(*) as n from part group by p_size")
def bitmap_eq_count(spark, d):
    return _sizes(spark, d).groupBy("key").agg(F.sum(F.bitmap_count("bits")).cast("long").alias("n"))


@query("select count(*) as n from part where p_size in (3, 5, 8) and p_type = 'SMALL'")
def bitmap_eq_and_or(spark, d):
    some = indexes.bitmap_or(_sizes(spark, d).where(F.col("key").isin(3, 5, 8)))
    small = indexes.bitmap_index(table(spark, d, "part"), "p_type", "p_partkey").where("key = 'SMALL'").select("bucket", "bits")
    return indexes.bitmap_cardinality(indexes.bitmap_and(some, small))


@query("select count(*) as n from part where p_size < 20")
def bitmap_range_lt(spark, d):
    return indexes.bitmap_cardinality(indexes.at_most(indexes.range_encoded(_sizes(spark, d)), 19))


@query("select count(*) as n from part where p_size >= 30 or p_size = 4")
def bitmap_range_ge_or_eq(spark, d):
    """At least 30: the rows that the range encoding doesn't have at 29."""
    i = _sizes(spark, d)
    least = indexes.bitmap_and_not(indexes.bitmap_or(i), indexes.at_most(indexes.range_encoded(i), 29))
    return indexes.bitmap_cardinality(indexes.bitmap_or(least.unionByName(i.where("key = 4").select("bucket", "bits"))))


@query("select count(*) as n from part where p_size between 10 and 20")
def bitmap_range_between(spark, d):
    e = indexes.range_encoded(_sizes(spark, d))
    low, high = indexes.bitmap_cardinality(indexes.at_most(e, 9), "lo"), indexes.bitmap_cardinality(indexes.at_most(e, 20), "hi")
    return low.join(high).select((F.col("hi") - F.col("lo")).alias("n"))


@query("select count(*) as n from part")
def bitmap_cardinality(spark, d):
    return indexes.bitmap_cardinality(indexes.bitmap_or(_sizes(spark, d)))


@query("select count(distinct (p_size, p_partkey // 32768)) * 32768 as bits, count(distinct p_size) as n_keys, count(*) as n_set from part")
def bitmap_index_size_bits(spark, d):
    """Of the index as it is stored: a bitmap of 4096 bytes for each key and bucket of rows."""
    i = _sizes(spark, d)
    return i.agg(F.sum(F.octet_length("bits") * 8).cast("long").alias("bits"), F.countDistinct("key").alias("n_keys"), F.sum(F.bitmap_count("bits")).cast("long").alias("n_set"))


@query("""select p_partkey, p_partkey & p_size::bigint as a, p_partkey | p_size::bigint as o, xor(p_partkey, p_size::bigint) as x, ~p_partkey as n,
bit_count(p_partkey)::bigint as ones, (p_partkey >> 2) & 1 as third, p_partkey & (-p_partkey) as lsb from part""")
def bitseq_algebra(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    return table(spark, d, "part").select(
        "p_partkey", k.bitwiseAND(s).alias("a"), k.bitwiseOR(s).alias("o"), k.bitwiseXOR(s).alias("x"), F.bitwise_not(k).alias("n"),
        F.bit_count(k).cast("long").alias("ones"), F.getbit(k, F.lit(2)).cast("long").alias("third"), k.bitwiseAND(-k).alias("lsb"))


_WAH_SQL = """
with n as (select max(p_partkey) + 1 as n from part), c as (select unnest(range((select (n + 6) // 7 from n))) as chunk, n from n),
k as (select distinct p_size as key from part),
s as (select p_size as key, p_partkey // 7 as chunk, count(*) as set_, sum(1::bigint << (p_partkey % 7)::int)::bigint as bits from part group by 1, 2),
a as (select k.key, c.chunk, coalesce(set_, 0) as set_, coalesce(bits, 0) as bits, least(7, n - c.chunk * 7) as width from k cross join c left join s on s.key = k.key and s.chunk = c.chunk),
b as (select *, case when set_ = 0 then 'zero' when set_ = width then 'one' else 'literal' end as kind from a),
g as (select *, chunk - row_number() over (partition by key, kind order by chunk) as island from b),
r as (select key, min(chunk) as chunk, kind, count(*) as run, null::bigint as bits from g where kind <> 'literal' group by key, kind, island
  union all select key, chunk, kind, 1, bits from g where kind = 'literal'),
w as (select key, chunk + part * 63 as chunk, kind, least(63, run - part * 63)::bigint as run, bits from (select *, unnest(range((run - 1) // 63 + 1)) as part from r))
"""


def _wah(spark, d):
    p = table(spark, d, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    return indexes.wah_words(p, "p_size", "p_partkey", n, 8)


@query(_WAH_SQL + "select key, chunk, kind, run, bits from w")
def wah_words(spark, d):
    return _wah(spark, d)


@query(_WAH_SQL + "select key, count(*) * 8 as bits from w group by key")
def wah_size_bits(spark, d):
    return _wah(spark, d).groupBy("key").agg((F.count("*") * 8).alias("bits"))


def _wah_sets(spark, d):
    """Words of two sets of parts for each brand, and the number of rows: small ones and sizes up to 20."""
    p = table(spark, d, "part")
    n = p.agg(F.max("p_partkey")).first()[0] + 1
    return indexes.wah_words(p.where("p_type = 'SMALL'"), "p_brand", "p_partkey", n, 8), indexes.wah_words(p.where("p_size <= 20"), "p_brand", "p_partkey", n, 8), n


def _wah_op(name):
    op = name[4:]
    sql = {"and": "(a and b)", "or": "(a or b)", "xor": "(a <> b)"}[op]

    def run(spark, d):
        one, two, n = _wah_sets(spark, d)
        return indexes.wah_positions(indexes.wah_combine(one, two, op, n, 8), n, 8)

    return run, f"select p_brand as key, p_partkey as pos from (select *, p_type = 'SMALL' as a, p_size <= 20 as b, bool_or(a) over (partition by p_brand) and bool_or(b) over (partition by p_brand) as met from part) where {sql} and met"


each(_wah_op, ["wah_and", "wah_or", "wah_xor"])


@query("with b as (select p_brand as key, list(p_partkey) as own from part where p_type = 'SMALL' group by 1) select key, p_partkey as pos from b, part where not list_contains(own, p_partkey)")
def wah_not(spark, d):
    one, _, n = _wah_sets(spark, d)
    return indexes.wah_positions(indexes.wah_not(one, n, 8), n, 8)


@query("select p_brand as key, p_partkey as pos from part where p_size <= 20")
def wah_decode(spark, d):
    _, two, n = _wah_sets(spark, d)
    return indexes.wah_positions(two, n, 8)


@query("select p_brand as key, count(*) as n_set, min(p_partkey) as first, max(p_partkey) as last from part where p_size <= 20 group by 1")
def wah_ends(spark, d):
    _, two, n = _wah_sets(spark, d)
    return indexes.wah_ends(two, n, 8)


def _bloomed(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9000")
    n = rich.count()
    bits = indexes.bloom_bits(n)
    k = indexes.bloom_shape(n, bits)
    return rich, indexes.maybe_in(table(spark, d, "orders"), "o_custkey", indexes.bloom_filter(rich, "c_custkey", bits, k), bits, k)


@query("select * from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)")
def bloom_prefilter_exact(spark, d):
    rich, maybe = _bloomed(spark, d)
    return relational.semi_join(maybe, rich, "o_custkey", "c_custkey")


@query("select 0::bigint as missed")
def bloom_no_false_negatives(spark, d):
    rich, maybe = _bloomed(spark, d)
    sure = relational.semi_join(table(spark, d, "orders"), rich, "o_custkey", "c_custkey")
    return sure.join(maybe, "o_orderkey", "left_anti").agg(F.count("*").alias("missed"))


def _leaves(spark, d):
    """Orders as an ordered index in the shared folder, written anew by each query that asks for it."""
    return indexes.Leaves.build(table(spark, d, "orders"), "o_orderkey", relational.scratch(spark, "leaves"))


@query("select * from orders where o_orderkey = 77")
def btree_point(spark, d):
    return _leaves(spark, d).get(77)


@query("select *, row_number() over (order by o_orderkey) - 1 as rank from orders where o_orderkey between 100 and 200")
def btree_range(spark, d):
    return sorting.ranked(_leaves(spark, d).range(100, 200), F.col("o_orderkey"))


@query("select true as sorted, true as disjoint, count(*) as n from orders")
def btree_invariants(spark, d):
    return _leaves(spark, d).invariants()


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders union all select -5, 'N'")
def btree_put(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("seq"))
    leaves = indexes.Leaves.build(o, "o_orderkey", relational.scratch(spark, "leaves"))
    more = o.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("X"), "seq": F.lit(1)}).unionByName(relation(spark, [(-5, "N", 1)], "o_orderkey long, o_orderstatus string, seq int"))
    return leaves.put(more, "seq", relational.scratch(spark, "leaves")).table().drop("seq")


@query("select user_id, max_by(value, event_id) as value from events group by user_id")
def btree_upsert(spark, d):
    return indexes.upsert(table(spark, d, "events"), "user_id", "value", "event_id")


_BOUNDS = [100_000.0, 200_000.0, 300_000.0, 400_000.0]


@query(f"select cast({' + '.join(f'(o_totalprice > {b})::int' for b in _BOUNDS)} as bigint) as partition, count(*) as n from orders group by 1")
def equi_depth_counts(spark, d):
    return indexes.equi_depth(table(spark, d, "orders"), "o_totalprice", _BOUNDS)


@query("""with b as (select quantile_disc(o_totalprice, [0.25, 0.5, 0.75]) as b from orders)
select cast((o_totalprice > b[1])::int + (o_totalprice > b[2])::int + (o_totalprice > b[3])::int as bigint) as partition, count(*) as n from orders, b group by 1""")
def equi_depth_from_sample(spark, d):
    o = table(spark, d, "orders")
    return indexes.equi_depth(o, "o_totalprice", indexes.depth_bounds(o, "o_totalprice", 4))


def _trie(spark, d, fan_out=10):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    t = indexes.RadixTrie(fan_out, indexes.fitting_levels(c, "c_custkey", fan_out))
    return t, t.route(c, "c_custkey")


@query("""with l as (select cast(max(floor(log10(greatest(c_custkey, 1)))) + 1 as int) as levels from customer), e as (select c_custkey, levels, k from customer, l, (select unnest(range(1, 20)) as k) where k <= levels)
select c_custkey, string_agg(cast((c_custkey // (10::bigint ** (levels - k))::bigint) % 10 as varchar), '' order by k) as path from e group by c_custkey""")
def trie_route(spark, d):
    t, routed = _trie(spark, d)
    return routed.select("c_custkey", F.concat(*[F.col(f"d{k + 1}").cast("string") for k in range(t.levels)]).alias("path"))


@query("""with l as (select cast(max(floor(log10(greatest(c_custkey, 1)))) + 1 as int) as levels from customer)
select k::int as level, cast(c_custkey // (10::bigint ** (levels - k))::bigint as bigint) as prefix, count(*) as n from customer, l, (select unnest(range(1, 20)) as k) where k <= levels group by 1, 2""")
def trie_prefix_counts(spark, d):
    t, routed = _trie(spark, d)
    return t.nodes(routed)


@query("select c_custkey, c_name from customer where c_custkey = 77 union all select 77, 'again'")
def trie_get(spark, d):
    t, routed = _trie(spark, d, 2)
    more = t.route(relation(spark, [(77, "again"), (5, "other")], "c_custkey long, c_name string"), "c_custkey")
    return t.get(routed.unionByName(more), "c_custkey", 77).select("c_custkey", "c_name")


_TRI = [(0.0, 0.0), (50.0, 0.0), (0.0, 2000.0)]


@query("select p_partkey from part where p_size * 2000 + p_retailprice * 50 <= 100000")
def triangle_containment(spark, d):
    return table(spark, d, "part").filter(functions.in_triangle(F.col("p_size"), F.col("p_retailprice"), _TRI)).select("p_partkey")


def _side(x, y, corners):
    e = [f"(({x}) - {px}) * ({qy - py}) - (({y}) - {py}) * ({qx - px})" for (px, py), (qx, qy) in zip(corners, [*corners[1:], corners[0]])]
    return f"(({' and '.join(f'{s} >= 0' for s in e)}) or ({' and '.join(f'{s} <= 0' for s in e)}))"


@query("select p_partkey, case " + " ".join(f"when {_side('p_size', 'p_retailprice', r)} then {k}" for k, r in enumerate(functions.quarters(_TRI))) + " end as region from part")
def triangle_subdivision(spark, d):
    return table(spark, d, "part").select("p_partkey", functions.first_region(F.col("p_size"), F.col("p_retailprice"), functions.quarters(_TRI)).alias("region"))


_POS = "select o_orderkey, o_totalprice, rank() over (order by o_totalprice) - 1 as pos from orders"


def _priced(spark, d, models):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return indexes.learned_positions(o, "o_totalprice", models)


@query(f"""with p as ({_POS}), m as (select min(o_totalprice) as k0, max(o_totalprice) as k1, max(pos) as p1 from p)
select o_orderkey, pos, round((o_totalprice - k0) * (p1 / (k1 - k0)), 3) as pred from p, m""")
def rmi_single_layer_pred(spark, d):
    return _priced(spark, d, 1).select("o_orderkey", "pos", F.round("pred", 3).alias("pred"))


@query(f"""with p as ({_POS}), m as (select min(o_totalprice) as k0, max(o_totalprice) as k1, max(pos) as p1, count(*) as n from p),
a as (select p.*, cast(least(15, greatest(0, floor((o_totalprice - k0) * (p1 / (k1 - k0)) / n * 16))) as int) as model from p, m),
s as (select model, min(o_totalprice) as k0, max(o_totalprice) as k1, min(pos) as p0, max(pos) as p1 from a group by model)
select a.model, count(*) as n, round(max(abs(p0 + coalesce((o_totalprice - k0) * ((p1 - p0) / nullif(k1 - k0, 0)), 0) - pos)), 2) as max_err from a join s on s.model = a.model group by a.model""")
def rmi_two_layer_errors(spark, d):
    return _priced(spark, d, 16).groupBy("model").agg(F.count("*").alias("n"), F.round(F.max("err"), 2).alias("max_err"))


@query(f"""with p as ({_POS}), m as (select min(o_totalprice) as k0, max(o_totalprice) as k1, max(pos) as p1, count(*) as n from p),
a as (select p.*, n, cast(least(15, greatest(0, floor((o_totalprice - k0) * (p1 / (k1 - k0)) / n * 16))) as int) as model from p, m),
s as (select model, min(o_totalprice) as k0, max(o_totalprice) as k1, min(pos) as p0, max(pos) as p1 from a group by model),
e as (select a.*, round(abs(p0 + coalesce((o_totalprice - k0) * ((p1 - p0) / nullif(k1 - k0, 0)), 0) - pos), 3) as err from a join s on s.model = a.model)
select model, max(ceil(err)::bigint + 1) as linear, max(ceil(log2(n + 1))::bigint) as binary, max((2 * ceil(log2(ceil(err) + 1)) + 1)::bigint) as exponential from e group by model""")
def rmi_search_steps(spark, d):
    o = _priced(spark, d, 16).withColumn("err", F.round("err", 3))
    n = table(spark, d, "orders").agg(F.count("*").alias("n"))
    steps = indexes.search_steps(F.col("err"), F.col("n"))
    return o.join(F.broadcast(n)).groupBy("model").agg(*[F.max(c).alias(k) for k, c in steps.items()])


@query(_POS.replace("o_totalprice, rank", "rank"))
def rmi_lower_bound(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return relational.lower_bound(o, "o_totalprice").select("o_orderkey", "pos")


@query("select v as value, (select count(*) from orders where o_totalprice < v) as pos from (select unnest([0.0::double, 1234.5, 250000, 1e9]) as v)")
def lower_bound(spark, d):
    return indexes.lower_bounds(table(spark, d, "orders"), "o_totalprice", [0.0, 1234.5, 250000.0, 1e9])


_X, _Y = "(p_partkey % 64)", "p_size::bigint"
_Z = " + ".join(f"((({_X} >> {i}) & 1) << {2 * i}) + ((({_Y} >> {i}) & 1) << {2 * i + 1})" for i in range(6))


def _z(spark, d):
    x, y = F.pmod(F.col("p_partkey"), F.lit(64)), F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", x.alias("x"), y.alias("y"), functions.z_encode(x, y, 6).alias("z"))


@query(f"select p_partkey, {_Z} as z, lpad(bin({_Z}), 12, '0') as z_code from part")
def zorder_encode(spark, d):
    return _z(spark, d).select("p_partkey", "z", functions.z_text(F.col("z"), 6).alias("z_code"))


@query(f"select p_partkey, {_X} as x, {_Y} as y from part")
def zorder_decode(spark, d):
    x, y = functions.z_decode(F.col("z"), 6)
    return _z(spark, d).select("p_partkey", x.alias("x"), y.alias("y"))


@query(f"select p_partkey, row_number() over (order by {_Z}, p_partkey) - 1 as pos from part")
def zorder_sort(spark, d):
    return relational.position(_z(spark, d), F.col("z"), F.col("p_partkey")).select("p_partkey", "pos")


@query("select p_partkey, " + " + ".join(f"(xor((p_partkey >> {k}) & 1, {(0b101 >> k) & 1}) << {2 - k})" for k in range(3)) + " as platform from part")
def gate_tree_reachable(spark, d):
    return table(spark, d, "part").select("p_partkey", indexes.gate_platform(F.col("p_partkey"), 3, 0b101).alias("platform"))


# Join ordering. The cardinalities of a chain of five relations, by bit set.

_CARDS = {
    0b00001: 5000, 0b00010: 4000, 0b00100: 500, 0b01000: 100, 0b10000: 1000, 0b00011: 100, 0b00110: 500, 0b01100: 100,
    0b11000: 100, 0b00111: 500, 0b01110: 50, 0b11100: 100, 0b01111: 10, 0b11110: 100, 0b11111: 10,
}
_PAIRS = {"dpsize": 73, "dpsub": 42, "dpccp": 20}


def _planner(name):
    algo = name[5:]

    def run(spark, d):
        cost, p, pairs = joinorder.plan(algo, joinorder.chain(5), _CARDS)
        return relation(spark, [(cost, str(p).replace(" ", ""), pairs)], "cost long, plan string, pairs long")

    return run, f"select 10770::bigint as cost, '((((3,2),1),0),4)' as plan, {_PAIRS[algo]}::bigint as pairs"


each(_planner, ["plan_dpsize", "plan_dpsub", "plan_dpccp"])

_ORDER_SQL = "select count(*) as n, round(sum(l_extendedprice), 2) as total from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where p_size < 10 and c_acctbal > 5000"


#: Pairs looked at for a chain of n = 4, by the published counts: (5 n^4 + 6 n^3 - 14 n^2 - 12 n) / 48, (2^(n + 2) - n^2 - 3 n - 4) / 2, (n^3 - n) / 6.
_SHOWN = {"dpsize": 29, "dpsub": 16, "dpccp": 10}


@query(" union all ".join(f"select '{a}' as algorithm, *, {p}::bigint as pairs, true as cheapest from ({_ORDER_SQL})" for a, p in _SHOWN.items()))
def plan_compare(spark, d):
    """The plan of each algorithm is run; cheapest: whether its cost is the least of the three."""
    c, o = _customers_orders(spark, d)
    rels = [c.filter("c_acctbal > 5000"), o, table(spark, d, "lineitem"), table(spark, d, "part").filter("p_size < 10")]
    keys = {(0, 1): ("c_custkey", "o_custkey"), (1, 2): ("o_orderkey", "l_orderkey"), (2, 3): ("l_partkey", "p_partkey")}
    sizes = {1 << i: max(1, relational.size_in_bytes(r)) for i, r in enumerate(rels)}
    plans = {a: joinorder.plan(a, joinorder.chain(4), dict(sizes)) for a in _PAIRS}
    least, out = min(p[0] for p in plans.values()), None
    for a, (cost, p, pairs) in plans.items():
        told = [F.lit(a).alias("algorithm"), F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.lit(pairs).cast("long").alias("pairs"), F.lit(cost == least).alias("cheapest")]
        one = joinorder.execute(p, rels, keys).agg(*told)
        out = one if out is None else out.union(one)
    return out


@query("select unnest([16, 8, 24, 4, 12, 28, 2, 6, 14, 30, 1, 3, 7, 15, 31]::bigint[]) as csg")
def csg_list(spark, d):
    return relation(spark, [(s,) for s in joinorder.connected_sets(joinorder.chain(5))], "csg long")


@query("""with s as (select unnest(range(1, 32)) as a), i as (select a, lo, hi from (select a, (select min(b) from range(5) t(b) where (a >> b::int) & 1 = 1) as lo, (select max(b) from range(5) t(b) where (a >> b::int) & 1 = 1) as hi from s)
where bit_count(a) = hi - lo + 1)
select x.a::bigint as csg, y.a::bigint as cmp from i x join i y on x.hi + 1 = y.lo""")
def ccp_pairs(spark, d):
    return relation(spark, list(joinorder.connected_pairs(joinorder.chain(5))), "csg long, cmp long")


@query("select m::bigint as mask, s::bigint as s from (select unnest([43, 7, 0, 32]) as m), (select unnest(range(1, 64)) as s) where s & ~m = 0")
def subset_enumeration(spark, d):
    return relation(spark, [(m, s) for m in (43, 7, 0, 32) for s in joinorder.subsets(m)], "mask long, s long")


@query("select * from (values ('chain', 10::bigint), ('star', 1::bigint), ('cycle', 10::bigint), ('clique', 27::bigint)) t(graph, neighbours)")
def join_graph_neighbors(spark, d):
    graphs = {"chain": joinorder.chain, "star": joinorder.star, "cycle": joinorder.cycle, "clique": joinorder.clique}
    return relation(spark, [(n, f(5).neighbours(0b00100)) for n, f in graphs.items()], "graph string, neighbours long")


# Versions. Event n is a write that becomes valid at n + 1; five events are a transaction, open for twelve ticks.

_SPAN = 16
_LOG = "select user_id as object_id, event_id + 1 as start, event_type = 'error' as is_delete, value, event_id // 5 as ta from events"
_TAS = "select distinct event_id // 5 as ta, event_id // 5 * 5 as begin_, event_id // 5 * 5 + 12 as commit_ from events"


def _log(spark, d):
    e = table(spark, d, "events")
    ta = F.floor(F.col("event_id") / 5).cast("long")
    return e.select(F.col("user_id").alias("object_id"), (F.col("event_id") + 1).alias("start"), (F.col("event_type") == "error").alias("is_delete"), "value", ta.alias("ta"))


def _tas(spark, d):
    return _log(spark, d).select("ta").distinct().select("ta", (F.col("ta") * 5).alias("begin"), (F.col("ta") * 5 + 12).alias("commit"))


#: After the last write, and in the middle of the writes: the snapshots grow with the table.
_NOW, _THEN = "(select max(event_id) + 2 from events)", "(select max(event_id) // 2 + 2 from events)"


def _times(spark, d):
    """The timestamps of _NOW and _THEN; one number reaches the driver."""
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0] or 0
    return last + 2, last // 2 + 2


def _snap(ts):
    return f"select object_id, start, value from (select *, row_number() over (partition by object_id order by start desc) as r from ({_LOG}) where start < {ts}) where r = 1 and not is_delete"


@query(_snap(_NOW))
def mvcc_snapshot_read(spark, d):
    return mvcc.snapshot(_log(spark, d), _times(spark, d)[0])


@query(f"select * from ({_snap(_NOW)}) where value > 10")
def mvcc_snapshot_filter(spark, d):
    return mvcc.snapshot(_log(spark, d), _times(spark, d)[0]).filter(predicates.where("value", ">", 10))


@query(f"select object_id, max_by(start, start) as deleted_at from ({_LOG}) where start < {_NOW} group by object_id having max_by(is_delete, start)")
def mvcc_after_delete(spark, d):
    log = _log(spark, d).where(F.col("start") < _times(spark, d)[0])
    last = log.groupBy("object_id").agg(F.max_by(F.struct("start", "is_delete"), "start").alias("v"))
    return last.where("v.is_delete").select("object_id", F.col("v.start").alias("deleted_at"))


@query(f"select *, row_number() over (partition by object_id order by start) as version, lead(start) over (partition by object_id order by start) as \"end\" from ({_LOG})")
def mvcc_version_history(spark, d):
    return mvcc.history(_log(spark, d))


@query(f"""with w as (select distinct l.ta, object_id, begin_, commit_ from ({_LOG}) l join ({_TAS}) t on t.ta = l.ta)
select a.ta as first, b.ta as second, a.object_id from w a join w b on a.object_id = b.object_id and a.begin_ < b.begin_ and b.begin_ < a.commit_""")
def mvcc_ww_conflicts(spark, d):
    return mvcc.write_conflicts(_log(spark, d).join(_tas(spark, d), "ta"), _SPAN)


@query(f"select a.ta as a_ta, b.ta as b_ta from ({_TAS}) a join ({_TAS}) b on a.begin_ < b.begin_ and b.begin_ < a.commit_")
def mvcc_overlapping_writers(spark, d):
    return mvcc.overlapping(_tas(spark, d), _SPAN, ["ta", "begin", "commit"], ["ta", "begin"]).select("a_ta", "b_ta")


@query(f"""with o as (select *, case when not lag(is_delete) over w then lag(value) over w end as old, case when not is_delete then value end as new from ({_LOG}) window w as (partition by object_id order by start))
select t.ta as reader, o.ta as writer, o.object_id from ({_TAS}) t join o on o.start > t.begin_ and o.start < t.commit_ and o.ta <> t.ta
where o.old is distinct from o.new and (coalesce(o.old > 50, false) or coalesce(o.new > 50, false))""")
def mvcc_validate_writesets(spark, d):
    return mvcc.read_conflicts(_tas(spark, d), mvcc.with_old_values(_log(spark, d)), lambda v: v > 50, _SPAN)


@query(f"""select not exists (select object_id, value from ({_snap(_THEN)}) where value > 10 except select object_id, value from ({_snap(_NOW)}) where value > 10)
and not exists (select object_id, value from ({_snap(_NOW)}) where value > 10 except select object_id, value from ({_snap(_THEN)}) where value > 10) as same""")
def mvcc_validate_bruteforce(spark, d):
    now, then = _times(spark, d)
    return mvcc.same_result(_log(spark, d), F.col("value") > 10, then, now)


@query(f"""with r as (select distinct ta, object_id from ({_LOG}) where value > 50), w as (select distinct ta, object_id from ({_LOG}) where value <= 50),
x as (select distinct r.ta, w.ta as writer from r join w on r.object_id = w.object_id and r.ta <> w.ta join ({_TAS}) a on a.ta = r.ta join ({_TAS}) b on b.ta = w.ta
where least(a.commit_, b.commit_) > greatest(a.begin_, b.begin_))
select p.ta as one, p.writer as two from x p join x q on p.ta = q.writer and p.writer = q.ta and p.ta < p.writer
where not exists (select 1 from w a join w b on a.object_id = b.object_id where a.ta = p.ta and b.ta = p.writer)""")
def mvcc_write_skew(spark, d):
    """Overlapping transactions that read what the other writes and write nothing in common; high values count as reads."""
    log = _log(spark, d).join(_tas(spark, d), "ta")
    return mvcc.write_skew(log.where("value > 50"), log.where("value <= 50"), _SPAN)


_VERDICTS = {
    "serial": ("serializable", "serializable", "serializable"), "lost update": ("serializable", "serializable", "not serializable"), "dirty write": ("serializable", "serializable", "serializable"),
    "write skew": ("serializable", "not serializable", "not serializable"), "phantom": ("serializable", "serializable in another order", "serializable in another order"),
    "read-only": ("serializable", "serializable", "serializable"), "own abort": ("serializable", "serializable", "serializable"),
}


@query(" union all ".join(f"select '{n}' as scenario, '{i}' as isolation, '{v}' as verdict" for n, x in _VERDICTS.items() for i, v in zip(("serializable", "snapshot", "none"), x)))
def mvcc_scenarios(spark, d):
    rows = [(n, i, mvcc.verdict(objects, mvcc.run_schedule(objects, schedule, i))) for n, (objects, schedule) in mvcc.SCENARIOS.items() for i in ("serializable", "snapshot", "none")]
    return relation(spark, rows, "scenario string, isolation string, verdict string")


@query("""with c as (select event_id // 5 as ta, max(event_id) + 1 as at from events group by 1 having count(*) = 5 and max(value) < 60)
select user_id as object_id, max_by(value, event_id) as value from events e join c on c.ta = e.event_id // 5 group by user_id having not max_by(event_type = 'error', event_id)""")
def mvcc_journal_replay(spark, d):
    e = table(spark, d, "events").withColumn("ta", F.floor(F.col("event_id") / 5).cast("long"))
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    writes = e.select((F.col("event_id") * 2).alias("seq"), "ta", kind.alias("kind"), F.col("user_id").alias("object_id"), "value")
    ends = e.groupBy("ta").agg(F.max("event_id").alias("last"), F.count("*").alias("c"), F.max("value").alias("m"))
    ends = ends.select((F.col("last") * 2 + 1).alias("seq"), "ta", F.when((F.col("c") == 5) & (F.col("m") < 60), "commit").otherwise("abort").alias("kind"), F.lit(None).cast("long").alias("object_id"), F.lit(None).cast("double").alias("value"))
    return mvcc.replay(writes.unionByName(ends))


@query(f"select * from ({_snap(_NOW)}) where object_id = 8")
def mvcc_indexed_read(spark, d):
    return mvcc.snapshot(_log(spark, d).filter(predicates.where("object_id", "==", 8)), _times(spark, d)[0])


@query("select event_id // 5 as ta, case when count_if(event_type = 'purchase') > 0 then event_id // 5 * 5 + 12 else event_id // 5 * 5 end as point from events group by event_id // 5 having max(value) < 60")
def mvcc_serial_order(spark, d):
    e = table(spark, d, "events").withColumn("ta", F.floor(F.col("event_id") / 5).cast("long"))
    tas = e.groupBy("ta").agg(F.count_if(F.col("event_type") == "purchase").alias("writes"), (F.max("value") < 60).alias("committed"))
    return mvcc.serial_order(tas.withColumns({"begin": F.col("ta") * 5, "commit": F.col("ta") * 5 + 12}))


@query("""with recursive s(lengths, left_, schedule, last) as (select l, l, '', -1 from (values ([2, 2]), ([1, 3]), ([2, 1, 2]), ([3])) t(l)
union all select lengths, list_transform(left_, lambda x, j: case when j = i + 1 then x - 1 else x end), schedule || i::varchar, i from s, range(3) r(i) where i < len(lengths) and left_[i + 1] > 0 and (i = 0 or left_[i] < lengths[i]))
select array_to_string(lengths, ',') as lengths, schedule from s where list_sum(left_) = 0""")
def schedule_interleavings(spark, d):
    cases = [[2, 2], [1, 3], [2, 1, 2], [3]]
    return relation(spark, [(",".join(map(str, c)), "".join(map(str, s))) for c in cases for s in mvcc.interleavings(c)], "lengths string, schedule string")


# Storage

_RAID_SQL = {
    0: "select b as block, b % 5 as disk, b // 5 as row, false as parity from t",
    1: "select b as block, k as disk, b as row, false as parity from t, (select unnest(range(5)) as k)",
    4: "select b as block, b % 4 as disk, b // 4 as row, false as parity from t union all select b, 4, b // 4, true from t",
    5: "select block, case when s >= p then s + 1 else s end as disk, row, false as parity from u union all select block, p, row, true from u",
}
_RAID_SQL = {k: f"with t as (select unnest(range(1000)) as b), u as (select b as block, b % 4 as s, b // 4 as row, (b // 4 - 1 + 5) % 5 as p from t) {v}" for k, v in _RAID_SQL.items()}


def _raid(name):
    level = int(name[4])
    return (lambda spark, d: storage.assignment(spark, level, 1000, 5)), _RAID_SQL[level]


each(_raid, ["raid0_assignment", "raid1_assignment", "raid4_assignment", "raid5_assignment"])

_DISK = storage.Device("disk", 250, 200, 100, 80)


def _arrays(levels):
    return [(f"RAID {lv}", storage.nested([4], lv, _DISK)) for lv in levels]


@query("""select * from (values ('RAID 0', 1000::bigint, 800::bigint, 400::bigint, 320::bigint, 1.0::double), ('RAID 1', 1000, 200, 400, 80, 4.0),
('RAID 5', 750, 600, 400, 89, 1.3333)) t(level, seq_read, seq_write, read_iops, write_iops, blow_up)""")
def raid_cost_model(spark, d):
    rows = [(n, a.read, a.write, a.read_iops, a.write_iops, round(a.blow_up, 4)) for n, a in _arrays((0, 1, 5))]
    return relation(spark, rows, "level string, seq_read long, seq_write long, read_iops long, write_iops long, blow_up double")


@query("select bit_count(m)::bigint as failed, count_if(bit_count(m) <= 1) as survived, count(*) as cases from (select unnest(range(64)) as m) group by 1")
def raid_survival_counts(spark, d):
    return storage.survivable_masks(spark, 5, 6)


#: RAID over RAID of three groups of two or two of three, by masks of failed disks: how many groups have lost more than they may.
_NESTED_SQL = """with m as (select unnest(range(64)) as m), c as (select * from (values ('RAID 10', 3, 2, 1, 0), ('RAID 50', 2, 3, 1, 0), ('RAID 01', 2, 3, 0, 1), ('RAID 51', 2, 3, 1, 1)) t(config, groups, width, inner_, outer_)),
g as (select config, m, outer_, (select count(*) from range(groups) r(i) where bit_count((m >> (i * width)::int) & ((1 << width) - 1)) > inner_) as dead from m, c)
select config, bit_count(m)::bigint as failed, count_if(dead <= outer_) as survived, count(*) as cases from g where bit_count(m) between 1 and 4 group by 1, 2"""


@query(_NESTED_SQL)
def raid_config_metrics(spark, d):
    def two(top, level, outer, inner):
        return storage.Array(top, tuple(storage.Array(level, tuple(storage.Device(f"{i}.{j}", 250, 200, 100, 80) for j in range(inner))) for i in range(outer)))

    arrays = {"RAID 10": two(0, 1, 3, 2), "RAID 50": two(0, 5, 2, 3), "RAID 01": two(1, 0, 2, 3), "RAID 51": two(1, 5, 2, 3)}
    return relation(spark, [(n, k, *a.survived(k)) for n, a in arrays.items() for k in (1, 2, 3, 4)], "config string, failed long, survived long, cases long")


@query(f"with l as ({_RAID_SQL[5]}), m as (select row, count(distinct disk) as missing from l where disk in (0, 1) group by row) "
       "select block, disk not in (0, 1) or missing = 1 as readable from l left join m on m.row = l.row where not parity")
def raid_readable_blocks(spark, d):
    return storage.readable_blocks(storage.assignment(spark, 5, 1000, 5), [0, 1])


@query("""with recursive f(factors, rest, last) as (select k::varchar, 24 // k, k from range(2, 24) t(k) where 24 % k = 0
union all select factors || '*' || k::varchar, rest // k, k from f, range(2, 24) t(k) where k <= rest and rest % k = 0)
select factors from f where rest = 1""")
def raid_factorisations(spark, d):
    return relation(spark, [("*".join(map(str, f)),) for f in storage.factorisations(24)], "factors string")
