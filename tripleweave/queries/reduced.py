"""The store on disk, Bloom filters, semi-join reductions and the queries that read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators import reductions as red
from tripleweave.operators import workload as w
from tripleweave.plans import access
from tripleweave.plans.paths import P
from tripleweave.plans.pattern import match, needs
from tripleweave.queries import query
from tripleweave.queries.fixtures import SQL_COUNTS, table, triples
from tripleweave.sources import scratch
from tripleweave.sources.store import Store

SUB, OBJ = red.SUBJECT, red.OBJECT

# The patterns the reduced tables are built for: property, then its own and the other items.
PATTERNS = {
    "ord__customer": [
        ["ord__customer_TRPS", "ord__big_TRPS"],
        ["ord__customer_TRPS", "ord__returnedPart_TRPS"],
        ["ord__customer_TRPS", "ord__big_TRPS", "ord__returnedPart_TRPS"],
        ["ord__customer_TRPO", "cust__segment_TRPS"],
    ],
    "ord__part": [
        ["ord__part_TRPS", "ord__big_TRPS"],
        ["ord__part_TRPO", "ord__returnedPart_TRPO"],
    ],
    "ord__price": [["ord__price_TRPS", "ord__big_TRPS"]],
    "doc__lang": [
        ["doc__lang_TRPS", "doc__quality_TRPS"],
        ["doc__lang_TRPS", "doc__quality_TRPS", "doc__toxic_TRPS"],
    ],
    "supp__nation": [
        ["supp__nation_TRPS", "supp__lead_TRPO"],
        ["supp__nation_TRPO", "cust__nation_TRPO"],
    ],
}

_STORES: dict[tuple, Store] = {}
_REDUCED: set[tuple] = set()


def catalog(spark) -> DataFrame:
    return reduce(DataFrame.unionByName, [red.catalog_of(spark, p, items) for p, items in PATTERNS.items()])


def store(spark, sf: str, mode: str = "exact") -> Store:
    """The store of all fixture triples in the shared folder, written once per session and mode."""
    key = (spark.sparkContext.applicationId, sf, mode)
    if key not in _STORES:
        _STORES[key] = Store.build(triples(spark, sf).frame(), scratch.new_path(spark, f"store-{mode}"))
    return _STORES[key]


def reduced(spark, sf: str, mode: str = "exact") -> Store:
    """The same store with its reduced tables, which are written when the first query reads them."""
    key = (spark.sparkContext.applicationId, sf, mode)
    st = store(spark, sf, mode)
    if key not in _REDUCED:
        st.add_reductions(catalog(spark), mode)
        _REDUCED.add(key)
    return st


# -- The store -------------------------------------------------------------------------------


@query(f"select prop, n as rows from ({SQL_COUNTS}) where n > 0")
def store_scan(spark, sf):
    return store(spark, sf).frame().groupBy("prop").agg(F.count(F.lit(1)).alias("rows"))


@query("select 'order/' || o_orderkey as o from orders where o_custkey = 7")
def store_pruned_scan(spark, sf):
    return match(store(spark, sf), [("?o", "ord__customer", "customer/7")]).df


@query(f"select prop, n as rows, round(n / sum(n) over (), 6) as ratio from ({SQL_COUNTS}) where n > 0")
def store_stats(spark, sf):
    return store(spark, sf).stats().select("prop", "rows", F.round("ratio", 6).alias("ratio"))


@query(
    f"""select cast(sum(n) as bigint) as num_triples, count(*) as num_properties, count(*) - 5 as num_vp_tables,
        cast(5 as bigint) as num_reduced_tables, cast(sum(n) as bigint) as num_tuples
        from ({SQL_COUNTS}) where n > 0"""
)
def store_db_stats(spark, sf):
    return reduced(spark, sf).db_stats()


@query(
    f"""with s as ({SQL_COUNTS}), m(prop, members, cols) as (values
          ('ord__customer', 'cust__segment,ord__big,ord__customer,ord__returnedPart', 4),
          ('ord__part', 'ord__big,ord__part,ord__returnedPart', 2),
          ('ord__price', 'ord__big,ord__price', 1),
          ('doc__lang', 'doc__lang,doc__quality,doc__toxic', 2),
          ('supp__nation', 'cust__nation,supp__lead,supp__nation', 2))
        select 'REDUCED_' || prop as table_name, n as rows, round(n / (select sum(n) from s), 6) as ratio, members, cols
        from s join m using (prop)"""
)
def partition_catalog(spark, sf):
    return reduced(spark, sf).reduced_tables().select(
        "table_name",
        "rows",
        F.round("ratio", 6).alias("ratio"),
        F.array_join("members", ",").alias("members"),
        F.size("columns").alias("cols"),
    )


# -- Semi-joins ------------------------------------------------------------------------------


@query("select 'doc/' || doc_id as sub, '\"' || lang || '\"' as obj from documents where doc_id in (select doc_id from labels)")
def semi_ss(spark, sf):
    return red.semi(triples(spark, sf), ("doc__lang", SUB), ("doc__quality", SUB))


@query(
    """select 'supplier/' || s_suppkey as sub, 'nation/' || s_nationkey as obj from supplier
       where s_suppkey in (select s_suppkey - s_suppkey % 10 from supplier)"""
)
def semi_so(spark, sf):
    return red.semi(triples(spark, sf), ("supp__nation", SUB), ("supp__lead", OBJ))


@query(
    """select 'user/' || user_id as sub, 'event/' || event_id as obj from events
       where event_type = 'purchase' and event_id in (select event_id from events)"""
)
def semi_os(spark, sf):
    return red.semi(triples(spark, sf), ("user__purchase", OBJ), ("evt__value", SUB))


@query(
    """select 'order/' || l_orderkey as sub, 'part/' || l_partkey as obj from lineitem
       where l_partkey in (select l_partkey from lineitem where l_returnflag = 'R')"""
)
def semi_oo(spark, sf):
    return red.semi(triples(spark, sf), ("ord__part", OBJ), ("ord__returnedPart", OBJ))


@query(
    """select cast(o_orderkey as varchar) as sub, cast(o_custkey as varchar) as obj from orders
       where o_custkey in (select c_custkey from customer where c_acctbal < 0)"""
)
def semi_os_sparse(spark, sf):
    """Orders of customers in debt, from a frame of triples."""

    def triple(rows, sub, prop, obj):
        return rows.select(F.col(sub).cast("string").alias("sub"), F.lit(prop).alias("prop"), F.col(obj).cast("string").alias("obj"))

    orders = triple(table(spark, sf, "orders"), "o_orderkey", "of", "o_custkey")
    debts = triple(table(spark, sf, "customer").where("c_acctbal < 0"), "c_custkey", "owes", "c_acctbal")
    return red.semi(orders.union(debts), ("of", OBJ), ("owes", SUB))


@query(
    """select 'order/' || l_orderkey as sub, 'supplier/' || l_suppkey as obj from lineitem
       where l_suppkey in (select s_suppkey - s_suppkey % 10 from supplier)"""
)
def semi_oo_sparse(spark, sf):
    """Orders from suppliers that lead others, one in ten."""
    return red.semi(triples(spark, sf), ("ord__supplier", OBJ), ("supp__lead", OBJ))


SQL_CUSTOMER_FLAGS = """with big as (select o_orderkey as k from orders where o_totalprice > 450000),
       ret as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'),
       flags as (
         select o_orderkey in (select k from big) as b, o_orderkey in (select k from ret) as r,
           o_custkey in (select c_custkey from customer) as s from orders)"""


@query(
    f"""{SQL_CUSTOMER_FLAGS}
        select 'ord__customer_TRPS_JOIN_ord__big_TRPS' as pattern, count(*) filter (where b) as rows from flags
        union all select 'ord__customer_TRPS_JOIN_ord__returnedPart_TRPS', count(*) filter (where r) from flags
        union all select 'ord__customer_TRPS_JOIN_ord__big_TRPS_JOIN_ord__returnedPart_TRPS',
          count(*) filter (where b and r) from flags
        union all select 'ord__customer_TRPO_JOIN_cust__segment_TRPS', count(*) filter (where s) from flags"""
)
def reduced_table_counts(spark, sf):
    return red.pattern_stats(red.pattern_flags(triples(spark, sf), "ord__customer", PATTERNS["ord__customer"]))


SQL_PAIRS = """with pairs as (
         select 'doc__lang' as prop, 'SS' as type, 'doc__quality' as other,
           (select count(*) from documents where doc_id in (select doc_id from labels)) as rows,
           (select count(*) from documents) as vp_rows
         union all select 'supp__nation', 'SO', 'supp__lead',
           (select count(*) from supplier where s_suppkey in (select s_suppkey - s_suppkey % 10 from supplier)),
           (select count(*) from supplier)
         union all select 'ord__customer', 'OS', 'cust__segment',
           (select count(*) from orders where o_custkey in (select c_custkey from customer)),
           (select count(*) from orders)
         union all select 'ord__supplier', 'OO', 'supp__lead',
           (select count(*) from lineitem where l_suppkey in (select s_suppkey - s_suppkey % 10 from supplier)),
           (select count(*) from lineitem))"""

PAIRS = [
    (("doc__lang", SUB), ("doc__quality", SUB)),
    (("supp__nation", SUB), ("supp__lead", OBJ)),
    (("ord__customer", OBJ), ("cust__segment", SUB)),
    (("ord__supplier", OBJ), ("supp__lead", OBJ)),
]


@query(f"{SQL_PAIRS} select prop, type, other, rows, vp_rows, round(rows / vp_rows, 6) as scale from pairs")
def pair_selectivity(spark, sf):
    sizes = red.pair_stats(triples(spark, sf), PAIRS)
    return sizes.withColumn("scale", F.round("scale", 6))


@query(
    f"""{SQL_PAIRS},
        tables as (
          select prop, type, other, rows from pairs where rows < vp_rows
          union all select prop, 'VP', '', vp_rows from pairs)
        select * from tables qualify row_number() over (partition by prop order by rows, type, other) = 1"""
)
def smallest_table(spark, sf):
    return access.smallest_table(red.pair_stats(triples(spark, sf), PAIRS))


# -- Which table a scan reads, and how much that saves ---------------------------------------

# Three queries; their scans and what the join variables demand follow from the patterns.
QUERIES = {
    "big": [("?o", "ord__customer", "?c"), ("?o", "ord__big", "?b"), ("?o", "ord__part", "?p")],
    "returned": [("?o", "ord__customer", "?c"), ("?o", "ord__returnedPart", "?p")],
    "plain": [("?o", "ord__customer", "?c"), ("?c", "cust__nation", "?n")],
}


def _scan_id(name: str, group: list[tuple], i: int) -> str:
    return f"{name}.{group[i][1].partition('__')[2]}"


def _scans() -> list[tuple]:
    return [(name, _scan_id(name, group, i), group[i][1]) for name, group in QUERIES.items() for i in range(len(group))]


def _needs() -> list[tuple]:
    return [(_scan_id(name, group, int(i)), *rest) for name, group in QUERIES.items() for i, *rest in needs(group)]


SQL_SIZES = """with big as (select o_orderkey as k from orders where o_totalprice > 450000),
       ret as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'),
       n as (select (select count(*) from orders) as ords, (select count(*) from lineitem) as lines,
         (select count(*) from customer) as custs,
         (select count(*) from lineitem where l_returnflag = 'R') as rets, (select count(*) from big) as bigs,
         (select count(*) from lineitem where l_orderkey in (select k from big)) as big_lines,
         (select count(*) from orders where o_orderkey in (select k from ret)) as ret_ords)"""


@query(
    f"""{SQL_SIZES}
        select 'big.customer' as scan_id, 'ord__customer_TRPS_JOIN_ord__big_TRPS' as pattern, bigs as rows, ords as vp_rows from n
        union all select 'big.part', 'ord__part_TRPS_JOIN_ord__big_TRPS', big_lines, lines from n
        union all select 'returned.customer', 'ord__customer_TRPS_JOIN_ord__returnedPart_TRPS', ret_ords, ords from n"""
)
def best_pattern(spark, sf):
    asked = spark.createDataFrame(_needs(), access.NEEDS)
    return access.best_pattern(reduced(spark, sf).patterns(), asked).select("scan_id", "pattern", "rows", "vp_rows")


@query(
    f"""{SQL_SIZES},
        r as (
          select 'big' as query_id, 3 as scans, ords + bigs + lines as vp_rows, bigs + bigs + big_lines as reduced_rows from n
          union all select 'returned', 2, ords + rets, ret_ords + rets from n
          union all select 'plain', 2, ords + custs, ords + custs from n)
        select query_id, cast(scans as bigint) as scans, vp_rows, reduced_rows, round(reduced_rows / vp_rows, 6) as ratio from r"""
)
def reduction_report(spark, sf):
    st = reduced(spark, sf)
    scans = spark.createDataFrame(_scans(), "query_id string, scan_id string, prop string")
    asked = spark.createDataFrame(_needs(), access.NEEDS)
    report = access.reduction_report(scans, asked, st.patterns(), st.stats())
    return report.withColumn("ratio", F.round("ratio", 6))


SQL_BIG_PARTS = """select 'order/' || o_orderkey as o, 'customer/' || o_custkey as c, 'part/' || l_partkey as p
       from orders join lineitem on l_orderkey = o_orderkey where o_totalprice > 450000"""


def _big_parts(source, reductions=None) -> DataFrame:
    group = [("?o", "ord__big", '"true"'), ("?o", "ord__customer", "?c"), ("?o", "ord__part", "?p")]
    return match(source, group, reductions).project("?o", "?c", "?p").df


@query(SQL_BIG_PARTS)
def bgp_plain(spark, sf):
    return _big_parts(store(spark, sf))


@query(SQL_BIG_PARTS)
def bgp_reduced(spark, sf):
    st = reduced(spark, sf)
    return _big_parts(st, st.reductions())


@query(SQL_BIG_PARTS)
def bloom_reduced_answer(spark, sf):
    st = reduced(spark, sf, "bloom")
    return _big_parts(st, st.reductions())


@query(
    """select 'order/' || o_orderkey as o, 'customer/' || o_custkey as c,
       case when o_totalprice > 450000 then '"true"' end as b from orders"""
)
def reduced_optional(spark, sf):
    """A pattern in an optional part must not reduce the scan outside of it."""
    st = reduced(spark, sf)
    orders = match(st, [("?o", "ord__customer", "?c")], st.reductions())
    return orders.optional(match(st, [("?o", "ord__big", "?b")], st.reductions())).df


@query(
    """select 'order/' || o_orderkey as o, 'part/' || l_partkey as p
       from orders left join lineitem on l_orderkey = o_orderkey where o_totalprice > 450000"""
)
def reduced_optional_inside(spark, sf):
    """The optional part reads only the parts of big orders."""
    st = reduced(spark, sf)
    big = match(st, [("?o", "ord__big", "?b")], st.reductions())
    parts = match(st, [("?o", "ord__part", "?p")], st.reductions(), outer=big)
    return big.optional(parts).project("?o", "?p").df


@query(
    """select 'order/' || o_orderkey as o, 'part/' || l_partkey as p, cast(null as varchar) as c
       from orders join lineitem on l_orderkey = o_orderkey where o_totalprice > 450000
       union all select 'order/' || o_orderkey, null, 'customer/' || o_custkey from orders where o_totalprice > 450000"""
)
def reduced_union_inside(spark, sf):
    """Both arms read only what belongs to big orders."""
    st = reduced(spark, sf)
    big = match(st, [("?o", "ord__big", "?b")], st.reductions())
    parts = match(st, [("?o", "ord__part", "?p")], st.reductions(), outer=big)
    customers = match(st, [("?o", "ord__customer", "?c")], st.reductions(), outer=big)
    return big.join(parts.union(customers)).project("?o", "?p", "?c").df


@query(
    """select 'order/' || a.o_orderkey as a, 'order/' || b.o_orderkey as b
       from orders a join orders b on a.o_custkey = b.o_custkey
       where a.o_totalprice > 450000 and b.o_totalprice > 450000"""
)
def reduced_path(spark, sf):
    """The steps of a path read the customers of big orders only."""
    st = reduced(spark, sf)
    group = [("?a", P("ord__customer") / ~P("ord__customer"), "?b"), ("?a", "ord__big", "?x"), ("?b", "ord__big", "?y")]
    return match(st, group, st.reductions()).project("?a", "?b").df


@query(
    """select 'ord__customer' as prop, count(*) as rows, cast(min(o_orderkey) as varchar) as first, cast(max(o_orderkey) as varchar) as last from orders
       union all select 'cust__nation', count(*), cast(min(c_custkey) as varchar), cast(max(c_custkey) as varchar) from customer"""
)
def store_append(spark, sf):
    """A store that grows by batches, the last of which repeats what is there and is left out."""
    src = triples(spark, sf)
    rows = src.frame_of(["ord__customer", "cust__nation"])
    half = F.pmod(F.xxhash64("sub"), F.lit(2)) == 0
    grown = Store.build(rows.where(half), scratch.new_path(spark, "grows")).append(rows.where(~half)).append(rows, dedupe=True)
    key = F.regexp_extract("sub", r"\d+", 0).cast("bigint")
    spans = grown.frame().groupBy("prop").agg(F.min(key).cast("string").alias("first"), F.max(key).cast("string").alias("last"))
    return grown.stats().select("prop", "rows").join(spans, "prop")


# -- Bloom filters ---------------------------------------------------------------------------


@query(
    """with m as (select distinct o_custkey from orders where o_totalprice > 450000)
       select count(*) as probes, cast(0 as bigint) as lost, count(*) filter (o_custkey in (select o_custkey from m)) as found,
              true as within_bound from orders"""
)
def bloom_filter(spark, sf):
    """Customers with big orders in a filter, all orders probed: none lost, few extra."""
    src = triples(spark, sf)
    orders = src.scan("ord__customer")
    members = match(src, [("?o", "ord__big", "?b"), ("?o", "ord__customer", "?c")]).project("?c").distinct().df
    filter_ = red.bloom_build(members, members.count())
    probed = red.bloom_flag(orders, "obj", filter_, "maybe").join(
        members.select(F.col("c").alias("obj"), F.lit(True).alias("member")), "obj", "left"
    )
    outside = F.col("member").isNull()
    extra = F.count_if(outside & F.col("maybe").isNotNull())
    return probed.agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(~outside & F.col("maybe").isNull()).alias("lost"),
        F.count_if(~outside & F.col("maybe").isNotNull()).alias("found"),
        (extra <= F.lit(2 * red.FPP) * F.count_if(outside) + 10).alias("within_bound"),
    )


@query("select true as same, count(*) as found from lineitem")
def bloom_union(spark, sf):
    """The union of the filters of two halves is the filter of the whole, bit by bit, and finds every row."""
    parts = triples(spark, sf).scan("ord__part").select("obj", "sub")
    n = parts.select("obj").distinct().count()
    whole = red.bloom_build(parts.select("obj"), n)
    half = F.pmod(F.xxhash64("obj"), F.lit(2))
    merged = red.bloom_union([red.bloom_build(parts.where(half == i).select("obj"), n) for i in (0, 1)])
    differs = merged.table.exceptAll(whole.table).unionAll(whole.table.exceptAll(merged.table))
    found = red.bloom_semi(parts, "obj", merged).agg(F.count(F.lit(1)).alias("found"))
    return differs.agg((F.count(F.lit(1)) == 0).alias("same")).crossJoin(found).select("same", "found")


@query(
    """select 'order/' || o_orderkey as sub from orders
       where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')"""
)
def bloom_semi(spark, sf):
    """Through the stored filter, then through the exact keys: the filter has lost nothing."""
    st = store(spark, sf)
    maybe = red.semi(st, ("ord__customer", SUB), ("ord__returnedPart", SUB), st.filter("ord__returnedPart", SUB))
    return maybe.join(red.keys(st, "ord__returnedPart", SUB), F.col("sub") == F.col("value"), "left_semi").select("sub")


# -- From a workload to reduced tables -------------------------------------------------------

# Every set of these with ord__customer is a pattern of it: 255 in all.
COMPANIONS = ["ord__big", "ord__date", "ord__part", "ord__price", "ord__priority", "ord__returnedPart", "ord__status", "ord__supplier"]
SQL_COMPANIONS = ", ".join(f"({i}, '{p}_{SUB}')" for i, p in enumerate(COMPANIONS))


@query(
    f"""with m(i, item) as (values {SQL_COMPANIONS}),
       o as (
         select 2 + 8 + 16 + 64 + case when o_totalprice > 450000 then 1 else 0 end
           + case when o_orderkey in (select l_orderkey from lineitem) then 4 + 128 else 0 end
           + case when o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') then 32 else 0 end as b from orders),
       k as (select b, count(*) as n from o group by b),
       s as (
         select n, bit_count(n) as size, 'ord__customer_{SUB}_JOIN_' || string_agg(item, '_JOIN_' order by i) as pattern
         from (select unnest(range(1, 256)) as n), m where (n >> i) & 1 = 1 group by n)
       select cast(row_number() over (order by size, pattern) - 1 as integer) as slot, pattern,
              (select cast(coalesce(sum(k.n), 0) as bigint) from k where k.b & s.n = s.n) as rows from s"""
)
def reduced_all_patterns(spark, sf):
    """More patterns of a property than fit any word of bits, smallest first, all stored."""
    rows = triples(spark, sf).frame_of(["ord__customer", *COMPANIONS])
    st = Store.build(rows, scratch.new_path(spark, "wide"), by_subject=False)
    sets = [[p for i, p in enumerate(COMPANIONS) if n >> i & 1] for n in range(1, 1 << len(COMPANIONS))]
    items = [[red.item(p, SUB) for p in ["ord__customer", *chosen]] for chosen in sets]
    st.add_reductions(red.catalog_of(spark, "ord__customer", items))
    return st.patterns().select("slot", "pattern", "rows")


LOG_SUPPORT = 0.001


def _log(spark, sf) -> DataFrame:
    """A query per order: its customer, and what else depends on the order."""
    def triple(sub, prop, obj, where="true"):
        return f"if({where}, struct('{sub}' as sub, '{prop}' as prop, '{obj}' as obj), null)"

    patterns = [
        triple("?o", "ord__customer", "?c"),
        triple("?o", "ord__big", "?b", "o_totalprice > 450000"),
        triple("?o", "ord__returnedPart", "?p", "o_orderstatus = 'F'"),
        triple("?c", "cust__segment", "?s", "o_orderpriority = '1-URGENT'"),
        triple("?c", "cust__nation", "?n", "o_orderstatus = 'O'"),
    ]
    return table(spark, sf, "orders").selectExpr("o_orderkey as query_id", f"inline(array_compact(array({', '.join(patterns)})))")


@query(
    f"""with f as (
         select 2 + case when o_totalprice > 450000 then 1 else 0 end + case when o_orderstatus = 'F' then 4 else 0 end as o,
                4 + case when o_orderstatus = 'O' then 1 else 0 end + case when o_orderpriority = '1-URGENT' then 2 else 0 end as c
         from orders),
       t as (select 'o' as v, o as b from f where bit_count(o) > 1 union all select 'c', c from f where bit_count(c) > 1),
       s as (
         select t.v, r.n from t, (select unnest(range(1, 8)) as n) r where bit_count(r.n) > 1 and t.b & r.n = r.n
         group by t.v, r.n having count(*) >= (select ceil({LOG_SUPPORT} * count(*)) from t)),
       m(v, i, item) as (values ('o', 0, 'ord__big_TRPS'), ('o', 1, 'ord__customer_TRPS'), ('o', 2, 'ord__returnedPart_TRPS'),
         ('c', 0, 'cust__nation_TRPS'), ('c', 1, 'cust__segment_TRPS'), ('c', 2, 'ord__customer_TRPO')),
       ret as (select l_orderkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by l_orderkey),
       ord as (
         select o_custkey, 2 + case when o_totalprice > 450000 then 1 else 0 end + case when ret.n is null then 0 else 4 end as b,
                coalesce(ret.n, 0) as returned
         from orders left join ret on k = o_orderkey),
       cus as (
         select 3 + case when n is null then 0 else 4 end as b, coalesce(n, 0) as orders
         from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey),
       w as (
         select 'o' as v, b, 0 as i, count(*) as rows from ord group by b
         union all select 'o', b, 1, count(*) from ord group by b union all select 'o', b, 2, sum(returned) from ord group by b
         union all select 'c', b, 0, count(*) from cus group by b
         union all select 'c', b, 1, count(*) from cus group by b union all select 'c', b, 2, sum(orders) from cus group by b),
       h as (select s.v, s.n, m.i, m.item as head from s join m on s.v = m.v and (s.n >> m.i) & 1 = 1),
       p as (
         select h.v, h.n, h.i, h.head, h.head || '_JOIN_' || string_agg(m.item, '_JOIN_' order by m.item) as pattern
         from h join m on h.v = m.v and (h.n >> m.i) & 1 = 1 and m.i <> h.i group by h.v, h.n, h.i, h.head)
       select regexp_replace(head, '_TRP[SO]$', '') as prop, pattern,
              cast(coalesce((select sum(rows) from w where w.v = p.v and w.i = p.i and w.b & p.n = p.n), 0) as bigint) as rows
       from p"""
)
def reductions_from_workload(spark, sf):
    """Mine the log, propose by co-occurrence, build the reduced tables of all properties, read their statistics."""
    sets = w.mined_item_sets(_log(spark, sf))
    matching = w.matching_patterns(w.frequent_of(sets, LOG_SUPPORT), w.propose_cooccurrence(sets))
    st = Store.build(triples(spark, sf).frame(), scratch.new_path(spark, "mined"), by_subject=False)
    st.add_reductions(red.number_slots(matching))
    return st.patterns().select("prop", "pattern", "rows")
