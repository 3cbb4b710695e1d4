"""Graph patterns, filters, paths, modifiers and statistics over the fixture triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripleweave.functions import filters as f
from tripleweave.operators import layouts, stats
from tripleweave.plans.paths import P
from tripleweave.plans.pattern import match, path
from tripleweave.queries import query
from tripleweave.queries.fixtures import SQL_COUNTS, triples

# -- Tables and statistics -------------------------------------------------------------------


@query(f"select prop from ({SQL_COUNTS}) where n > 0")
def distinct_properties(spark, sf):
    return stats.distinct_properties(triples(spark, sf).frame())


@query("select 'order/' || l_orderkey as sub, 'part/' || l_partkey as obj from lineitem where l_returnflag = 'R'")
def vp_table(spark, sf):
    return layouts.vp(triples(spark, sf).frame(), "ord__returnedPart")


@query(
    f"select prop, n as rows, round(n / sum(n) over (), 6) as ratio from ({SQL_COUNTS}) where n > 0"
)
def vp_stats(spark, sf):
    counted = stats.vp_stats(triples(spark, sf).frame())
    return counted.select("prop", "rows", F.round("ratio", 6).alias("ratio"))


@query(
    f"""select cast(sum(n) as bigint) as num_triples, count(*) as num_properties, count(*) as num_vp_tables,
        cast(0 as bigint) as num_reduced_tables, cast(sum(n) as bigint) as num_tuples
        from ({SQL_COUNTS}) where n > 0"""
)
def db_stats(spark, sf):
    return stats.db_stats(stats.vp_stats(triples(spark, sf).frame()))


@query(
    """select 'order/' || l_orderkey as sub, 0 as part,
       string_agg('part/' || l_partkey, ' ' order by 'part/' || l_partkey) as objs
       from lineitem where l_returnflag = 'R' group by l_orderkey"""
)
def compact_table(spark, sf):
    lists = layouts.compact_table(triples(spark, sf).scan("ord__returnedPart"))
    return lists.select("sub", "part", F.array_join("objs", " ").alias("objs"))


@query(
    """select 'order/' || l_orderkey as sub, 'part/' || l_partkey as obj, count(*) as n
       from lineitem where l_returnflag = 'R' group by all"""
)
def counted_table(spark, sf):
    return layouts.counted_table(triples(spark, sf).scan("ord__returnedPart"))


@query(
    """with big as (select 'order/' || o_orderkey as sub from orders where o_totalprice > 450000),
       ret as (select 'order/' || l_orderkey as sub, 'part/' || l_partkey as part from lineitem where l_returnflag = 'R')
       select coalesce(b.sub, r.sub) as sub, case when b.sub is not null then '"true"' end as ord__big,
       r.part as ord__returnedPart
       from big b full join ret r on b.sub = r.sub"""
)
def wide_table(spark, sf):
    src = triples(spark, sf)
    return layouts.wide_table({p: src.scan(p) for p in ("ord__big", "ord__returnedPart")})


# -- Basic graph patterns --------------------------------------------------------------------


@query(
    """select 'order/' || o_orderkey as o, '"' || c_name || '"' as name, 'nation/' || n_nationkey as n
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey where r_name = 'ASIA'"""
)
def bgp_linear(spark, sf):
    return match(
        triples(spark, sf),
        [
            ("?o", "ord__customer", "?c"),
            ("?c", "cust__nation", "?n"),
            ("?n", "nat__region", "?r"),
            ("?r", "reg__name", '"ASIA"'),
            ("?c", "cust__name", "?name"),
        ],
    ).project("?o", "?name", "?n").df


@query(
    """select 'order/' || o_orderkey as o, 'customer/' || o_custkey as c, '"' || o_orderpriority || '"' as pr,
       '"' || cast(cast(o_totalprice as decimal(15,2)) as varchar) || '"' as price,
       '"' || strftime(o_orderdate, '%Y-%m-%d') || '"' as d
       from orders where o_orderstatus = 'F'"""
)
def bgp_star(spark, sf):
    return match(
        triples(spark, sf),
        [
            ("?o", "ord__status", '"F"'),
            ("?o", "ord__customer", "?c"),
            ("?o", "ord__priority", "?pr"),
            ("?o", "ord__price", "?price"),
            ("?o", "ord__date", "?d"),
        ],
    ).project("?o", "?c", "?pr", "?price", "?d").df


@query(
    """select 'order/' || o_orderkey as o, 'part/' || l_partkey as p, '"' || c_mktsegment || '"' as seg,
       '"' || n_name || '"' as nn
       from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
       join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       where p_brand = 'Brand#7'"""
)
def bgp_snowflake(spark, sf):
    return match(
        triples(spark, sf),
        [
            ("?o", "ord__part", "?p"),
            ("?p", "part__brand", '"Brand#7"'),
            ("?o", "ord__customer", "?c"),
            ("?c", "cust__segment", "?seg"),
            ("?c", "cust__nation", "?n"),
            ("?n", "nat__name", "?nn"),
        ],
    ).project("?o", "?p", "?seg", "?nn").df


@query("select 'customer/' || c_custkey as c from customer where c_nationkey = 3")
def triple_const_object(spark, sf):
    return match(triples(spark, sf), [("?c", "cust__nation", "nation/3")]).df


@query("select 'supplier/' || s_suppkey as x from supplier where s_suppkey % 10 = 0")
def repeated_variable(spark, sf):
    return match(triples(spark, sf), [("?x", "supp__lead", "?x")]).df


@query(
    """select 'customer/' || c_custkey as s, 'cust__nation' as p from customer where c_nationkey = 3
       union all select 'supplier/' || s_suppkey, 'supp__nation' from supplier where s_nationkey = 3"""
)
def var_predicate(spark, sf):
    return match(triples(spark, sf), [("?s", "?p", "nation/3")]).df


@query(
    """select 'supplier/' || a.s_suppkey as a, 'supplier/' || b.s_suppkey as b, 'nation/' || a.s_nationkey as n
       from supplier a join supplier b on b.s_suppkey = a.s_suppkey - a.s_suppkey % 10
       and a.s_nationkey = b.s_nationkey"""
)
def same_predicate_twice(spark, sf):
    return match(
        triples(spark, sf),
        [("?a", "supp__lead", "?b"), ("?a", "supp__nation", "?n"), ("?b", "supp__nation", "?n")],
    ).project("?a", "?b", "?n").df


@query(
    """select 'customer/' || c_custkey as c, '"' || r_name || '"' as rn from customer, region
       where c_mktsegment = 'BUILDING'"""
)
def bgp_disconnected(spark, sf):
    return match(triples(spark, sf), [("?c", "cust__segment", '"BUILDING"'), ("?r", "reg__name", "?rn")]).project(
        "?c", "?rn"
    ).df


@query(
    """select 'order/' || o_orderkey as o, 'customer/' || o_custkey as c, 'part/' || l_partkey as p
       from orders join lineitem on l_orderkey = o_orderkey join customer on c_custkey = o_custkey
       where o_totalprice > 450000 and c_mktsegment = 'MACHINERY'"""
)
def group_join(spark, sf):
    src = triples(spark, sf)
    left = match(src, [("?o", "ord__customer", "?c"), ("?o", "ord__part", "?p")])
    right = match(
        src, [("?o", "ord__big", '"true"'), ("?o", "ord__customer", "?c"), ("?c", "cust__segment", '"MACHINERY"')]
    )
    return left.join(right).project("?o", "?c", "?p").df


@query(
    """select 'order/' || o_orderkey as o, 'supplier/' || l_suppkey as s, 'nation/' || s_nationkey as n
       from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey
       where o_orderpriority = '1-URGENT' and o_totalprice > 450000"""
)
def sequence_join(spark, sf):
    src = triples(spark, sf)
    urgent = match(src, [("?o", "ord__priority", '"1-URGENT"')]).join(match(src, [("?o", "ord__big", "?b")]))
    return (
        urgent.join(match(src, [("?o", "ord__supplier", "?s")]))
        .join(match(src, [("?s", "supp__nation", "?n")]))
        .project("?o", "?s", "?n")
        .df
    )


@query("select count(*) as answers from lineitem join part on l_partkey = p_partkey where p_type = 'ECONOMY'")
def result_count(spark, sf):
    return match(triples(spark, sf), [("?o", "ord__part", "?p"), ("?p", "part__type", '"ECONOMY"')]).count()


# -- Optional, union, unbound variables ------------------------------------------------------


@query(
    """select 'doc/' || d.doc_id as d, '"' || lang || '"' as l, '"' || quality || '"' as q
       from documents d left join labels l on d.doc_id = l.doc_id"""
)
def optional_basic(spark, sf):
    src = triples(spark, sf)
    return match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")])).df


@query(
    """select 'doc/' || d.doc_id as d, '"' || quality || '"' as q
       from documents d left join labels l on d.doc_id = l.doc_id and quality > 0 and d.lang = 'en'"""
)
def optional_filter(spark, sf):
    src = triples(spark, sf)
    inner = f.compare("?q", ">", 0) & f.compare("?l", "=", '"en"')
    return (
        match(src, [("?d", "doc__lang", "?l")])
        .optional(match(src, [("?d", "doc__quality", "?q")]), on=inner)
        .project("?d", "?q")
        .df
    )


@query(
    """select 'supplier/' || s_suppkey as s, 'nation/' || s_nationkey as n, 'region/' || r_regionkey as r
       from supplier left join region on s_nationkey = 3"""
)
def optional_disconnected(spark, sf):
    src = triples(spark, sf)
    return (
        match(src, [("?s", "supp__nation", "?n")])
        .optional(match(src, [("?r", "reg__name", "?rn")]), on=f.compare("?n", "=", "nation/3"))
        .project("?s", "?n", "?r")
        .df
    )


@query(
    """select 'supplier/' || s_suppkey as s, cast(null as varchar) as r from supplier"""
)
def optional_empty(spark, sf):
    src = triples(spark, sf)
    nowhere = match(src, [("?r", "reg__name", '"ATLANTIS"')])
    return match(src, [("?s", "supp__nation", "?n")]).optional(nowhere).project("?s", "?r").df


@query("select 'doc/' || doc_id as d from documents where doc_id not in (select doc_id from labels)")
def anti_not_bound(spark, sf):
    src = triples(spark, sf)
    labelled = match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")]))
    return labelled.where(f.not_bound("?q")).project("?d").df


@query(
    """select 'doc/' || doc_id as d, '"' || toxic || '"' as t, cast(null as varchar) as lb
       from labels where quality = 1
       union all select 'doc/' || l.doc_id, cast(null as varchar), '"' || source || '"@' || lang
       from labels l join documents d on l.doc_id = d.doc_id where toxic = 1"""
)
def union_pad(spark, sf):
    src = triples(spark, sf)
    good = match(src, [("?d", "doc__quality", '"1"'), ("?d", "doc__toxic", "?t")])
    toxic = match(src, [("?d", "doc__toxic", '"1"'), ("?d", "doc__label", "?lb")])
    return good.union(toxic).project("?d", "?t", "?lb").df


@query(
    """with a as (select d.doc_id, quality as q from documents d left join labels l on d.doc_id = l.doc_id),
       b as (select distinct quality as q, toxic as t from labels)
       select 'doc/' || doc_id as d, '"' || b.q || '"' as q, '"' || t || '"' as t
       from a join b on a.q = b.q or a.q is null"""
)
def unbound_join(spark, sf):
    src = triples(spark, sf)
    docs = match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")]))
    combos = match(src, [("?e", "doc__quality", "?q"), ("?e", "doc__toxic", "?t")]).project("?q", "?t").distinct()
    return docs.join(combos).project("?d", "?q", "?t").df


@query(
    """with a as (select 'doc/' || d.doc_id as d, '"' || quality || '"' as q
                  from documents d left join labels l on d.doc_id = l.doc_id),
       b as (select 'doc/' || doc_id as d, '"' || toxic || '"' as q from labels)
       select a.d, coalesce(a.q, b.q) as q from a left join b on a.d = b.d and (a.q = b.q or a.q is null)"""
)
def unbound_optional(spark, sf):
    src = triples(spark, sf)
    docs = match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")]))
    return docs.optional(match(src, [("?d", "doc__toxic", "?q")])).project("?d", "?q").df


@query(
    """with a as (select d.doc_id, quality as q, toxic as t from documents d left join labels l on d.doc_id = l.doc_id and toxic = 0),
       b as (select distinct quality as q, toxic as t from labels union all select distinct quality, null from labels)
       select 'doc/' || doc_id as d, '"' || b.q || '"' as q, '"' || coalesce(a.t, b.t) || '"' as t
       from a join b on (a.q = b.q or a.q is null) and (a.t = b.t or a.t is null or b.t is null)"""
)
def unbound_masks(spark, sf):
    """Two variables that either side may leave unbound."""
    src = triples(spark, sf)
    labels = match(src, [("?d", "doc__quality", "?q"), ("?d", "doc__toxic", "?t")])
    docs = match(src, [("?d", "doc__lang", "?l")]).project("?d").optional(labels.where(f.compare("?t", "=", '"0"')))
    combos = labels.project("?q", "?t").distinct().union(labels.project("?q").distinct())
    return docs.join(combos).project("?d", "?q", "?t").df


# -- Filters ---------------------------------------------------------------------------------


@query("select 'order/' || o_orderkey as o from orders where o_totalprice > 300000 and o_totalprice <= 320000.5")
def filter_numeric(spark, sf):
    prices = match(triples(spark, sf), [("?o", "ord__price", "?p")])
    return prices.where(f.compare("?p", ">", 300000) & f.compare("?p", "<=", 320000.5)).project("?o").df


@query(
    """select 'order/' || o_orderkey as o from orders
       where (o_orderstatus = 'F' or o_orderpriority = '5-LOW') and not (o_totalprice < 100000)"""
)
def filter_logic(spark, sf):
    orders = match(
        triples(spark, sf), [("?o", "ord__status", "?s"), ("?o", "ord__priority", "?pr"), ("?o", "ord__price", "?p")]
    )
    either = f.compare("?s", "=", '"F"') | f.compare("?pr", "=", '"5-LOW"')
    return orders.where(either & ~f.compare("?p", "<", 100000)).project("?o").df


@query(
    """select 'event/' || event_id as e from events
       where cast(value as decimal(15,2))::double + 10 >= 100 and cast(value as decimal(15,2))::double - 5 != 90"""
)
def filter_arithmetic(spark, sf):
    values = match(triples(spark, sf), [("?e", "evt__value", "?v")])
    wanted = f.compare(f.add("?v", 10), ">=", 100) & f.compare(f.subtract("?v", 5), "!=", 90)
    return values.where(wanted).project("?e").df


@query("select 'doc/' || doc_id as d from labels where quality = toxic")
def filter_variables(spark, sf):
    docs = match(triples(spark, sf), [("?d", "doc__quality", "?q"), ("?d", "doc__toxic", "?t")])
    return docs.where(f.compare("?q", "=", "?t")).project("?d").df


@query(
    """select 'doc/' || d.doc_id as d, '"' || lang || '"' as l
       from documents d left join labels l on d.doc_id = l.doc_id where quality is not null or lang = 'fr'"""
)
def filter_bound(spark, sf):
    src = triples(spark, sf)
    docs = match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")]))
    return docs.where(f.bound("?q") | f.compare("?l", "=", '"fr"')).project("?d", "?l").df


@query("select 'order/' || o_orderkey as o from orders where o_orderkey > 20")
def filter_long_numbers(spark, sf):
    """Numbers that a double can't tell apart."""
    orders = match(triples(spark, sf), [("?o", "ord__status", "?s")])
    key = F.regexp_extract("o", r"\d+", 0)
    long = orders.df.withColumn("n", F.concat(F.lit('"1234567890123'), F.lpad(key, 12, "0"), F.lit('"')))
    return long.where(f.compare("?n", ">", int(f"1234567890123{20:012d}"))).select("o")


@query("select 'part/' || p_partkey as p, '\"' || p_name || '\"' as n from part where p_name like 'red %'")
def filter_regex(spark, sf):
    return match(triples(spark, sf), [("?p", "part__name", "?n")]).where(f.regex("?n", "^RED ", "i")).df


@query("select 'doc/' || doc_id as d from documents where lang = 'fr'")
def filter_langmatches(spark, sf):
    return match(triples(spark, sf), [("?d", "doc__label", "?l")]).where(f.lang_matches("?l", "fr")).project("?d").df


@query("select 'doc/' || doc_id as d, source as s from documents where lang = 'en' and source < 'src5'")
def filter_str_lang(spark, sf):
    docs = match(triples(spark, sf), [("?d", "doc__label", "?l")])
    wanted = (f.lang("?l") == "en") & (f.str_("?l") < "src5")
    return docs.where(wanted).df.select("d", f.str_("?l").alias("s"))


# -- Modifiers -------------------------------------------------------------------------------


@query(
    """select distinct 'nation/' || c_nationkey as n, '"' || c_mktsegment || '"' as seg
       from orders join customer on o_custkey = c_custkey where o_totalprice > 450000"""
)
def distinct_project(spark, sf):
    return match(
        triples(spark, sf),
        [
            ("?o", "ord__big", "?b"),
            ("?o", "ord__customer", "?c"),
            ("?c", "cust__nation", "?n"),
            ("?c", "cust__segment", "?seg"),
        ],
    ).project("?n", "?seg").distinct().df


@query("select distinct '\"' || o_orderpriority || '\"' as pr from orders where o_orderstatus = 'P'")
def reduced_modifier(spark, sf):
    orders = match(triples(spark, sf), [("?o", "ord__status", '"P"'), ("?o", "ord__priority", "?pr")])
    return orders.project("?pr").reduced().df


PRICED = """select 'order/' || o_orderkey as o,
       '"' || cast(cast(o_totalprice as decimal(15,2)) as varchar) || '"' as p from orders
       order by cast(o_totalprice as decimal(15,2)) desc, 'order/' || o_orderkey"""


def _by_price(spark, sf):
    return match(triples(spark, sf), [("?o", "ord__price", "?p")]).order(f.number("?p").desc_nulls_last(), "?o")


@query(f"{PRICED} limit 10")
def top_k(spark, sf):
    return _by_price(spark, sf).slice(limit=10).df


@query(f"{PRICED} limit 20 offset 10")
def order_offset_limit(spark, sf):
    return _by_price(spark, sf).slice(offset=10, limit=20).df


@query(f"{PRICED} offset 100")
def order_offset_open(spark, sf):
    return _by_price(spark, sf).slice(offset=100).df


@query(
    """select 'doc/' || d.doc_id as d, '"' || quality || '"' as q
       from documents d left join labels l on d.doc_id = l.doc_id
       order by '"' || quality || '"' asc nulls first, 'doc/' || d.doc_id desc limit 700"""
)
def order_unbound(spark, sf):
    src = triples(spark, sf)
    docs = match(src, [("?d", "doc__lang", "?l")]).optional(match(src, [("?d", "doc__quality", "?q")]))
    return docs.project("?d", "?q").order("?q", ("?d", "desc")).slice(limit=700).df


# -- Paths -----------------------------------------------------------------------------------


@query(
    """select 'order/' || o_orderkey as o, 'region/' || n_regionkey as r
       from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""
)
def path_seq(spark, sf):
    return path(triples(spark, sf), "?o", P("ord__customer") / P("cust__nation") / P("nat__region"), "?r").df


@query(
    """select 'user/' || user_id as u, '"' || cast(cast(value as decimal(15,2)) as varchar) || '"' as v
       from events where event_type in ('view', 'click')"""
)
def path_alt(spark, sf):
    return path(triples(spark, sf), "?u", (P("user__view") | P("user__click")) / P("evt__value"), "?v").df


@query(
    """select 'nation/' || c_nationkey as n, 'order/' || o_orderkey as o
       from orders join customer on o_custkey = c_custkey where c_nationkey = 5"""
)
def path_inverse(spark, sf):
    both = path(triples(spark, sf), "?n", ~(P("ord__customer") / P("cust__nation")), "?o")
    return both.where(f.compare("?n", "=", "nation/5")).df


@query(
    """select 'order/' || a.o_orderkey as a, 'order/' || b.o_orderkey as b
       from orders a join orders b on a.o_custkey = b.o_custkey
       where a.o_totalprice > 450000 and b.o_totalprice > 450000"""
)
def path_in_group(spark, sf):
    return match(
        triples(spark, sf),
        [
            ("?a", P("ord__customer") / ~P("ord__customer"), "?b"),
            ("?a", "ord__big", '"true"'),
            ("?b", "ord__big", '"true"'),
        ],
    ).project("?a", "?b").df
