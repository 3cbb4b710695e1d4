"""Workload mining: the orders as a query log over the brands of their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripleweave.operators import embedding, stats
from tripleweave.operators import workload as w
from tripleweave.queries import query
from tripleweave.queries.fixtures import SQL_USES, query_patterns, table

SUPPORT = 0.0005
ALPHA = 0.1


def _transactions(spark, sf):
    return w.mined_transactions(query_patterns(spark, sf), table(spark, sf, "lineitem").count())


def _itemsets(spark, sf):
    """Frequent itemsets of every size."""
    return w.frequent(_transactions(spark, sf), SUPPORT)


def _log_size(spark, sf):
    """Queries in the log, and properties it uses."""
    patterns = query_patterns(spark, sf)
    return patterns.agg(F.count_distinct("query_id").alias("q"), F.count_distinct("prop").alias("p")).first()


# Frequent itemsets of the same transactions: every set of two or more items of each, counted.
SQL_FREQUENT = f"""{SQL_USES},
       least as (select ceil({SUPPORT} * count(*)) as n from (select distinct q, var from txn)),
       grown(q, var, items, last) as (
         select distinct q, var, [item], item from txn
         union all
         select g.q, g.var, list_append(g.items, t.item), t.item
         from grown g join (select distinct q, var, item from txn) t on g.q = t.q and g.var = t.var and t.item > g.last),
       sets as (
         select items, count(*) as freq from grown where len(items) > 1
         group by items having count(*) >= (select n from least))"""

SQL_COST = f"""{SQL_FREQUENT},
       priced as (
         select items, freq, round({ALPHA} * ln(freq) / ln((select count(distinct q) from uses))
           + (1 - {ALPHA}) * ln(len(items)) / ln((select count(distinct prop) from uses)), 9) as cost from sets),
       per_item as (select unnest(items) as item, items, freq, cost from priced),
       best as (
         select item, items, freq, cost from per_item where cost > 0
         qualify row_number() over (partition by item order by cost desc, freq desc, items) = 1)"""


@query(
    """select l_orderkey as query_id, 'part__' || p_brand as prop, count(*) as n
       from lineitem join part on l_partkey = p_partkey group by 1, 2"""
)
def query_properties(spark, sf):
    return w.query_properties(query_patterns(spark, sf))


@query("select count(distinct l_orderkey) as queries from lineitem join part on l_partkey = p_partkey")
def query_count(spark, sf):
    return w.count_queries(query_patterns(spark, sf).select("query_id").distinct())


@query(
    """select 'part__' || p_brand as prop, count(*) as freq
       from lineitem join part on l_partkey = p_partkey group by 1"""
)
def property_freq(spark, sf):
    return w.property_freq(query_patterns(spark, sf))


@query(
    """select 'ord__' || l_returnflag as prop, count(*) as freq from lineitem
       where l_returnflag in (select 'R') group by 1"""
)
def property_freq_stored(spark, sf):
    """Of the properties a log names, only those of the catalog count."""
    log = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.lit("?o").alias("sub"), F.concat(F.lit("ord__"), "l_returnflag").alias("prop"), F.lit("?x").alias("obj")
    )
    held = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.lit("ord__R").alias("prop"))
    return w.property_freq(log, stats.vp_stats(held))


@query(f"with {SQL_USES} select q as query_id, var, item, n from joins where total > 1")
def join_patterns(spark, sf):
    return w.join_patterns(query_patterns(spark, sf))


@query(
    f"""with {SQL_USES} select q as query_id, var, string_agg(item, ' ' order by item) as items
        from txn group by q, var"""
)
def transactions(spark, sf):
    return _transactions(spark, sf).select("query_id", "var", F.array_join("items", " ").alias("items"))


@query(f"with recursive {SQL_FREQUENT} select array_to_string(items, ' ') as items, freq from sets where len(items) = 2")
def freq_pairs(spark, sf):
    pairs = _itemsets(spark, sf).where(F.col("size") == 2)
    return pairs.select(F.array_join("items", " ").alias("items"), "freq")


@query(f"with recursive {SQL_FREQUENT} select array_to_string(items, ' ') as items, freq from sets where len(items) = 3")
def freq_triples(spark, sf):
    trios = _itemsets(spark, sf).where(F.col("size") == 3)
    return trios.select(F.array_join("items", " ").alias("items"), "freq")


@query(f"with recursive {SQL_COST} select item, array_to_string(items, ' ') as items, freq, round(cost, 6) as cost from best")
def cost_best_pattern(spark, sf):
    log = _log_size(spark, sf)
    best = w.best_by_cost(_itemsets(spark, sf), log.q, log.p, ALPHA)
    return best.select("item", F.array_join("items", " ").alias("items"), "freq", F.round("cost", 6).alias("cost"))


SQL_PROPOSALS = f"""{SQL_COST},
       per_prop as (
         select regexp_replace(item, '_TRP[SO]$', '') as prop, items from best
         qualify row_number() over (
           partition by regexp_replace(item, '_TRP[SO]$', '') order by cost desc, freq desc, items) = 1),
       proposals as (
         select distinct prop, regexp_replace(i, '_TRP[SO]$', '') as member
         from (select prop, unnest(items) as i from per_prop))"""


@query(
    f"""with recursive {SQL_PROPOSALS}
        select prop, string_agg(member, ' ' order by member) as members from proposals group by prop"""
)
def propose_fp(spark, sf):
    log = _log_size(spark, sf)
    proposals = w.propose_fp(w.best_by_cost(_itemsets(spark, sf), log.q, log.p, ALPHA))
    return proposals.select("prop", F.array_join("members", " ").alias("members"))


@query(
    f"""with recursive {SQL_PROPOSALS},
        own as (
          select distinct regexp_replace(i, '_TRP[SO]$', '') as prop, items
          from (select items, unnest(items) as i from sets)),
        fits as (
          select o.prop, list_sort(list(i)) as kept
          from (select prop, items, unnest(items) as i from own) o
          where regexp_replace(i, '_TRP[SO]$', '') = o.prop
             or exists (select 1 from proposals p where p.prop = o.prop and p.member = regexp_replace(i, '_TRP[SO]$', ''))
          group by o.prop, o.items having count(*) > 1 and o.prop in (select prop from proposals)),
        named as (
          select prop, kept, case when list_contains(kept, prop || '_TRPS') then prop || '_TRPS' else prop || '_TRPO' end as first
          from fits)
        select distinct prop, array_to_string(list_concat([first], list_filter(kept, lambda x: x <> first)), '_JOIN_') as pattern,
          cast(len(kept) as integer) as size
        from named"""
)
def matching_patterns(spark, sf):
    log = _log_size(spark, sf)
    itemsets = _itemsets(spark, sf)
    proposals = w.propose_fp(w.best_by_cost(itemsets, log.q, log.p, ALPHA))
    return w.matching_patterns(itemsets, proposals).select("prop", "pattern", "size")


SQL_TOGETHER = """select distinct regexp_replace(a.item, '_TRP[SO]$', '') as prop,
       regexp_replace(b.item, '_TRP[SO]$', '') as member from txn a join txn b on a.q = b.q and a.var = b.var"""


@query(
    f"""with {SQL_USES}, pairs as ({SQL_TOGETHER})
        select prop, string_agg(member, ' ' order by member) as members from pairs group by prop"""
)
def cooccurrence(spark, sf):
    proposals = w.propose_cooccurrence(_transactions(spark, sf))
    return proposals.select("prop", F.array_join("members", " ").alias("members"))


def _dated(spark, sf):
    """The transactions of the workload over brand and part name, with the date of each query."""
    prop = F.concat(F.lit("part__"), F.col("p_brand"), F.lit("_"), F.col("p_name"))
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), "o_orderdate")
    txns = w.mined_transactions(query_patterns(spark, sf, prop), table(spark, sf, "lineitem").count())
    return txns.join(dates, "query_id")


@query(
    """with lines as (
         select l_orderkey as q, o_orderdate < timestamp '2000-01-01' as old, 'x' || l_linenumber as x,
           'part__' || p_brand || '_' || p_name as prop
         from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
       uses as (select q, old, 'o' as var, prop from lines union all select q, old, x, prop from lines),
       txn as (select * from uses qualify count(*) over (partition by q, var) > 1),
       pairs as (
         select distinct a.old, a.prop, b.prop as member from txn a join txn b on a.q = b.q and a.var = b.var),
       sizes as (select old, prop, count(*) as n from pairs group by old, prop),
       hits as (
         select p.prop, count(g.member) as tp from pairs p left join pairs g
         on p.prop = g.prop and p.member = g.member and not g.old where p.old group by p.prop),
       f as (
         select tp / p.n as pr, tp / g.n as re from hits join sizes p on hits.prop = p.prop and p.old
         join sizes g on hits.prop = g.prop and not g.old)
       select count(*) as properties, round(avg(case when pr + re = 0 then 0 else 2 * pr * re / (pr + re) end), 6) as f1
       from f"""
)
def partition_f1(spark, sf):
    """Partitions proposed from the queries before 2000, held against those since."""
    old = F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")
    log = _dated(spark, sf).withColumn("actual", ~old).where(F.col("actual").isNotNull())
    scores = w.evaluate_pairs(w.cooccurring(log, "actual"), F.col("actual"))
    return w.mean_f1(scores).select("properties", F.round("f1", 6).alias("f1"))


def _vectors(spark, sf):
    return embedding.learn(embedding.sentences(query_patterns(spark, sf)), vector_size=16)


@query()
def embedding_neighbours(spark, sf):
    return embedding.nearest(_vectors(spark, sf), 10)


@query(
    """with v as (select vec_id, embedding::double[] as e from embeddings),
       s as (select a.vec_id, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.vec_id <> b.vec_id)
       select cast(vec_id as varchar) as prop, cast(row_number() over (partition by vec_id order by c desc) as integer) as rank,
              round(c, 6) as similarity
       from s qualify row_number() over (partition by vec_id order by c desc) <= 10"""
)
def nearest_vectors(spark, sf):
    """The ten nearest of every vector of a table."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("prop"), F.col("embedding").alias("vector"))
    rank = F.row_number().over(Window.partitionBy("prop").orderBy(F.desc("similarity")))
    return embedding.nearest(vectors, 10).select("prop", rank.alias("rank"), F.round("similarity", 6).alias("similarity"))


@query()
def propose_embedding(spark, sf):
    proposals = embedding.propose_embedding(_vectors(spark, sf), 10)
    return proposals.select("prop", F.array_join("members", " ").alias("members"))


@query(
    """with v as (select vec_id, embedding::double[] as e from embeddings),
       s as (
         select v.vec_id, list_cosine_similarity(v.e, h.e) as c from v, (select e from v where vec_id = 0) h)
       select cast(vec_id as varchar) as prop, round(c, 6) as similarity from s where c > 0.3"""
)
def similarity_ranking(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("prop"), F.col("embedding").alias("vector")
    )
    ranked = embedding.similar_to(vectors, "0", 0.3)
    return ranked.select("prop", F.round("similarity", 6).alias("similarity"))
