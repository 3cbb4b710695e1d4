"""The test tables as triples, query workloads and log lines.

Nodes are ``kind/key``, literals keep their quotes. Money goes through ``decimal(15,2)`` and
dates through ``yyyy-MM-dd``, which every engine spells alike.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.sources.triples import PropertyTables

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> str:
    return f"concat('{kind}/', {key})"


def literal(value: str) -> str:
    return f"""concat('"', {value}, '"')"""


def money(column: str) -> str:
    return literal(f"cast(cast({column} as decimal(15,2)) as string)")


ORDER, LINE, CUSTOMER = node("order", "o_orderkey"), node("order", "l_orderkey"), node("customer", "c_custkey")
SUPPLIER, PART, NATION = node("supplier", "s_suppkey"), node("part", "p_partkey"), node("nation", "n_nationkey")
DOC, EVENT = node("doc", "doc_id"), node("event", "event_id")

# Property: table, subject, object, and the rows it covers if not all.
PROPERTIES: dict[str, tuple[str, ...]] = {
    "ord__customer": ("orders", ORDER, node("customer", "o_custkey")),
    "ord__status": ("orders", ORDER, literal("o_orderstatus")),
    "ord__priority": ("orders", ORDER, literal("o_orderpriority")),
    "ord__price": ("orders", ORDER, money("o_totalprice")),
    "ord__date": ("orders", ORDER, literal("date_format(o_orderdate, 'yyyy-MM-dd')")),
    "ord__big": ("orders", ORDER, literal("'true'"), "o_totalprice > 450000"),
    "ord__part": ("lineitem", LINE, node("part", "l_partkey")),
    "ord__supplier": ("lineitem", LINE, node("supplier", "l_suppkey")),
    "ord__returnedPart": ("lineitem", LINE, node("part", "l_partkey"), "l_returnflag = 'R'"),
    "cust__nation": ("customer", CUSTOMER, node("nation", "c_nationkey")),
    "cust__segment": ("customer", CUSTOMER, literal("c_mktsegment")),
    "cust__name": ("customer", CUSTOMER, literal("c_name")),
    "supp__nation": ("supplier", SUPPLIER, node("nation", "s_nationkey")),
    "supp__lead": ("supplier", SUPPLIER, node("supplier", "s_suppkey - s_suppkey % 10")),
    "nat__region": ("nation", NATION, node("region", "n_regionkey")),
    "nat__name": ("nation", NATION, literal("n_name")),
    "reg__name": ("region", node("region", "r_regionkey"), literal("r_name")),
    "part__brand": ("part", PART, literal("p_brand")),
    "part__type": ("part", PART, literal("p_type")),
    "part__name": ("part", PART, literal("p_name")),
    "doc__lang": ("documents", DOC, literal("lang")),
    "doc__label": ("documents", DOC, f"concat({literal('source')}, '@', lang)"),
    "doc__quality": ("labels", DOC, literal("quality")),
    "doc__toxic": ("labels", DOC, literal("toxic")),
    "evt__value": ("events", EVENT, money("value")),
} | {f"user__{kind}": ("events", node("user", "user_id"), EVENT, f"event_type = '{kind}'") for kind in EVENT_TYPES}


class TableTriples(PropertyTables):
    """Property tables over the given ones; a table's schema is looked up once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._table = cache(partial(table, spark, sf_dir))
        super().__init__({prop: partial(self._one, *spec) for prop, spec in PROPERTIES.items()})

    def _one(self, name: str, sub: str, obj: str, where: str = "true") -> DataFrame:
        return self._table(name).where(where).selectExpr(f"{sub} as sub", f"{obj} as obj")


_SOURCES: dict[tuple[str, str], TableTriples] = {}


def triples(spark: SparkSession, sf_dir: str) -> TableTriples:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SOURCES:
        _SOURCES[key] = TableTriples(spark, sf_dir)
    return _SOURCES[key]


def query_patterns(spark: SparkSession, sf_dir: str, prop: Column | None = None) -> DataFrame:
    """A workload: each order is a query, each of its lines a pattern on ``?o``.

    The property is the part's brand unless given; returned parts put ``?o`` at the object end.
    """
    prop = F.concat(F.lit("part__"), F.col("p_brand")) if prop is None else prop
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    other = F.concat(F.lit("?x"), F.col("l_linenumber").cast("string"))
    returned = F.col("l_returnflag") == "R"
    return lines.select(
        F.col("l_orderkey").alias("query_id"),
        F.when(returned, other).otherwise("?o").alias("sub"),
        prop.alias("prop"),
        F.when(returned, "?o").otherwise(other).alias("obj"),
    )


# The same workload in SQL: what each query does with each variable, as items.
SQL_USES = """uses as (
         select l_orderkey as q, 'part__' || p_brand as prop, l_returnflag = 'R' as ret, 'x' || l_linenumber as x
         from lineitem join part on l_partkey = p_partkey),
       items as (
         select q, 'o' as var, prop || case when ret then '_TRPO' else '_TRPS' end as item from uses
         union all select q, x, prop || case when ret then '_TRPS' else '_TRPO' end from uses),
       joins as (
         select q, var, item, count(*) as n, sum(count(*)) over (partition by q, var) as total
         from items group by q, var, item),
       txn as (select q, var, item from joins where total > 1)"""


# For the oracles that count triples; the conditions are plain SQL.
SQL_COUNTS = " union all ".join(
    f"select '{prop}' as prop, count(*) as n from {spec[0]} where {spec[3] if len(spec) > 3 else 'true'}"
    for prop, spec in PROPERTIES.items()
)
