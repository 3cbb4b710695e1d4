"""Sources and cleaning jobs, on text that Spark renders from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleweave.functions import prefixes, terms
from tripleweave.operators import workload as w
from tripleweave.queries import query
from tripleweave.queries.fixtures import PROPERTIES, SQL_COUNTS, table, triples
from tripleweave.sources import scratch, text

ORDER = "http://db.uwaterloo.ca/~galuc/wsdbm/Order"
OFFERS = "http://purl.org/goodrelations/"
NAMES = {"kind": "http://example.org/kind/", "user": "http://example.org/kind/user/", "prop": "http://example.org/prop/"}


def _iri(namespace: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{namespace}"), key, F.lit(">"))


SQL_TEXTS = " union all ".join(
    f"""select '{prop}' as prop, count(*) as rows, count(distinct {sub}) as subjects, sum(length({obj})) as chars
        from {spec[0]} where {spec[3] if len(spec) > 3 else 'true'}"""
    for prop, spec, sub, obj in [
        ("ord__customer", PROPERTIES["ord__customer"], "o_orderkey", "'kind__customer/' || o_custkey"),
        ("ord__big", PROPERTIES["ord__big"], "o_orderkey", "'\"true\"'"),
        ("ord__returnedPart", PROPERTIES["ord__returnedPart"], "l_orderkey", "'kind__part/' || l_partkey"),
        ("doc__label", PROPERTIES["doc__label"], "doc_id", "'\"' || source || '\"@' || lang"),
        ("part__name", PROPERTIES["part__name"], "p_partkey", "'\"' || p_name || '\"'"),
        ("user__view", PROPERTIES["user__view"], "user_id", "'kind__event/' || event_id"),
    ]
)


@query(
    f"""with t as ({SQL_TEXTS}), n as ({SQL_COUNTS})
        select prop, n as rows, subjects, cast(chars as bigint) as chars from n left join t using (prop) where n > 0"""
)
def nt_parse(spark, sf):
    """All triples as N-Triples text, parsed back: rows, and of some properties subjects and characters of objects."""
    frame = triples(spark, sf).frame()
    lines = text.render(
        frame.select(
            _iri(NAMES["kind"], F.col("sub")).alias("sub"),
            _iri(NAMES["prop"], F.col("prop")).alias("prop"),
            F.when(terms.is_literal(F.col("obj")), F.col("obj"))
            .otherwise(_iri(NAMES["kind"], F.col("obj")))
            .alias("obj"),
        )
    )
    parsed = text.parse_triples(lines, None, NAMES)
    prop = F.substring_index("prop", "__", -2).alias("prop")
    counted = parsed.groupBy(prop).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sub").alias("subjects"), F.sum(F.length("obj")).alias("chars")
    )
    known = F.col("prop").isin("ord__customer", "ord__big", "ord__returnedPart", "doc__label", "part__name", "user__view")
    return counted.select("prop", "rows", *[F.when(known, F.col(c)).alias(c) for c in ("subjects", "chars")])


@query(
    """select 'user__' || user_id as sub, 'prop__' || event_type as prop, 'kind__event/' || event_id as obj
       from events"""
)
def prefix_compact(spark, sf):
    """The longest of two overlapping namespaces wins."""
    events = table(spark, sf, "events").select(
        _iri(NAMES["user"], F.col("user_id").cast("string")).alias("sub"),
        _iri(NAMES["prop"], F.col("event_type")).alias("prop"),
        _iri(NAMES["kind"], F.concat(F.lit("event/"), F.col("event_id").cast("string"))).alias("obj"),
    )
    return events.select(*[terms.compact(F.col(c), NAMES).alias(c) for c in events.columns])


@query("select page_id, '<' || url || '>' as iri, true as same from pages")
def prefix_roundtrip(spark, sf):
    iri = F.concat(F.lit("<"), "url", F.lit(">"))
    table_ = prefixes.DBPEDIA | {"ex": "http://", "exs": "https://", "blog": "https://blog."}
    back = terms.expand(terms.compact(iri, table_), table_)
    shorter = F.length(terms.compact(iri, table_)) < F.length(iri)
    return table(spark, sf, "pages").select("page_id", back.alias("iri"), ((back == iri) & shorter).alias("same"))


@query(
    """select 'wsdbm__Order' || o_orderkey || ' gr__price "' || cast(cast(o_totalprice as decimal(15,2)) as varchar)
       || ' EUR" .' as value from orders"""
)
def convert_prefixes(spark, sf):
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string")
    lines = table(spark, sf, "orders").select(
        F.concat(_iri(ORDER, F.col("o_orderkey").cast("string")), F.lit(f" <{OFFERS}price> \""), price, F.lit(' EUR" .')).alias(
            "value"
        )
    )
    # A comment behind the dot changes nothing.
    noted = F.when(F.length("value") % 2 == 0, F.concat("value", F.lit(" # noted."))).otherwise(F.col("value"))
    lines = lines.select(noted.alias("value"))
    unfinished = table(spark, sf, "region").select(F.concat(F.lit("<a> <b> "), "r_name").alias("value"))
    return text.convert_prefixes(lines.unionByName(unfinished), prefixes.WATDIV)


@query(
    """select 'dbr__Doc' || doc_id || ' dbo__language "' || lang || '"@en' as value from documents"""
)
def clean_comments(spark, sf):
    docs = table(spark, sf, "documents")
    lines = docs.select(
        F.format_string(
            '<http://dbpedia.org/resource/Doc%d> <http://dbpedia.org/ontology/language> "%s"@en .', "doc_id", "lang"
        ).alias("value")
    )
    comments = docs.select(F.concat(F.lit("# "), "source").alias("value"))
    return text.clean_dbpedia(lines.unionByName(comments))


@query(
    """select 'yago__Customer_' || c_custkey || ' rdf__type dbr__' || c_mktsegment || ' .' as value from customer"""
)
def yago_clean(spark, sf):
    customers = table(spark, sf, "customer")
    lines = customers.select(
        F.format_string(
            "<Customer_%d>\trdf:type\t<http://dbpedia.org/resource/%s> .", "c_custkey", "c_mktsegment"
        ).alias("value")
    )
    skipped = customers.select(F.concat(F.lit("@base "), "c_name").alias("value"))
    short = customers.select(F.concat("c_name", F.lit("\tonly two")).alias("value"))
    return text.clean_yago(lines.unionByName(skipped).unionByName(short))


def _log_lines(spark, sf):
    """An access log: each page was asked for by a query that names its URL, twice."""
    pages = table(spark, sf, "pages")
    asked = F.concat(
        F.lit("SELECT ?s ?o WHERE {\n?s <http://xmlns.com/foaf/0.1/page> <"),
        "url",
        F.lit("> .  ?s a ?o }"),
    )
    line = F.concat(
        F.lit("10.0.0."), (F.col("page_id") % 256).cast("string"), F.lit(' - - [t] z "GET /sparql?query='),
        F.url_encode(asked), F.lit('&format=json"'),
    )
    other = F.concat(F.lit('10.0.0.1 - - [t] z "GET /'), F.url_encode("url"), F.lit('"'))
    lines = pages.select(line.alias("value"))
    return lines.unionByName(lines).unionByName(pages.select(other.alias("value")))


HEAD = "".join(f"PREFIX {name}: <{ns}> " for name, ns in text.LOG_PREFIXES)


@query(
    f"""select distinct '10.0.0.' || page_id % 256 as client, '{HEAD}SELECT * WHERE {{ ?s <http://xmlns.com/foaf/0.1/page> <'
        || case when position('&' in url) > 0 then left(url, position('&' in url) - 1) else url || '> . ?s a ?o }}' end as query
        from pages"""
)
def url_query_extract(spark, sf):
    """A decoded ``&`` ends the query, as in the log format."""
    return text.log_queries(_log_lines(spark, sf))


@query(
    """select distinct '10.0.0.' || page_id % 256 as query_id, '?s' as sub, 'foaf__page' as prop, url as obj from pages
       where position('&' in url) = 0
       union all select distinct '10.0.0.' || page_id % 256, '?s', 'rdf__type', '?o' from
         (select distinct page_id % 256 as page_id, url from pages) where position('&' in url) = 0"""
)
def triple_patterns(spark, sf):
    queries = text.log_queries(_log_lines(spark, sf)).select(F.col("client").alias("query_id"), "query")
    return w.triple_patterns(queries, prefixes.DBPEDIA)


@query(
    """select c_custkey as query_id, '?c' as sub, 'kind__name' as prop, '"' || c_name || '"' as obj from customer
       union all select c_custkey, '?c', 'kind__in', '?n' from customer
       union all select c_custkey, '?c', 'kind__in', 'kind__' || c_nationkey from customer
       union all select c_custkey, '?n', 'kind__seg', '"' || c_mktsegment || '"' from customer"""
)
def triple_pattern_lists(spark, sf):
    """Property and object lists in a nested group, a literal in single quotes."""
    text_ = F.format_string(
        "PREFIX k: <http://example.org/kind/> SELECT * WHERE { { ?c k:name '%s' ; k:in ?n , k:%d . } ?n k:seg \"%s\" }",
        "c_name", "c_nationkey", "c_mktsegment",
    )
    customers = table(spark, sf, "customer")
    queries = customers.select(F.col("c_custkey").alias("query_id"), text_.alias("query"))
    return w.triple_patterns(queries, NAMES, customers.count())


def _logged(spark, sf):
    """A log of one query per order: what its parts' brands are."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    triple = F.format_string("?o k:%s ?x%d .", F.translate("p_brand", "#", "_"), "l_linenumber")
    body = F.array_join(F.array_sort(F.collect_list(triple)), " ")
    head = "PREFIX k: <http://example.org/part/> SELECT * WHERE { "
    return lines.groupBy("l_orderkey").agg(F.concat(F.lit(head), body, F.lit(" }")).alias("value"))


@query("select 'part__' || replace(p_brand, '#', '_') as prop, count(*) as freq from lineitem join part on l_partkey = p_partkey group by 1")
def query_log_file(spark, sf):
    """The log as text files, with lines that are no queries, read back."""
    path = scratch.new_path(spark, "log")
    noise = table(spark, sf, "region").select(F.concat(F.lit("# "), "r_name").alias("value"))
    text.write_lines(_logged(spark, sf).select("value").unionByName(noise), path)
    queries = text.read_query_log(spark, path)
    return w.property_freq(w.triple_patterns(queries, {"part": "http://example.org/part/"}))


@query(
    """select 'nat__region' as prop, 'region/' || n_regionkey as obj, count(*) as queries
       from nation where n_nationkey <> 0 group by all"""
)
def query_directory(spark, sf):
    """A file per query, with a line break in it, and one file that is no query."""
    path = scratch.new_path(spark, "queries")
    asked = F.format_string("PREFIX k: <http://example.org/nat/>\nSELECT ?n\nWHERE { ?n k:region <region/%d> }", "n_regionkey")
    files = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 0, "not a query").otherwise(asked).alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(path)
    found = w.triple_patterns(text.read_query_dir(spark, path), {"nat": "http://example.org/nat/"})
    return found.groupBy("prop", "obj").agg(F.count_distinct("query_id").alias("queries"))
