"""Triple text and query logs.

Readers give one ``value`` column per line (``.gz`` and ``.bz2`` are read as they are, and
``.bz2`` splits over tasks); everything after that is column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleweave.functions import prefixes as tables
from tripleweave.functions import terms

# Fixed value: the query parameter of an access-log line.
LOG_QUERY = r'^(.+?)query=(.+?)(&.*?)?"$'

# The declarations put in front of every logged query, first to last.
LOG_PREFIXES = [
    ("dbr", "http://dbpedia.org/resource/"),
    ("dbr", "http://dbpedia.org/resource/"),
    ("dbpedia-owl", "http://dbpedia.org/ontology/"),
    ("dbo", "http://dbpedia.org/ontology/"),
    ("dbpprop", "http://dbpedia.org/property/"),
    ("dbp", "http://dbpedia.org/property/"),
    ("owl", "http://www.w3.org/2002/07/owl#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("rdfa", "http://www.w3.org/ns/rdfa#"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("foaf", "http://xmlns.com/foaf/0.1/"),
    ("geo", "http://www.w3.org/2003/01/geo/wgs84_pos#"),
    ("soic", "http://rdfs.org/sioc/ns#"),
]


BLANK = " \t\r"
# An IRI, a blank node or a literal with its language or type.
NODE = (
    r'<[^<>]*>|_:[\w-]+(?:\.[\w-]+)*'
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*"(?:@[\w-]+|\^\^(?:<[^<>]*>|[\w-]*:[\w%-]+(?:\.[\w%-]+)*))?'
)
BARE = r'(?:[^\s<"#._]|\.\S|_(?!:))'  # how any other term begins


def _object(field: Column, sep: str | None, strict: bool, closed: bool) -> Column:
    """The object at the start of the rest of a line, null unless only a dot and a comment follow.

    A bare term keeps a dot that is not set apart from it; with a separator it may hold spaces.
    """
    node = rf"^({NODE})\s*\.{'' if closed else '?'}\s*(?:#.*)?$"
    dot = r"\s+\." if closed else r"(?:\s+\.)?"
    bare = rf"^({BARE}{'.*?' if sep else r'\S*'}){dot}(?:\s+#.*)?\s*$"
    found = F.nullif(F.regexp_extract(field, node, 1), F.lit(""))
    return found if strict else F.coalesce(found, F.nullif(F.regexp_extract(field, bare, 1), F.lit("")))


def _fields(lines: DataFrame, sep: str | None, strict: bool, closed: bool) -> DataFrame:
    """``value, sub, prop, obj``: a line's first two fields and the object after them, null if there is none."""
    line = F.ltrim(F.col("value"), F.lit(BLANK))
    parts = lines.select("value", F.split(line, sep or r"\s+", 3).alias("parts"))
    get = [F.get("parts", F.lit(i)) for i in range(3)]
    return parts.select("value", get[0].alias("sub"), get[1].alias("prop"), _object(get[2], sep, strict, closed).alias("obj"))


def _is_triple(strict: bool) -> Column:
    found = F.col("obj").isNotNull() & ~F.col("sub").startswith("#")
    if strict:
        found &= F.col("sub").rlike(r"^(?:<[^<>]*>|_:\S+)$") & F.col("prop").rlike("^<[^<>]*>$")
    return found


def parse_triples(
    lines: DataFrame,
    sep: str | None = None,
    prefixes: Mapping[str, str] = tables.GENERIC,
    strict: bool = False,
    closed: bool = False,
) -> DataFrame:
    """``sub, prop, obj`` from lines of triple text; ``sep="\\t"`` lets terms hold spaces.

    A comment may follow the closing dot, which ``closed`` and ``strict`` ask for; without
    ``strict`` terms may be bare (compacted names, numbers). Comments, blank lines and lines that are no triple
    give no row (see :func:`rejected`).
    """
    names = ("sub", "prop", "obj")
    terms_ = [F.trim(n) if sep else F.col(n) for n in names]
    triple = F.struct(*[t.alias(n) for t, n in zip(terms_, names)])
    # As a generator of no or one row: a filter would be pushed down and split the line again.
    found = _fields(lines, sep, strict, strict or closed).select(F.inline(F.when(_is_triple(strict), F.array(triple))))
    return found.select(*[terms.compact_column(F.col(n), prefixes).alias(n) for n in names])


def rejected(lines: DataFrame, sep: str | None = None, strict: bool = False) -> DataFrame:
    """The lines :func:`parse_triples` leaves out, comments and blank lines aside."""
    line = F.trim(F.col("value"), F.lit(BLANK))
    fields = _fields(lines.where(~line.startswith("#") & (line != "")), sep, strict, strict)
    return fields.where(~F.coalesce(_is_triple(strict), F.lit(False))).select("value")


def read_triples(
    spark: SparkSession, path: str, sep: str | None = None, prefixes: Mapping[str, str] = tables.GENERIC
) -> DataFrame:
    return parse_triples(spark.read.text(path), sep, prefixes)


def render(triples: DataFrame, end: str = " .") -> DataFrame:
    """Triples as lines of text."""
    return triples.select(F.concat(F.concat_ws(" ", "sub", "prop", "obj"), F.lit(end)).alias("value"))


def convert_prefixes(lines: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """N-Triples lines with compacted terms; lines that do not end a triple with a dot are dropped."""
    return render(parse_triples(lines, None, prefixes, closed=True))


def clean_dbpedia(lines: DataFrame, prefixes: Mapping[str, str] = tables.DBPEDIA) -> DataFrame:
    """``sub prop obj`` lines without comments, brackets and dots."""
    return render(parse_triples(lines, None, prefixes), end="")


def clean_yago(lines: DataFrame, prefixes: Mapping[str, str] = tables.YAGO) -> DataFrame:
    """Tab-separated lines to ``sub prop obj .``; only lines of exactly three fields stay.

    ``<http...>`` is compacted, ``<x>`` becomes ``yago__x``, ``a:b`` becomes ``a__b`` (not
    inside a literal, which would lose what follows a second colon).
    """
    value = F.col("value")
    fields = F.split(F.replace(F.trim(value), F.lit(" ."), F.lit("")), "\t")

    def clean(field: Column) -> Column:
        bracketed = field.startswith("<") & field.endswith(">")
        bare = terms.strip_brackets(field)
        no_brackets = ~field.startswith("<") & ~field.endswith(">")
        parts = F.split(field, ":")
        return (
            F.when(bracketed & field.contains("http://"), terms.compact(field, prefixes))
            .when(bracketed, F.concat(F.lit("yago__"), bare))
            .when(
                no_brackets & field.contains(":") & ~terms.is_literal(field),
                F.concat(F.get(parts, F.lit(0)), F.lit("__"), F.get(parts, F.lit(1))),
            )
            .otherwise(field)
        )

    kept = lines.where(~value.startswith("#") & ~value.startswith("@")).where(F.size(fields) == 3)
    cleaned = [clean(F.get(fields, F.lit(i))) for i in range(3)]
    return kept.select(F.concat(F.concat_ws(" ", *cleaned), F.lit(" .")).alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str | None = "gzip") -> None:
    lines.select("value").write.mode("overwrite").text(path, compression=compression)


def extract_query(line: Column) -> Column:
    """The query text of an access-log line, null when there is none."""
    # What the clean-up replaces, and by what.
    decoded = F.regexp_replace(F.try_url_decode(line), r"[\r\n]", " ")
    query = F.regexp_extract(decoded, LOG_QUERY, 2)
    query = F.regexp_replace(query, r"\+", " ")
    query = F.regexp_replace(query, "  ", " ")
    query = F.regexp_replace(query, "SELECT (.+?) WHERE", "SELECT * WHERE")
    head = "".join(f"PREFIX {name}: <{ns}> " for name, ns in LOG_PREFIXES)
    return F.when(decoded.rlike(LOG_QUERY), F.concat(F.lit(head), query))


def log_queries(lines: DataFrame) -> DataFrame:
    """Distinct ``(client, query)`` of an access log: fields 0 and 6 of each line, decoded."""
    parts = F.split("value", " ")
    entries = lines.select(
        F.get(parts, F.lit(0)).alias("client"), F.get(parts, F.lit(6)).alias("request")
    ).where(F.col("request").isNotNull())
    entry = F.concat_ws("\t", "client", "request")
    queries = entries.dropDuplicates(["client", "request"]).select("client", extract_query(entry).alias("query"))
    return queries.where(F.col("query").isNotNull())


# Whether a line holds a query with a pattern that can be mined.
QUERY = r"(?i)\bselect\b.*\{.*\}"


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query``: one query per line; :func:`rejected_queries` lists lines that hold none.

    An id is made of the file's name, the line and a number for its repeats in the file, so it is
    the same whenever and however the file is read.
    """
    lines = _log_lines(spark, path)
    # Repeats of a line are alike, so any order numbers them the same.
    nth = F.row_number().over(Window.partitionBy("file", "value").orderBy(F.lit(0)))
    key = F.concat_ws("#", "file", F.sha2("value", 256), nth.cast("string"))
    return lines.select(key.alias("query_id"), F.col("value").alias("query"))


def rejected_queries(spark: SparkSession, path: str) -> DataFrame:
    """``file, value``: the lines of a log that hold no query, blank lines aside."""
    lines = _log_lines(spark, path)
    return lines.where(~F.col("value").rlike(QUERY) & (F.trim("value") != ""))


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def read_query_dir(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query``: one query per file, named after it."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("query_id"), F.col("value").alias("query")
    )
