"""Learning from a query log: which properties are joined together, and on which side.

A workload is ``(query_id, sub, prop, obj)``, one row per triple pattern. Lists that could
grow with the log are kept in counted long form; arrays only hold distinct items, so they are
bounded by the number of properties.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import prefixes as tables
from tripleweave.functions import terms
from tripleweave.operators.reductions import JOIN, OBJECT, SUBJECT, WORD_BITS, item_prop, small
from tripleweave.sources.scratch import staged

# The spelling of terms in query text.
VARIABLE = r"[?$]\w+"
IRI = r"<[^<>\s]*>"
SHORT = r"[\w-]*:[\w%-]+(?:\.[\w%-]+)*"
TAG = r"(?:@[\w-]+|\^\^[^\s.;,}]+)?"
QUOTED = r'(?s:"{3}.*?"{3}|\'{3}.*?\'{3}|"[^"\\]*+(?:\\.[^"\\]*+)*"|\'[^\'\\]*+(?:\\.[^\'\\]*+)*\')'
LITERAL = QUOTED + TAG
NUMBER = r"[+-]?\d+(?:\.\d+)?"
# Alternatives that can begin alike keep their order: a name before a number before a word.
TOKEN = rf"{VARIABLE}|{SHORT}|{IRI}|{NUMBER}|\w+|{LITERAL}|\S"
TRIPLES = "array<struct<sub:string,prop:string,obj:string>>"
PREFIX = r"(?i)PREFIX\s+([\w-]*):\s*<([^>]*)>"
BASE = r"(?i)BASE\s+<([^>]*)>"
# Patterns one task groups by query and variable: some hundred megabytes.
TASK_ROWS = 1_000_000
# Properties of a log whose items are bits, 63 to a column.
MASKED_PROPS = 500
# Queries one task parses: some seconds.
TASK_QUERIES = 50_000
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def is_variable(term: Column) -> Column:
    return term.startswith("?")


# Kinds of tokens.
OTHER, NODE, A, VALUE, COMMA, SEMICOLON, SELECT, VALUES, OPEN, CLOSE = range(10)
MARKS = {"a": A, ",": COMMA, ";": SEMICOLON, "{": OPEN, "}": CLOSE}
# What was read last: nothing of use, a subject, its property, an object; or what is passed over, up to a brace.
NOTHING, SUBJECT_READ, PROPERTY_READ, FULL, TO_OPEN, TO_CLOSE = range(6)


def _next_states() -> list[int]:
    """The state after each state and kind of token, state by state."""
    steps = {
        (SUBJECT_READ, NODE): PROPERTY_READ, (SUBJECT_READ, A): PROPERTY_READ, (SUBJECT_READ, SEMICOLON): SUBJECT_READ,
        (PROPERTY_READ, NODE): FULL, (PROPERTY_READ, VALUE): FULL,
        (FULL, COMMA): PROPERTY_READ, (FULL, SEMICOLON): SUBJECT_READ, (FULL, NODE): SUBJECT_READ,
        (NOTHING, NODE): SUBJECT_READ,
    }
    for state in (NOTHING, SUBJECT_READ, PROPERTY_READ, FULL):
        steps |= {(state, SELECT): TO_OPEN, (state, VALUES): TO_CLOSE}
    for state, brace in ((TO_OPEN, OPEN), (TO_CLOSE, CLOSE)):
        steps |= {(state, kind): NOTHING if kind == brace else state for kind in range(10)}
    return [steps.get((state, kind), NOTHING) for state in range(6) for kind in range(10)]


def _by_first(kinds: Mapping[str, int], default: int) -> Column:
    """The kinds of tokens that begin with each of the first characters, as a table."""
    return F.lit([kinds.get(chr(c), default) for c in range(128)])


DIGITS = "0123456789"
# Kinds that the first character leaves open: of a name, a number or a word.
NAME_OR_NUMBER, NAME_OR_WORD, NAME_OR_KEYWORD = -1, -2, -3


def _kind(token: Column) -> Column:
    """What a token of ``TOKEN`` is: longer ones tell it by their first character, a colon, or are keywords."""
    alone = _by_first(MARKS | dict.fromkeys(DIGITS, VALUE), OTHER)
    longer = _by_first(
        dict.fromkeys("?$<:", NODE) | dict.fromkeys("\"'", VALUE) | dict.fromkeys(DIGITS + "+-", NAME_OR_NUMBER)
        | dict.fromkeys("SsVv", NAME_OR_KEYWORD), NAME_OR_WORD
    )
    first = F.get(longer, F.ascii(token))
    return (
        F.when(F.length(token) == 1, F.coalesce(F.get(alone, F.ascii(token)), F.lit(OTHER)))
        .when(first >= 0, first)
        .when(F.contains(token, F.lit(":")), NODE)
        .when(first == NAME_OR_NUMBER, VALUE)
        .when((first == NAME_OR_KEYWORD) & (F.upper(token) == "SELECT"), SELECT)
        .when((first == NAME_OR_KEYWORD) & (F.upper(token) == "VALUES"), VALUES)
        .otherwise(OTHER)
    )


def _written_triples(body: Column) -> Column:
    """The triples of a query body as an array, with ``;`` and ``,`` lists written out.

    One pass over the tokens, each looked at once: a subject and a property wait for their objects. Anything that is
    no term (brackets, operators, keywords) ends what was begun, so expressions and paths give
    nothing; the variables of an inner ``SELECT`` and the rows of ``VALUES`` are passed over.
    """
    none = F.lit(None).cast("string")
    start = F.struct(
        F.lit(NOTHING).alias("state"), none.alias("sub"), none.alias("prop"), F.array().cast(TRIPLES).alias("found")
    )
    table = F.lit(_next_states())

    def step(was: Column, token: Column) -> Column:
        kind, text = token["kind"], token["text"]
        state = F.get(table, was["state"] * 10 + kind)
        one = F.array(F.struct(was["sub"].alias("sub"), was["prop"].alias("prop"), text.alias("obj")))
        began = (state == SUBJECT_READ) & (kind == NODE)
        named = (state == PROPERTY_READ) & (was["state"] == SUBJECT_READ)
        return F.struct(
            state.alias("state"),
            F.when(began, text).otherwise(was["sub"]).alias("sub"),
            F.when(named, text).otherwise(was["prop"]).alias("prop"),
            F.when((state == FULL), F.concat(was["found"], one)).otherwise(was["found"]).alias("found"),
        )

    tokens = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    kinds = F.transform(tokens, lambda t: F.struct(_kind(t).alias("kind"), t.alias("text")))
    return F.aggregate(kinds, start, step, lambda state: state["found"])


def _plain_quotes(term: Column) -> Column:
    """A literal between double quotes, whichever it was written with."""
    cut = rf"^({QUOTED})({TAG})$"
    quoted, tag = F.regexp_extract(term, cut, 1), F.regexp_extract(term, cut, 2)
    width = F.when(quoted.rlike("^(?:\"{3}|'{3})"), 3).otherwise(1)
    inner = F.substring(quoted, width + 1, F.length(quoted) - 2 * width)
    # A double quote inside gets its backslash, unless it has one.
    escaped = F.regexp_replace(inner, r'(?<!\\)"', r'\\"')
    odd = term.startswith("'") | term.startswith('"""')
    return F.when(odd, F.concat(F.lit('"'), escaped, F.lit('"'), tag)).otherwise(term)


def triple_patterns(
    queries: DataFrame, prefixes: Mapping[str, str] = tables.GENERIC, rows: int | None = None
) -> DataFrame:
    """``query_id, sub, prop, obj`` of every triple in the text of a query, lists written out.

    The query's own ``PREFIX`` and ``BASE`` lines are applied, then terms are compacted. With ``rows``, about
    how many queries there are, they are dealt over tasks first: a small file is one task's work otherwise.
    """
    if rows is not None:
        tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_QUERIES))
        queries = queries.repartition(tasks)
    text = F.col("query")
    body = F.regexp_extract(text, r"(?s)\{(.*)\}", 1)
    read = queries.select(
        "query_id",
        F.regexp_extract_all(text, F.lit(PREFIX), F.lit(1)).alias("names"),
        F.regexp_extract_all(text, F.lit(PREFIX), F.lit(2)).alias("namespaces"),
        F.regexp_extract(text, BASE, 1).alias("base"),
        F.inline(_written_triples(body)),
    )

    def full(term: Column) -> Column:
        at = F.array_position("names", F.substring_index(term, ":", 1))
        local = F.substring(term, F.locate(":", term) + 1, F.length(term))
        iri = F.concat(F.lit("<"), F.try_element_at("namespaces", at.cast("int")), local, F.lit(">"))
        inside = terms.strip_brackets(term)
        return (
            F.when(term.startswith("?"), term)
            .when(term.startswith("$"), F.concat(F.lit("?"), F.substring(term, F.lit(2), F.length(term))))
            .when(term == "a", F.lit(RDF_TYPE))
            .when(term.startswith("<") & ~inside.contains(":"), F.concat(F.lit("<"), "base", inside, F.lit(">")))
            .when(term.startswith("<") | terms.is_literal(term) | (at == 0), term)
            .otherwise(iri)
        )

    def compacted(term: Column) -> Column:
        return F.when(is_variable(term), term).otherwise(terms.compact_column(term, prefixes))

    # A step at a time and as generators of one row: a filter on a term would be pushed down, and
    # everything that mentions a term several times would work it out as often.
    ends = ("sub", "prop", "obj")
    for step in (_plain_quotes, full, compacted):
        found = F.inline(F.array(F.struct(*[step(F.col(c)).alias(c) for c in ends])))
        read = read.select(*[c for c in read.columns if c not in ends], found)
    return read.select("query_id", *ends)


def count_queries(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count(F.lit(1)).alias("queries"))


def query_properties(patterns: DataFrame) -> DataFrame:
    """``query_id, prop, n``: the constant properties of each query and how often it has them."""
    return patterns.where(~is_variable(F.col("prop"))).groupBy("query_id", "prop").agg(F.count(F.lit(1)).alias("n"))


def property_freq(patterns: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``prop, freq``: occurrences in the log, most frequent first, of stored properties only if ``stats``."""
    freq = patterns.where(~is_variable(F.col("prop"))).groupBy("prop").agg(F.count(F.lit(1)).alias("freq"))
    if stats is not None:
        freq = freq.join(stats.select("prop").distinct(), "prop", "left_semi")
    return freq.orderBy(F.col("freq").desc(), "prop")


def _uses(patterns: DataFrame) -> DataFrame:
    """``query_id, var, item``: every use of a variable as an end of a pattern."""
    ends = F.array(
        *[
            F.struct(F.col(c).alias("var"), F.concat_ws("_", "prop", F.lit(side)).alias("item"))
            for c, side in (("sub", SUBJECT), ("obj", OBJECT))
        ]
    )
    uses = patterns.select("query_id", "prop", F.inline(ends)).where(is_variable(F.col("var")))
    item = F.when(~is_variable(F.col("prop")), F.col("item"))
    return uses.select("query_id", F.substring("var", F.lit(2), F.length("var")).alias("var"), item.alias("item"))


def join_patterns(patterns: DataFrame) -> DataFrame:
    """``query_id, var, item, n``: for variables used at least twice in a query, their items, counted."""
    counted = _uses(patterns).groupBy("query_id", "var", "item").agg(F.count(F.lit(1)).alias("n"))
    # A window holds one row per distinct item, however often the query repeats it.
    total = F.sum("n").over(Window.partitionBy("query_id", "var"))
    return (
        counted.withColumn("total", total)
        .where((F.col("total") > 1) & F.col("item").isNotNull())
        .select("query_id", "var", "item", "n")
    )


def transactions(joins: DataFrame) -> DataFrame:
    """``query_id, var, items``: distinct items of the variables with more than one item in all."""
    return (
        joins.groupBy("query_id", "var")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("item")).alias("items"))
        .where(F.col("n") > 1)
        .select("query_id", "var", "items")
    )


def mined_transactions(patterns: DataFrame, rows: int | None = None) -> DataFrame:
    """The transactions of a workload in one shuffle: :func:`transactions` of its :func:`join_patterns`.

    Patterns are dealt by query before their two ends are told apart, and nothing is gathered ahead
    of that: nearly all groups are single there. With ``rows``, about how many patterns
    there are, a task gets ``TASK_ROWS`` of them. A group holds its distinct items and a count.
    """
    tasks = [] if rows is None else [max(patterns.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))]
    dealt = patterns.repartition(*tasks, "query_id")
    found = _uses(dealt).groupBy("query_id", "var").agg(
        F.count("item").alias("n"), F.sort_array(F.collect_set("item")).alias("items")
    )
    return found.where(F.col("n") > 1).select("query_id", "var", "items")


def item_sets(txns: DataFrame) -> DataFrame:
    """``items, n``: the distinct item sets of a log, however often it repeats them."""
    return txns.where(F.col("items").isNotNull()).groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def mined_item_sets(patterns: DataFrame, rows: int | None = None) -> DataFrame:
    """:func:`item_sets` of the :func:`mined_transactions` of a workload, written once for all that read them.

    An item is a bit as long as the log names at most ``MASKED_PROPS`` properties, which come to the driver: a group is then a few
    words or-ed together and not a set of names. Any other log is mined by sets.
    """
    spark = patterns.sparkSession
    named = patterns.where(~is_variable(F.col("prop"))).select("prop").distinct().limit(MASKED_PROPS + 1).collect()
    if len(named) > MASKED_PROPS:
        return staged(item_sets(mined_transactions(patterns, rows)), "item_sets")
    ends = {SUBJECT: "sub", OBJECT: "obj"}
    items = sorted((f"{r['prop']}_{side}", r["prop"], side) for r in named for side in ends)
    words = range(max(1, -(-len(items) // WORD_BITS)))
    at = {(prop, side): divmod(i, WORD_BITS) for i, (_, prop, side) in enumerate(items)}
    bits = [(r["prop"], *[1 << at[r["prop"], s][1] if at[r["prop"], s][0] == j else 0 for s in ends for j in words]) for r in named]
    index = spark.createDataFrame(bits, "prop string, " + ", ".join(f"{s}{j} bigint" for s in ends for j in words))

    tasks = [] if rows is None else [max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))]
    dealt = patterns.repartition(*tasks, "query_id").join(F.broadcast(index), "prop")
    each = [F.struct(F.col(c).alias("var"), *[F.col(f"{s}{j}").alias(f"w{j}") for j in words]) for s, c in ends.items()]
    uses = dealt.select("query_id", F.inline(F.array(*each))).where(is_variable(F.col("var")))
    found = uses.groupBy("query_id", "var").agg(F.count(F.lit(1)).alias("uses"), *[F.bit_or(f"w{j}").alias(f"w{j}") for j in words])
    sets = found.where(F.col("uses") > 1).groupBy(*[f"w{j}" for j in words]).agg(F.count(F.lit(1)).alias("n"))
    has = [F.when(F.col(f"w{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0, F.lit(m[0])) for i, m in enumerate(items)]
    none = F.array().cast("array<string>")
    return staged(sets.select((F.array_compact(F.array(*has)) if has else none).alias("items"), "n"), "item_sets")


def frequent(txns: DataFrame, min_support: float = 0.001) -> DataFrame:
    """:func:`frequent_of` the distinct transactions, counted first."""
    return frequent_of(item_sets(txns), min_support)


def frequent_of(sets: DataFrame, min_support: float = 0.001) -> DataFrame:
    """``items, freq, size``: itemsets of two or more items in at least that share of transactions, given as ``items, n``.

    A round extends each itemset found in them by an
    item before its first; what is shuffled are counted itemsets, and only places of frequent
    ones go on. Rounds and results are written, since the next round and several steps read them.
    """
    places = staged(sets.select(F.array().cast("array<string>").alias("items"), F.col("items").alias("rest"), "n"), "sets")
    least = math.ceil(min_support * (places.agg(F.sum("n")).first()[0] or 0))
    levels = []
    while True:
        each = places.select("items", "rest", "n", F.posexplode("rest").alias("at", "item")).select(
            F.concat(F.array("item"), "items").alias("items"), F.slice("rest", F.lit(1), F.col("at")).alias("rest"), "n"
        )
        counted = each.groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
        level = staged(counted.withColumn("size", F.size("items")), "frequent")
        levels.append(level)
        found = level.count()
        if not found:
            break
        kept = each.where(F.size("rest") > 0).join(small(level.select("items"), found), "items", "left_semi")
        places = staged(kept.select("items", "rest", "n"), "places")
    return reduce(DataFrame.unionByName, levels).where(F.col("size") > 1).select("items", "freq", "size")


def with_cost(itemsets: DataFrame, n_queries: int, n_props: int, alpha: float = 0.5) -> DataFrame:
    """Add ``cost``: support against the log, length against the properties; a log of one is worth 0."""

    def share(value: Column, whole: int) -> Column:
        return F.ln(value) / F.ln(F.lit(whole)) if whole > 1 else F.lit(0.0)

    cost = alpha * share(F.col("freq"), n_queries) + (1 - alpha) * share(F.size("items"), n_props)
    return itemsets.withColumn("cost", F.round(cost, 9))


def _best_per(df: DataFrame, key: str) -> DataFrame:
    """Highest cost first, then support, then the smaller items."""
    order = F.struct((-F.col("cost")).alias("c"), (-F.col("freq")).alias("f"), F.col("items").alias("items"))
    best = df.where(F.col("cost") > 0).groupBy(key).agg(F.min(order).alias("b"))
    return best.select(key, F.col("b.items").alias("items"), (-F.col("b.f")).alias("freq"), (-F.col("b.c")).alias("cost"))


def best_by_cost(itemsets: DataFrame, n_queries: int, n_props: int, alpha: float = 0.5) -> DataFrame:
    """``item, items, freq, cost``: the best itemset of every item."""
    priced = with_cost(itemsets, n_queries, n_props, alpha)
    return _best_per(priced.select(F.explode("items").alias("item"), "items", "freq", "cost"), "item")


def _props_of(items: str) -> Column:
    return F.sort_array(F.array_distinct(F.transform(items, item_prop)))


def propose_fp(best: DataFrame) -> DataFrame:
    """``prop, members``: the properties of the better of a property's two best itemsets."""
    per_prop = _best_per(best.withColumn("prop", item_prop(F.col("item"))), "prop")
    return per_prop.select("prop", _props_of("items").alias("members"))


def cooccurring(txns: DataFrame, *by: str) -> DataFrame:
    """``prop, other`` and the columns of ``by``: distinct pairs that share a transaction, a property with itself included.

    Transactions are reduced to their distinct property sets first, however often a log
    repeats them, and pairs are counted out before the shuffle.
    """
    sets = txns.select(*by, _props_of("items").alias("props")).distinct()
    pairs = sets.select(*by, F.explode("props").alias("prop"), "props").select(*by, "prop", F.explode("props").alias("other"))
    return pairs.distinct()


def propose_cooccurrence(txns: DataFrame) -> DataFrame:
    """``prop, members``: each property with all that share a transaction with it, itself included."""
    return cooccurring(txns).groupBy("prop").agg(F.sort_array(F.collect_list("other")).alias("members"))


def matching_patterns(itemsets: DataFrame, proposals: DataFrame) -> DataFrame:
    """``prop, pattern, head, members, size``: what of each itemset fits the proposal of a property.

    Needs the property itself and another item; both sides of a property may take part.
    """
    own = itemsets.select(F.explode(F.array_distinct(F.transform("items", item_prop))).alias("prop"), "items")
    fits = own.join(proposals.withColumnRenamed("members", "allowed"), "prop").select(
        "prop",
        F.filter("items", lambda i: F.array_contains("allowed", item_prop(i)) | (item_prop(i) == F.col("prop"))).alias(
            "items"
        ),
    )
    subject = F.concat_ws("_", "prop", F.lit(SUBJECT))
    head = F.when(F.array_contains("items", subject), F.lit(SUBJECT)).otherwise(OBJECT)
    named = fits.where(F.size("items") > 1).select("prop", "items", head.alias("head"))
    first = F.concat_ws("_", "prop", "head")
    rest = F.array_sort(F.array_remove("items", first))
    return named.select(
        "prop",
        F.array_join(F.concat(F.array(first), rest), JOIN).alias("pattern"),
        "head",
        rest.alias("members"),
        F.size("items").alias("size"),
    ).dropDuplicates(["prop", "pattern"])


def evaluate(proposals: DataFrame, gold: DataFrame) -> DataFrame:
    """``prop, precision, recall, f1`` of the properties both sides know."""
    both = proposals.join(gold.withColumnRenamed("members", "actual"), "prop").where(
        (F.size("members") > 0) & (F.size("actual") > 0)
    )
    hits = F.size(F.array_intersect("members", "actual"))
    scored = both.select(
        "prop", (hits / F.size("members")).alias("precision"), (hits / F.size("actual")).alias("recall")
    )
    return scored.withColumn("f1", _f1())


def evaluate_pairs(pairs: DataFrame, actual: Column) -> DataFrame:
    """:func:`evaluate` of ``prop, other`` pairs, actual or else proposed, in counted long form.

    Members of a property are never gathered, so no row grows with the number of properties.
    """
    has = F.max(F.when(actual, 0).otherwise(1)).alias("proposed"), F.max(F.when(actual, 1).otherwise(0)).alias("actual")
    both = F.col("proposed").bitwiseAND(F.col("actual"))
    sums = F.sum("proposed").alias("proposed"), F.sum("actual").alias("actual"), F.sum(both).alias("hits")
    counted = pairs.groupBy("prop", "other").agg(*has).groupBy("prop").agg(*sums).where("proposed > 0 and actual > 0")
    scored = counted.select(
        "prop", (F.col("hits") / F.col("proposed")).alias("precision"), (F.col("hits") / F.col("actual")).alias("recall")
    )
    return scored.withColumn("f1", _f1())


def _f1() -> Column:
    total = F.col("precision") + F.col("recall")
    return F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total)


def mean_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("properties"), F.avg("f1").alias("f1"))
