"""Semi-join reductions of property tables, exact or through Bloom filters.

An *item* is a property with a side: ``p_TRPS`` (its subjects) or ``p_TRPO`` (its objects). A
*pattern* of property ``p`` is one item of ``p`` (the head) and other items; a row of ``p``
is in the reduction when its head-side value occurs under every other item.

A row's *signature* has a bit for each pattern of its property that keeps it, however many
patterns there are. Rows of one property with one signature are a *class*; classes are
numbered so that those of a selective pattern are neighbours, and a reduction is then a few
ranges of class numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import bloom
from tripleweave.operators.numbering import numbered
from tripleweave.sources.triples import Triples, as_triples

# Fixed spellings of items and pattern names.
SUBJECT, OBJECT = "TRPS", "TRPO"
JOIN = "_JOIN_"

SIDES = {SUBJECT: "sub", OBJECT: "obj"}
# Rows of names and patterns that may be broadcast; more are joined as any other table.
BROADCAST_ROWS = 100_000
# Items or slots to a word of bits.
WORD_BITS = 63
# Names that may be listed in a scan's filter.
PUSHED_VALUES = 1_000
FPP = 0.001

CATALOG = "prop string, slot int, pattern string, head string, members array<string>, size int"


def item(prop: str, side: str) -> str:
    return f"{prop}_{side}"


def split_item(name: str) -> tuple[str, str]:
    prop, _, side = name.rpartition("_")
    return prop, side


def item_prop(name: Column) -> Column:
    return F.regexp_replace(name, "_TRP[SO]$", "")


def canonical(prop: str, items: Iterable[str]) -> tuple[str, str, list[str]]:
    """``(name, head side, other members)``: own side first, subject preferred, the rest sorted."""
    members = set(items)
    side = SUBJECT if item(prop, SUBJECT) in members else OBJECT
    head = item(prop, side)
    if head not in members:
        raise ValueError(f"{prop} is not part of {sorted(members)}")
    rest = sorted(members - {head})
    return JOIN.join([head, *rest]), side, rest


# -- Bloom filters ---------------------------------------------------------------------------


class Bloom(NamedTuple):
    """A filter table ``(block, w0..w7)`` and the number of blocks values are hashed into."""

    table: DataFrame
    n_blocks: int


def _or_words(rows: DataFrame, keys: Sequence[str], words: Sequence[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.bit_or(w).alias(n) for n, w in zip(bloom.WORDS, words)])


def bloom_build(values: DataFrame, n: int, fpp: float = FPP) -> Bloom:
    """Filter of a one-column frame, sized for ``n`` distinct values."""
    n_blocks = bloom.blocks_for(n, fpp)
    value = F.col(values.columns[0])
    rows = values.where(value.isNotNull()).select(bloom.block(value, n_blocks).alias("block"), value.alias("v"))
    return Bloom(_or_words(rows, ["block"], bloom.masks(F.col("v"))), n_blocks)


def bloom_union(filters: Sequence[Bloom]) -> Bloom:
    """The filter of all values of several filters of the same size."""
    sizes = {f.n_blocks for f in filters}
    if len(sizes) != 1:
        raise ValueError("only filters of one size can be merged")
    rows = reduce(DataFrame.unionByName, [f.table for f in filters])
    return Bloom(_or_words(rows, ["block"], [F.col(w) for w in bloom.WORDS]), sizes.pop())


def _probe(column: str, filter_: Bloom, tag: str) -> tuple[DataFrame, Column]:
    renamed = filter_.table.select(
        F.col("block").alias(f"{tag}_block"), *[F.col(w).alias(f"{tag}_{w}") for w in bloom.WORDS]
    )
    same_block = bloom.block(F.col(column), filter_.n_blocks) == F.col(f"{tag}_block")
    return renamed, same_block & bloom.contains(F.col(column), [F.col(f"{tag}_{w}") for w in bloom.WORDS])


def bloom_semi(df: DataFrame, column: str, filter_: Bloom) -> DataFrame:
    """Rows whose value may be in the filter: none that is gets lost, a few others stay."""
    table, hit = _probe(column, filter_, "__f")
    return df.join(table, hit, "left_semi")


def bloom_flag(df: DataFrame, column: str, filter_: Bloom, name: str) -> DataFrame:
    """Add a boolean column that is true where the value may be in the filter, else null."""
    table, hit = _probe(column, filter_, name)
    found = df.join(table, hit, "left")
    return found.select(*df.columns, F.when(F.col(f"{name}_block").isNotNull(), True).alias(name))


def filter_sizes(stats: DataFrame, fpp: float = FPP) -> DataFrame:
    """``prop, side, n_blocks``: blocks for the filter of each side of each property.

    ``stats`` gives the approximate number of distinct ``subjects`` and ``objects`` of each
    property; a tenth is added for what the approximation may miss.
    """
    per_block = bloom.BLOCK_BITS / bloom.bits_per_value(fpp) / 1.1

    def side(name: str, n: str) -> Column:
        blocks = F.greatest(F.lit(1), F.ceil(F.col(n) / per_block)).cast("bigint")
        return F.struct(F.lit(name).alias("side"), blocks.alias("n_blocks"))

    return stats.select("prop", F.inline(F.array(side(SUBJECT, "subjects"), side(OBJECT, "objects"))))


def build_filters(triples: DataFrame, sizes: DataFrame) -> DataFrame:
    """``prop, side, n_blocks, block, w0..w7``: the filters of all properties, both sides, one job."""
    wide = sizes.groupBy("prop").agg(*[F.max(F.when(F.col("side") == s, F.col("n_blocks"))).alias(s) for s in SIDES])
    sides = F.inline(
        F.array(
            *[
                F.struct(F.lit(s).alias("side"), F.col(s).alias("n_blocks"), F.col(c).alias("v"))
                for s, c in SIDES.items()
            ]
        )
    )
    rows = triples.join(wide, "prop").select("prop", sides).where(F.col("v").isNotNull())
    rows = rows.select("*", bloom.block(F.col("v"), F.col("n_blocks")).alias("block"))
    return _or_words(rows, ["prop", "side", "n_blocks", "block"], bloom.masks(F.col("v")))


# -- Semi-joins ------------------------------------------------------------------------------


def keys(source: Triples, prop: str, side: str) -> DataFrame:
    """Distinct values of one side of a property, as ``value``."""
    return as_triples(source).scan(prop).select(F.col(SIDES[side]).alias("value")).distinct()


def semi(source, left: tuple[str, str], right: tuple[str, str], filter_: Bloom | None = None) -> DataFrame:
    """Rows of ``left``'s property whose ``left`` side occurs on ``right``'s side.

    Exact by default; with a ``filter_`` of the right side, through that filter.
    """
    rows = as_triples(source).scan(left[0])
    column = SIDES[left[1]]
    if filter_ is not None:
        return bloom_semi(rows, column, filter_)
    found = keys(source, *right)
    return rows.join(found, F.col(column) == F.col("value"), "left_semi")


def pair_stats(source, pairs: Sequence[tuple[tuple[str, str], tuple[str, str]]]) -> DataFrame:
    """``prop, type, other, rows, vp_rows, scale`` of two-item reductions, all in one job.

    The type names the two sides: ``SS``, ``SO``, ``OS`` or ``OO``.
    """
    src = as_triples(source)
    rows: dict[str, list] = {}
    for (prop, side), right in pairs:
        of_prop = rows.setdefault(prop, [])
        name = JOIN.join([item(prop, side), item(*right)])
        of_prop.append((prop, len(of_prop), name, side, [item(*right)], 2))
    props = {p for pair in pairs for p, _ in pair}
    frame = src.frame_of(props)
    catalog = frame.sparkSession.createDataFrame([r for of_prop in rows.values() for r in of_prop], CATALOG)
    other = F.get("members", F.lit(0))
    names = asked_names(catalog)
    counted = signed(have_counts(occurrences(frame, catalog, names)), catalog, names)
    return slot_stats(class_counts(counted), catalog).select(
        "prop",
        F.concat(F.right("head", F.lit(1)), F.right(other, F.lit(1))).alias("type"),
        item_prop(other).alias("other"),
        "rows",
        "vp_rows",
        F.col("ratio").alias("scale"),
    )


# -- Signatures ------------------------------------------------------------------------------


def number_slots(patterns: DataFrame) -> DataFrame:
    """Give each property's patterns a slot, smallest patterns first. There is no limit to them."""
    order = Window.partitionBy("prop").orderBy("size", "pattern")
    return patterns.select(
        "prop", (F.row_number().over(order) - 1).alias("slot"), "pattern", "head", "members", "size"
    )


def _catalog_rows(prop: str, patterns: Iterable[Iterable[str]]) -> list[tuple]:
    named = {name: (head, rest) for name, head, rest in (canonical(prop, p) for p in patterns)}
    rows = sorted((len(rest) + 1, name, head, rest) for name, (head, rest) in named.items())
    return [(prop, i, name, head, rest, size) for i, (size, name, head, rest) in enumerate(rows)]


def catalog_of(spark, prop: str, patterns: Iterable[Iterable[str]]) -> DataFrame:
    """The catalog rows of one property from lists of items."""
    return spark.createDataFrame(_catalog_rows(prop, patterns), CATALOG)


def _among(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows with one of the values: a pushed-down list, or a semi-join for a long one."""
    if len(values) <= PUSHED_VALUES:
        return df.where(F.col(column).isin(values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return df.join(small(wanted, len(values)), column, "left_semi")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of known, limited length."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD_BITS)).cast("int"))


def _item_index(spark, items: list[str]) -> DataFrame:
    """``item, prop, side, word, mask``: a bit for each item, 63 to a word."""
    rows = [(m, *split_item(m), i // WORD_BITS, 1 << i % WORD_BITS) for i, m in enumerate(items)]
    return small(spark.createDataFrame(rows, "item string, prop string, side string, word int, mask bigint"), len(rows))


def _n_words(items: list[str]) -> int:
    return max(1, -(-len(items) // WORD_BITS))


def _words(n: int) -> list[Column]:
    """One bit set per word, or-ed together from ``word`` and ``mask``."""
    return [F.bit_or(F.when(F.col("word") == j, F.col("mask")).otherwise(F.lit(0))) for j in range(n)]


def asked_names(catalog: DataFrame) -> dict[str, list[str]]:
    """The distinct items, properties and heads of a catalog, and the ends (property and head) its patterns test, in one job."""

    def pairs(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.cast("string").alias("name")))

    own = [pairs("prop", F.array("prop")), pairs("head", F.array("head")), pairs("end", F.array(F.concat_ws("_", "prop", "head")))]
    found: dict[str, list[str]] = {kind: [] for kind in ("item", "prop", "head", "end")}
    for r in catalog.select(F.inline(F.concat(pairs("item", F.col("members")), *own))).distinct().collect():
        found[r["kind"]].append(r["name"])
    return {kind: sorted(values) for kind, values in found.items()}


class Filters(NamedTuple):
    """The Bloom filters of many items: ``prop, side, block, w0..w7`` and ``prop, side, n_blocks``."""

    table: DataFrame
    sizes: DataFrame


def _occurring(triples: DataFrame, index: DataFrame, items: list[str]) -> DataFrame:
    """``value, word, mask``: under which of the items each term occurs."""
    value = F.when(F.col("side") == SUBJECT, F.col("sub")).otherwise(F.col("obj")).alias("value")
    rows = _among(triples, "prop", sorted({split_item(m)[0] for m in items}))
    return rows.join(index, "prop").select(value, "word", "mask")


def _perhaps_occurring(triples: DataFrame, catalog: DataFrame, index: DataFrame, items: list[str], filters: Filters) -> DataFrame:
    """The same through filters, whatever the number of items: one join on item and block.

    Each distinct head-side value is paired with the items its patterns ask for.
    """
    asked = catalog.select("prop", "head", F.explode("members").alias("item")).distinct()
    names = asked_names(catalog)
    heads = F.inline(F.array(*[F.struct(F.lit(s).alias("head"), F.col(SIDES[s]).alias("value")) for s in names["head"]]))
    values = _among(triples, "prop", names["prop"]).select("prop", heads).where("value is not null").distinct()
    sizes = _among(filters.sizes, "prop", sorted({split_item(m)[0] for m in items}))
    wanted = asked.join(index.join(sizes, ["prop", "side"]).withColumnRenamed("prop", "of"), "item")
    pairs = values.join(wanted, ["prop", "head"]).select(
        "value", "of", "side", "word", "mask", bloom.block(F.col("value"), F.col("n_blocks")).alias("block")
    )
    table = filters.table.select(F.col("prop").alias("of"), "side", "block", *bloom.WORDS)
    probed = pairs.distinct().join(_among(table, "of", sorted({split_item(m)[0] for m in items})), ["of", "side", "block"])
    hit = bloom.contains(F.col("value"), [F.col(w) for w in bloom.WORDS])
    return probed.where(hit).select("value", "word", "mask")


def _asked_words(catalog: DataFrame, index: DataFrame, n_words: int) -> DataFrame:
    """``prop`` and words of bits for each side: the items that any of its patterns asks of that side's value."""
    sided = (
        catalog.select("prop", "head", F.explode_outer("members").alias("item"))
        .join(index.select("item", "word", "mask"), "item", "left")
    )
    of_side = lambda side, j: F.when((F.col("head") == side) & (F.col("word") == j), F.col("mask")).otherwise(F.lit(0))
    return sided.groupBy("prop").agg(*[F.bit_or(of_side(s, j)).alias(f"asked_{s}{j}") for s in SIDES for j in range(n_words)])


def occurrences(triples: DataFrame, catalog: DataFrame, names: dict[str, list[str]], filters: Filters | None = None) -> DataFrame:
    """``sub, prop, obj, have``: the items each row's ends occur under, of those its property's patterns ask for.

    Every item any pattern asks for is a bit. One aggregate gives each term the bits of the
    items it occurs under, and at most two joins bring them to the rows: words of bits for the subject, then for the object,
    where lists of names would travel. Exact, or through ``filters``.
    """
    needed, props = names["item"], names["prop"]
    n_words = _n_words(needed)
    index = _item_index(triples.sparkSession, needed)
    if filters is None:
        occurring = _occurring(triples, index, needed)
    else:
        occurring = _perhaps_occurring(triples, catalog, index, needed, filters)
    presence = occurring.groupBy("value").agg(*[w.alias(f"w{j}") for j, w in enumerate(_words(n_words))])

    asked = small(_asked_words(catalog, index, n_words), len(props) * n_words)

    def joined(of: list[str], tested: frozenset[str]) -> DataFrame:
        df = _among(triples, "prop", of).join(asked, "prop")
        have = []
        for side, column in SIDES.items():
            if side in tested:
                bits = [F.col(f"w{j}").alias(f"{side}{j}") for j in range(n_words)]
                df = df.join(presence.select(F.col("value").alias(column), *bits), column, "left")
                have += [F.coalesce(f"{side}{j}", F.lit(0)).bitwiseAND(F.col(f"asked_{side}{j}")) for j in range(n_words)]
            else:
                have += [F.lit(0).cast("bigint")] * n_words
        return df.select("sub", "prop", "obj", F.array(*have).alias("have"))

    # Rows go through the joins of those sides only that some pattern of their property tests.
    tests: dict[str, set[str]] = {p: set() for p in props}
    for prop, side in map(split_item, names["end"]):
        tests[prop].add(side)
    groups: dict[frozenset[str], list[str]] = {}
    for prop, sides in tests.items():
        groups.setdefault(frozenset(sides), []).append(prop)
    parts = [joined(of, sides) for sides, of in groups.items()] or [joined([], frozenset())]
    return reduce(DataFrame.unionByName, parts)


def signed(rows: DataFrame, catalog: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """``rows`` with ``sig``: which patterns of its ``prop`` keep what has the items ``have``, a bit per slot; a pattern is a mask test."""
    needed = names["item"]
    n_words = _n_words(needed)
    index = _item_index(catalog.sparkSession, needed)
    masks = (
        catalog.select("prop", "slot", "head", F.explode_outer("members").alias("item"))
        .join(index.select("item", "word", "mask"), "item", "left")
        .groupBy("prop", "slot", "head")
        .agg(F.array(*_words(n_words)).alias("masks"))
    )
    # Slots count from 0 without gaps, so the words of a property's signature follow each other.
    part = lambda slot: F.floor(slot / WORD_BITS)
    parts = F.sequence(F.lit(0), part(F.size("patterns") - 1))
    words = F.transform(parts, lambda w: F.filter("patterns", lambda p: part(p["slot"]) == w)).alias("words")
    per_prop = masks.groupBy("prop").agg(F.collect_list(F.struct("slot", _bit(F.col("slot")).alias("bit"), "head", "masks")).alias("patterns"))
    # A row per property, as wide as its patterns: broadcast if few properties have few of them.
    n_patterns = catalog.count()
    per_prop = small(per_prop.select("prop", words), n_patterns * n_words)

    def keeps(pattern: Column) -> Column:
        tests = []
        for j in range(n_words):
            have = F.get("have", F.when(pattern["head"] == SUBJECT, F.lit(j)).otherwise(F.lit(n_words + j)))
            mask = F.get(pattern["masks"], F.lit(j))
            tests.append(have.bitwiseAND(mask) == mask)
        return reduce(lambda a, b: a & b, tests)

    def word(patterns: Column) -> Column:
        none = F.lit(0).cast("bigint")
        return F.aggregate(patterns, none, lambda s, p: s.bitwiseOR(F.when(keeps(p), p["bit"]).otherwise(none)))

    return rows.join(per_prop, "prop").select(*rows.columns, F.transform("words", word).alias("sig"))


def signatures(triples: DataFrame, catalog: DataFrame, filters: Filters | None = None) -> DataFrame:
    """``sub, prop, obj, sig``: which patterns of its property keep each row, a bit per slot.

    Only names come to the driver: the properties and items the catalog mentions.
    """
    names = asked_names(catalog)
    return signed(occurrences(triples, catalog, names, filters), catalog, names).select("sub", "prop", "obj", "sig")


def have_counts(rows: DataFrame) -> DataFrame:
    """``prop, have, rows``: what the rows of a property have, counted. Patterns are tested once for each, not for each row."""
    return rows.groupBy("prop", "have").agg(F.count(F.lit(1)).alias("rows"))


def has_slot(sig: Column, slot: Column) -> Column:
    """Whether a signature has a slot's bit."""
    word = F.get(sig, F.floor(slot / WORD_BITS).cast("int"))
    return word.bitwiseAND(_bit(slot)) != 0


def class_counts(counted: DataFrame) -> DataFrame:
    """``prop, sig, slots, rows``: the classes of rows with one signature, from signed :func:`have_counts`."""
    counts = counted.groupBy("prop", "sig").agg(F.sum("rows").alias("rows"))
    every = F.sequence(F.lit(0), F.size("sig") * WORD_BITS - 1)
    return counts.select("prop", "sig", F.filter(every, lambda s: has_slot(F.col("sig"), s)).alias("slots"), "rows")


def slot_stats(classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog with ``rows``, ``vp_rows`` and ``ratio``, from the classes of many properties."""
    # Slot -1 stands for all rows. A row per property, as wide as it has patterns, so the classes are read once.
    each = classes.select("prop", "rows", F.explode(F.concat(F.array(F.lit(-1)), "slots")).alias("slot"))
    counted = each.groupBy("prop", "slot").agg(F.sum("rows").alias("rows")).groupBy("prop")
    by_slot = counted.agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("counts"))
    kept = F.coalesce(F.try_element_at("counts", F.col("slot")), F.lit(0).cast("bigint"))
    whole = F.col("counts")[-1]
    return catalog.join(by_slot, "prop").select(
        "prop", "slot", "pattern", "head", "members", "size", kept.alias("rows"), whole.alias("vp_rows"), (kept / whole).alias("ratio")
    )


def number_classes(classes: DataFrame, catalog: DataFrame) -> DataFrame:
    """The classes with a number, ``class``: those of a property follow each other, sorted by its shortest, then rarest patterns.

    Longer patterns are what shorter ones have in common, so their classes lie together as well:
    the rarest pair has one range of classes, the next one at most two.
    """
    kept = classes.select("prop", "rows", F.explode("slots").alias("slot")).groupBy("prop", "slot").agg(F.sum("rows").alias("rows"))
    sized = kept.join(catalog.select("prop", "slot", "size"), ["prop", "slot"])
    rarest = F.transform(F.sort_array(F.collect_list(F.struct("size", "rows", "slot"))), lambda r: r["slot"])
    order = sized.groupBy("prop").agg(rarest.alias("rarest"))
    # '0' where a pattern keeps the class, so that ascending order puts it first.
    key = F.array_join(
        F.transform(F.coalesce("rarest", F.array().cast("array<int>")), lambda s: F.when(has_slot(F.col("sig"), s), "0").otherwise("1")), ""
    )
    placed = classes.join(order, "prop", "left").select("prop", "sig", "slots", "rows", key.alias("key"))
    return numbered(placed.orderBy("prop", "key"), "class").drop("key")


def class_ranges(classes: DataFrame, most: int) -> DataFrame:
    """``prop, slot, ranges``: the classes of each slot as ``(first, last)``; null for more than ``most`` ranges."""
    each = classes.select("prop", "class", F.explode("slots").alias("slot"))
    at = F.row_number().over(Window.partitionBy("prop", "slot").orderBy("class"))
    runs = each.withColumn("run", F.col("class") - at).groupBy("prop", "slot", "run").agg(
        F.min("class").alias("first"), F.max("class").alias("last")
    )
    ranges = F.sort_array(F.collect_list(F.struct("first", "last")))
    return runs.groupBy("prop", "slot").agg(F.when(F.count(F.lit(1)) <= most, ranges).alias("ranges"))


def pattern_flags(
    source,
    prop: str,
    patterns: Iterable[Iterable[str]],
    filters: Filters | None = None,
) -> DataFrame:
    """``sub, obj`` and one column per pattern, named after it: true or null, never false.

    Exact by default; ``filters`` takes the Bloom filters instead.
    """
    src = as_triples(source)
    rows = _catalog_rows(prop, patterns)
    wanted = {prop, *(split_item(m)[0] for r in rows for m in r[4])}
    frame = src.frame_of(wanted)
    kept = signatures(frame, frame.sparkSession.createDataFrame(rows, CATALOG), filters)
    flag = lambda slot, name: F.when(has_slot(F.col("sig"), F.lit(slot)), True).alias(name)
    return kept.select("sub", "obj", *[flag(r[1], r[2]) for r in rows])


def pattern_stats(flags: DataFrame, skip: Sequence[str] = ("sub", "obj")) -> DataFrame:
    """``pattern, rows``: how many rows each flag column keeps, in one aggregate."""
    names = [c for c in flags.columns if c not in skip]
    counts = flags.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    return counts.unpivot([], [F.col(f"`{c}`") for c in names], "pattern", "rows")
