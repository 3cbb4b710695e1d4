"""Other shapes of property tables: objects as lists, several properties side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def vp(triples: DataFrame, prop: str) -> DataFrame:
    """The two-column table of one property."""
    return triples.where(F.col("prop") == prop).select("sub", "obj")


def counted_table(pairs: DataFrame) -> DataFrame:
    """``sub, obj, n``: each object of a subject once, with its number of repeats. No row grows with the data."""
    return pairs.groupBy("sub", "obj").agg(F.count(F.lit(1)).alias("n"))


def lists(counted: DataFrame, width: int | None = None) -> DataFrame:
    """``sub, part, objs``: the objects of a subject as sorted lists, repeats included.

    Of n objects, n / ``width`` lists are made, rounded up, and objects are dealt over them by a
    hash; without a width there is one list. The rule is the same for every subject.
    """
    if width is None:
        each = counted.select("sub", F.lit(0).alias("part"), F.array_repeat("obj", F.col("n").cast("int")).alias("objs"))
    else:
        parts = counted.groupBy("sub").agg(F.ceil(F.sum("n") / width).alias("parts"))
        # An object repeated more often than a list holds is cut into pieces first.
        pieces = F.expr(f"sequence(0L, cast((n - 1) div {width} as bigint))")
        spread = counted.select("sub", "obj", "n", F.explode(pieces).alias("piece")).join(parts, "sub")
        copies = F.least(F.lit(width), F.col("n") - F.col("piece") * width).cast("int")
        part = F.pmod(F.xxhash64("obj", "piece"), F.col("parts")).cast("int")
        each = spread.select("sub", part.alias("part"), F.array_repeat("obj", copies).alias("objs"))
    return each.groupBy("sub", "part").agg(F.sort_array(F.flatten(F.collect_list("objs"))).alias("objs"))


def compact_table(pairs: DataFrame, width: int | None = None) -> DataFrame:
    """:func:`lists` of a two-column table."""
    return lists(counted_table(pairs), width)


def wide_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of property tables on ``sub``; subjects with several objects multiply.

    Every table is padded with the subjects it lacks, which turns the outer joins into inner
    ones: a subject that fills one side or the other can then be split over tasks.
    """
    present = reduce(
        DataFrame.unionByName,
        (df.select("sub", F.lit(i).alias("i")) for i, df in enumerate(tables.values())),
    )
    has = [F.bool_or(F.col("i") == i).alias(f"has_{i}") for i in range(len(tables))]
    presence = present.groupBy("sub").agg(*has)
    padded = [
        df.select("sub", F.col("obj").alias(name)).unionByName(
            presence.where(~F.col(f"has_{i}")).select("sub", F.lit(None).cast("string").alias(name))
        )
        for i, (name, df) in enumerate(tables.items())
    ]
    return reduce(lambda a, b: a.join(b, "sub"), padded)
