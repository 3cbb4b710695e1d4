"""Which table a scan reads: the plain property table or one of its reductions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One row per scan and join variable: the scanned property, the side the variable is on, and
# all items the variable has in the same conjunctive group.
NEEDS = "scan_id string, prop string, side string, items array<string>"


class Choice(NamedTuple):
    """A reduction to read: its place, its rows, and the ranges of classes that hold them (None: too many to list)."""

    run: str
    slot: int
    rows: int
    ranges: list[tuple[int, int]] | None


def best_pattern(stats: DataFrame, needs: DataFrame, scale_ub: float = 1.0) -> DataFrame:
    """``scan_id, pattern, slot, rows, vp_rows, run, ranges``: the smallest reduction each scan may read.

    A reduction fits when its other members are all among the variable's items, for then
    the joins of the group imply it. It is worth reading below ``vp_rows * scale_ub``.
    """
    fits = needs.join(
        stats.withColumnRenamed("head", "side"), ["prop", "side"]
    ).where(
        (F.size(F.array_except("members", "items")) == 0) & (F.col("rows") < F.col("vp_rows") * F.lit(scale_ub))
    )
    smallest = F.min(F.struct("rows", "size", "pattern", "slot", "vp_rows", "run", "ranges")).alias("best")
    return fits.groupBy("scan_id").agg(smallest).select(
        "scan_id", "best.pattern", "best.slot", "best.rows", "best.vp_rows", "best.run", "best.ranges"
    )


def smallest_table(pair_stats: DataFrame, scale_ub: float = 1.0) -> DataFrame:
    """``prop, type, other, rows``: per property, its own table (``VP``) or a smaller pair reduction."""
    own = pair_stats.groupBy("prop").agg(F.max("vp_rows").alias("rows")).select(
        "prop", F.lit("VP").alias("type"), F.lit("").alias("other"), "rows"
    )
    pairs = pair_stats.where(F.col("rows") < F.col("vp_rows") * F.lit(scale_ub)).select("prop", "type", "other", "rows")
    best = F.min(F.struct("rows", "type", "other")).alias("best")
    return own.unionByName(pairs).groupBy("prop").agg(best).select("prop", "best.type", "best.other", "best.rows")


def reduction_report(scans: DataFrame, needs: DataFrame, stats: DataFrame, vp_stats: DataFrame) -> DataFrame:
    """``query_id, scans, vp_rows, reduced_rows, ratio``: rows read per query without and with reductions.

    ``scans`` is ``(query_id, scan_id, prop)``.
    """
    best = best_pattern(stats, needs).select("scan_id", F.col("rows").alias("reduced"))
    read = scans.join(vp_stats.select("prop", "rows"), "prop", "left").join(best, "scan_id", "left")
    rows = F.coalesce("rows", F.lit(0))
    return (
        read.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("scans"),
            F.sum(rows).alias("vp_rows"),
            F.sum(F.coalesce("reduced", rows)).alias("reduced_rows"),
        )
        .withColumn("ratio", F.when(F.col("vp_rows") > 0, F.col("reduced_rows") / F.col("vp_rows")))
    )


class Reductions:
    """Reduced tables and their statistics, as a pattern match uses them."""

    def __init__(self, stats: DataFrame, scan: Callable[[str, Choice], DataFrame], scale_ub: float = 1.0):
        self.stats = stats
        self.scan = scan
        self.scale_ub = scale_ub

    def choose(self, needs: list[tuple]) -> dict[str, Choice]:
        """The choice for the scans of one query: a lookup in the statistics of its properties."""
        if not needs:
            return {}
        frame = self.stats.sparkSession.createDataFrame(needs, NEEDS)
        stats = self.stats.where(F.col("prop").isin(sorted({n[1] for n in needs})))
        best = best_pattern(stats, frame, self.scale_ub).collect()
        return {r.scan_id: Choice(r.run, r.slot, r.rows, r.ranges and [tuple(x) for x in r.ranges]) for r in best}
