"""Numbers for the rows of a sorted frame, without passing them through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.sources.scratch import checkpoint


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the frame's present order.

    The frame is written first, so that the numbers hold when a task is run again; then one
    count per partition tells where each partition's numbers begin.
    """
    kept = checkpoint(df)
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = kept.select("*", F.spark_partition_id().alias("__part"), in_partition.alias("__row"))
    sizes = placed.groupBy("__part").count().orderBy("__part").collect()  # one row per partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["__part"], total))
        total += r["count"]
    base = df.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    placed = placed.join(F.broadcast(base), "__part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__row") + F.col("__start")).alias(name))
