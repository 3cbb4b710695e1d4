"""Shards that are level in bytes, tokens and rows at once, by vector bin packing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.tables import WORD, written

PER_TASK = 50_000  # groups packed by one task
SPLIT = 32  # a group larger than 1/SPLIT of a shard is cut into pieces


def pack(sizes: np.ndarray, shards: int, turn: int = 0) -> np.ndarray:
    """A shard for each row of ``sizes``: the largest first, each where the dot product of its
    vector with what is left of the shard's capacity is highest. ``turn`` rotates ties."""
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    scaled = sizes / capacity
    room = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), np.int32)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        fit = room @ scaled[i]
        best = (int(np.argmax(np.roll(fit, -turn))) + turn) % shards
        room[best] -= scaled[i]
        out[i] = best
    return out


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, a row per document.

    Equal texts form a group and stay together; a group beyond 1/32 of a shard in bytes, tokens
    or rows is cut into pieces (there are at most ``3 * 32 * shards`` such groups). Groups are
    packed by tasks that each fill all shards to their own level, so nothing passes through one
    place. Slots: a group's place among those of its task in its shard, after the rows of the
    tasks before. Null and empty texts are one group of size 16; repeated rows, also of one id or of a null id in
    bulk, keep a row each and are cut like any other; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.xxhash64(text, F.octet_length(text)).alias("digest"),
            # Written with the sizes, so it stays; tells apart rows that are alike in all else.
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    group = ["digest", "text_crc32"]
    groups = written(
        rows.groupBy(*group).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups"
    )
    total = groups.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n"), F.count("*").alias("groups")).first()
    most = {c: max(1.0, (total[c] or 0) / (shards * SPLIT)) for c in ("size", "tokens", "n")}
    pieces = F.ceil(F.greatest(*[F.col(c) / F.lit(m) for c, m in most.items()])).cast("int")
    heavy = groups.select(*group, pieces.alias("pieces")).where("pieces > 1")
    cut = rows.join(F.broadcast(heavy), group, "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("int")
    )
    parts = [*group, "piece"]
    light = written(cut.select("doc_id", "row", "size", "tokens", *parts), "pieces")
    vectors = light.groupBy(*parts).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    tasks = max(1, math.ceil((total["groups"] + heavy.count()) / PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        number = TaskContext.get().partitionId()
        table = table.sort_by([(c, "ascending") for c in parts])
        n = table.column("n").to_numpy()
        sizes = np.stack([table.column("size").to_numpy(), table.column("tokens").to_numpy(), n], axis=1).astype(float)
        chosen = pack(sizes, shards, number % shards)
        begin = np.zeros(len(n), np.int64)
        for s in range(shards):
            mine = chosen == s
            begin[mine] = np.cumsum(n[mine]) - n[mine]
        out = [table.column(c).combine_chunks() for c in parts]
        out += [pa.array(np.full(len(n), number, np.int32)), pa.array(chosen), pa.array(begin), pa.array(n)]
        yield pa.RecordBatch.from_arrays(out, [*parts, "task", "shard", "begin", "n"])

    schema = "digest long, text_crc32 long, piece int, task int, shard int, begin long, n long"
    placed = written(vectors.repartition(tasks, *parts).mapInArrow(run, schema), "placed")
    filled = placed.groupBy("task", "shard").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    homes = placed.drop("n").join(offsets, ["task", "shard"]).select(*parts, "shard", (F.col("begin") + F.col("offset")).alias("begin"))
    # A piece is at most 1/32 of a shard, so numbering its rows is a bounded sort.
    own = Window.partitionBy(*parts).orderBy("doc_id", "row")
    return light.join(written(homes, "homes"), parts).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("begin") + F.row_number().over(own) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
