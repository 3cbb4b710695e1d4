"""SimHash near-duplicates through a covering family of bit masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.components import components
from tripleweave.llm.tables import portions, texts, written

SHINGLE = 3
SEED = 42
BITS = 64


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the XXH64 values of the word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[SHINGLE - 1 :] - 1).tolist() or [len(joined)]
    begins = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 50_000 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) with ``fingerprint``, the 64 bits as a signed long."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            column = batch.column("text")
            prints = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column], np.uint64)
            arrays = [batch.column(f"_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(prints.view(np.int64))], [*(f"_{i}" for i in range(len(keep))), "fingerprint"]
            )

    # Own names inside, so that columns of the input cannot clash with ours.
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col("text"))
    schema = ", ".join([*(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "fingerprint long"])
    return inner.mapInArrow(run, schema).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "fingerprint")


def masks(radius: int) -> list[int]:
    """Covering masks: every pair within ``radius`` bits agrees on all bits of at least one mask.

    Each bit position gets a nonzero vector of ``radius + 1`` bits. Mask v (v nonzero) takes the
    positions whose vector has an odd product with v. The vectors of ``radius`` differing
    positions leave a nonzero v orthogonal to all of them, and that mask sees no difference.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))
    ]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct ``fp`` values within ``radius`` = 1 or 2 bits.

    The covering masks deal the fingerprints into tables. A bucket may hold any number of near
    copies, so its pairs are not compared: all its members agree on the mask, so two of them
    within two bits have a common midpoint that differs from each in at most one bit outside
    the mask. Every member goes to its midpoints; at most 65 values lie within one bit of a
    midpoint, and all of these are within two bits of each other, so each such small group is a
    star. No pair is lost and none beyond the radius is linked.
    """
    if radius not in (1, 2):
        raise ValueError("the midpoints cover a radius of 1 or 2 bits")
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks(radius))])
    dealt = prints.select("fp", F.explode(tables).alias("t")).select(
        "fp", "t.tab", "t.mask", F.col("fp").bitwiseAND(F.col("t.mask")).alias("bucket")
    )
    shared = dealt.groupBy("tab", "bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    members = dealt.join(written(shared.select("tab", "bucket"), "buckets"), ["tab", "bucket"], "left_semi")
    flips = [F.lit(0).cast("long")] + [F.lit(_signed(1 << i)) for i in range(BITS)]
    middle = members.select(
        "fp", F.explode(F.filter(F.array(*flips), lambda x: x.bitwiseAND(F.col("mask")) == 0)).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    # A midpoint has at most 65 members: the values within one bit of it.
    stars = middle.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, component_id)`` for every distinct ``fingerprint`` of ``prints(doc_id, fingerprint)``."""
    each = written(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    roots = written(components(links(each.select("fp"), radius)), "roots")
    linked = each.join(roots, each["fp"] == roots["node"])
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(roots.join(lowest, "root").select(F.col("node").alias("fp"), "component_id"), "linked")
    alone = each.join(found, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return alone.union(found)


def hexadecimal(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row per document.

    Null and empty texts and texts of white space have fingerprint zero and are linked like any
    other. Rows with the same ``doc_id`` each give a row; a component of null ids has a null id.
    """
    prints = written(fingerprints(texts(docs)), "fingerprints")
    groups = written(classes(prints, radius), "classes")
    return prints.join(groups, prints["fingerprint"] == groups["fp"]).select(
        "doc_id", hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One whole row of ``docs`` for each component: that of the smallest ``doc_id``, then text.

    The columns stay as they are. Rows are reduced to one per fingerprint while they are
    shuffled, with copies combined before the shuffle.
    """
    prints = written(fingerprints(docs, docs.columns), "fingerprints")
    columns = [c for c in prints.columns[:-1]]
    row = F.struct(*[F.col(c) for c in columns])
    first = prints.groupBy(F.col("fingerprint").alias("_fp")).agg(
        F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("_row")
    )
    light = prints.select("doc_id", "fingerprint")
    each = written(light.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    roots = written(components(links(each.select("fp"), radius)), "roots")
    ranked = each.join(roots, each["fp"] == roots["node"])
    winner = ranked.groupBy("root").agg(F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp")).alias("best"))
    losers = written(ranked.join(winner, "root").where("fp <> best").select(F.col("fp").alias("_lost")), "losers")
    return first.join(losers, F.col("_fp") == F.col("_lost"), "left_anti").select("_row.*")
