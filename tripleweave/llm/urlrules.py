"""URL rules as a sort-merge range join over reversed hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import shuffle_tasks
from tripleweave.sources.scratch import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(name: Column) -> Column:
    """A host's labels from the last to the first, each closed by a dot: a host and its subdomains are one interval."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


class Sweep:
    """The rules whose host interval holds the current key, outermost first.

    Keys come in order and intervals are nested, so a host whose key is no prefix of the current
    one is done with and leaves the stack.
    """

    def __init__(self, opened: list[tuple[str, dict[str, tuple[str, str]]]]):
        self.stack = [(k, dict(rules)) for k, rules in opened]

    def move(self, at: str) -> None:
        while self.stack and not at.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, at: str, prefix: str, rule: str, verdict: str) -> None:
        self.move(at)
        if not self.stack or self.stack[-1][0] != at:
            self.stack.append((at, {}))
        known = self.stack[-1][1].get(prefix)
        if known is None or (rule, verdict) < known:
            self.stack[-1][1][prefix] = (rule, verdict)

    def longest(self, place: str) -> tuple[str, str] | None:
        best = None
        for _, rules in reversed(self.stack):
            for size in sorted({len(p) for p in rules if len(p) <= len(place)}, reverse=True):
                found = rules.get(place[:size])
                if found is not None:
                    if best is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, a row per page.

    ``rules(rule, verdict)``: a rule is a host and a path prefix (``example.net/en/``) and fits
    its host and all subdomains; the longest fitting rule wins, then the deeper host, then the
    smaller verdict of two equal rules. Pages without a fitting rule get ``default``; a null url
    or one without ``://`` has an empty host and path and fits none.

    Rules and pages are sorted together by reversed host, and each range is swept once. Ranges
    are cut by path and page id too, so one host with a third of all pages is spread; what is
    open at the end of a range (the rules of a host and its parents) is handed to the next.
    Equal rules are made distinct first, so a repeated rule costs nothing.
    """
    spark = pages.sparkSession
    url = F.col("url")
    sides = pages.select(
        F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    cut = rules.where("rule is not null").select("rule", "verdict").distinct()
    own = F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER)
    openings = cut.select(
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), own.alias("host"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule", "verdict",
    )
    order = ["key", "kind", "path", "page_id"]
    events = sides.unionByName(openings).withColumn("key", key(F.col("host")))
    ranges = checkpoint(events.repartitionByRange(shuffle_tasks(spark), *order).sortWithinPartitions(*order))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = Sweep([]), None
        for batch in batches:
            for kind, at, place, rule, verdict in zip(*[batch.column(c).to_pylist() for c in ("kind", "key", "path", "rule", "verdict")], strict=True):
                last = at
                if kind == 0:
                    sweep.open(at, place, rule, verdict)
        if last is not None:
            sweep.move(last)
            flat = [(k, p, *rv) for k, known in sweep.stack for p, rv in known.items()] or [(None,) * 4]
            n = len(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array([last] * n)] + [pa.array([f[i] for f in flat], pa.string()) for i in range(4)],
                ["range", "last", "key", "path", "rule", "verdict"],
            )

    summary = ranges.select("kind", "key", "path", "rule", "verdict").mapInArrow(
        ends, "range int, last string, key string, path string, rule string, verdict string"
    )
    lasts: dict[int, str] = {}
    left: dict[int, list] = {}
    for r in summary.collect():  # per range, the rules open at its end
        lasts[r["range"]] = r["last"]
        if r["key"] is not None:
            left.setdefault(r["range"], []).append(r)
    carried: dict[int, list[tuple[str, dict]]] = {}
    sweep = Sweep([])
    for number in sorted(lasts):
        carried[number] = [(k, dict(known)) for k, known in sweep.stack]
        for r in sorted(left.get(number, []), key=lambda r: len(r["key"])):
            sweep.open(r["key"], r["path"], r["rule"], r["verdict"])
        sweep.move(lasts[number])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(carried.get(TaskContext.get().partitionId(), []))
        for batch in batches:
            found, keep = [], []
            for i, (kind, at, place, rule, verdict) in enumerate(
                zip(*[batch.column(c).to_pylist() for c in ("kind", "key", "path", "rule", "verdict")], strict=True)
            ):
                if kind == 0:
                    sweep.open(at, place, rule, verdict)
                else:
                    sweep.move(at)
                    keep.append(i)
                    found.append(sweep.longest(place) or (None, default))
            pages_ = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pages_.column("page_id"), pages_.column("host"), pages_.column("path"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return ranges.select("kind", "page_id", "host", "path", "rule", "verdict", "key").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string"
    )
