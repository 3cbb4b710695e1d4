"""Questions about keys that blocks of documents put to all others, packed into few rows.

A block is some MB of documents. It asks about many 64-bit keys at once: the keys are cut by
value into buckets, each (block, bucket) is one row of packed numbers, Spark shuffles the rows by
bucket, one bucket is answered at a time, and the answers go back to the block by a second
shuffle. A key that a third of all documents hold costs one entry per block, since a block asks
once for each distinct key. The documents of a block are written once, compressed, beside its
questions, so every later step finds the same blocks, also after a task or executor is lost.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import portions, shuffle_tasks, texts, written

BLOCK = 4 << 20
PER_BUCKET = 32 << 20  # bytes of text whose keys one bucket answers for
DOCUMENTS = "documents"

ROW = "kind string, bucket int, block long, a binary, b binary"
NAMES = ["kind", "bucket", "block", "a", "b"]
_CODEC = pa.Codec("zstd", compression_level=1)


def buckets_for(docs: DataFrame) -> int:
    """How many buckets the keys of ``docs`` are cut into: as many as bound what one of them holds, and one a task at least."""
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_tasks(docs.sparkSession), math.ceil(size / PER_BUCKET))


def rows(items: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*items, strict=True) if items else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, with their size and type before them, compressed where that helps."""
    data = np.ascontiguousarray(values)
    head = np.array([len(data)], "<i8").tobytes() + data.dtype.str.encode().ljust(4)
    return head + _CODEC.compress(data.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    kind = np.dtype(data[8:12].decode().strip())
    if not n:
        return np.zeros(0, kind)
    return np.frombuffer(_CODEC.decompress(data[12:], n * kind.itemsize, asbytes=True), kind)


class Documents:
    """The documents of a block: their ids and their texts in one array of bytes, ``gap`` zero bytes before each."""

    def __init__(self, ids: list[int | None], contents: list[bytes]):
        self.ids, self.contents = ids, contents

    def packed(self, block: int) -> tuple:
        data = b"".join(self.contents)
        sizes = np.array([len(c) for c in self.contents], np.int64)
        known = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        head = pack(np.concatenate([[len(ids), len(data)], sizes, known, ids]).astype(np.int64))
        return DOCUMENTS, 0, block, head, _CODEC.compress(data, asbytes=True) if data else b""

    @classmethod
    def unpacked(cls, a: bytes, b: bytes) -> Documents:
        head = unpack(a)
        n, size = int(head[0]), int(head[1])
        sizes, known, ids = head[2 : 2 + n], head[2 + n : 2 + 2 * n], head[2 + 2 * n :]
        data = _CODEC.decompress(b, size, asbytes=True) if size else b""
        ends = np.cumsum(sizes).tolist()
        contents = [data[e - s : e] for e, s in zip(ends, sizes.tolist(), strict=True)]
        return cls([i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], contents)

    def joined(self, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, with ``gap`` zeros before each text and at the end; begin and end of each text."""
        space = b"\0" * gap
        data = np.frombuffer(space + space.join(self.contents) + space, np.uint8)
        sizes = np.array([len(c) for c in self.contents], np.int64)
        ends = np.cumsum(sizes + gap)
        return data, ends - sizes, ends


def spread(kind: str, block: int, keys: np.ndarray, extra: np.ndarray, place: np.ndarray, buckets: int) -> list[tuple]:
    """A row for each bucket that a block has keys of; ``place`` is the bucket of each key."""
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        mine = order[cuts[b] : cuts[b + 1]]
        out.append((kind, b, block, pack(keys[mine]), pack(extra[mine])))
    return out


def gathered(kind: str, answers: list[tuple], place: np.ndarray, dtype) -> np.ndarray:
    """The answers to a block's questions, in the order of its keys."""
    out = np.zeros(len(place), dtype)
    for k, bucket, _, a, _ in answers:
        if k == kind:
            out[place == bucket] = unpack(a)
    return out


def by_value(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def ask(docs: DataFrame, questions: Callable[[Documents, int], list[tuple]], name: str, size: int = BLOCK) -> DataFrame:
    """Cut ``docs`` into blocks of ``size`` bytes; a written table of the blocks' documents and their questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, size):
            ids = batch.column("doc_id").to_pylist()
            part = Documents(ids, [t.as_buffer().to_pybytes() for t in batch.column("text")])
            # The number need only be unlike those of other blocks, and is written with it.
            block = zlib.crc32(repr(ids[:50]).encode()) << 31 | int(np.random.default_rng().integers(1 << 31))
            yield rows([part.packed(block), *questions(part, block)])

    return written(texts(docs).mapInArrow(run, ROW), name)


def answer(asked: DataFrame, kinds: list[str], reply: Callable[[str, list[tuple]], list[tuple]], name: str) -> DataFrame:
    """One (kind, bucket) at a time: all its questions together give a written table of answers."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        found = reply(kind, list(zip(*[table.column(c).to_pylist() for c in NAMES], strict=True)))
        return pa.Table.from_batches([rows(found)])

    return written(asked.where(F.col("kind").isin(*kinds)).groupBy("kind", "bucket").applyInArrow(run, ROW), name)


def per_block(tables: list[DataFrame], schema: str, run: Callable[[Documents, list[tuple]], pa.Table]) -> DataFrame:
    """``run`` for each block with its documents and everything the tables hold for it."""
    together = tables[0]
    for more in tables[1:]:
        together = together.union(more)

    def each(table: pa.Table) -> pa.Table:
        found = list(zip(*[table.column(c).to_pylist() for c in NAMES], strict=True))
        own = next(r for r in found if r[0] == DOCUMENTS)
        return run(Documents.unpacked(own[3], own[4]), [r for r in found if r[0] != DOCUMENTS])

    tasks = 4 * shuffle_tasks(together.sparkSession)
    return together.repartition(tasks, "block").groupBy("block").applyInArrow(each, schema)


def count_seen(_: str, asked: list[tuple]) -> list[tuple]:
    """Per key 0 if it was asked once in all, 1 if more often, 2 for the first of the askers then.

    ``b`` of a question tells how often the block itself has the key, one byte.
    """
    keys = [unpack(r[3]) for r in asked]
    counts = [unpack(r[4]) for r in asked]
    every, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    many = np.bincount(where, np.concatenate(counts)) > 1
    out = many[where].astype(np.uint8)
    out[first[many]] = 2
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return [(r[0], r[1], r[2], pack(part), None) for r, part in zip(asked, np.split(out, cuts), strict=True)]
