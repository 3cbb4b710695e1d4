"""Benchmark decontamination: the exact shingle similarity of all item-sized windows, rolled from hit to hit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import portions, written

SHINGLE = 5
SIMILARITY = 0.8
ITEMS = 20_000  # items that are broadcast at a time
PORTION = 1 << 20  # bytes of text that are looked at together; they take some 50 bytes of memory each

_PLAIN = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)  # letters, digits and everything beyond ASCII stay
_MULTIPLY, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def plain(text: str) -> bytes:
    return text.lower().encode().translate(_PLAIN)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word of plain bytes, all at once: differences of a running sum of powers."""
    letters = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    begins, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _MULTIPLY), out=sums[1:])
        inverse = _powers(len(data) + 1, _INVERSE)
        return begins, ends, _mix((sums[ends] - sums[begins]) * inverse[begins])


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(_MULTIPLY) + words[k : k + n]
        return _mix(total + np.uint64(size))


def shingles(words: list[bytes]) -> Counter:
    size = min(SHINGLE, len(words))
    return Counter(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: what the two multisets share, over what they hold together."""
    shared = (a & b).total()
    return shared / (a.total() + b.total() - shared) if shared else 0.0


@dataclass
class Index:
    """A set of items and where their shingles occur.

    ``homes`` has, for each hash of ``hashes``, the items with that shingle, the shingle's number
    in the item and how often it stands there.
    """

    ids: list[int]
    lengths: list[int]
    sizes: list[int]
    weights: list[Counter]
    hashes: dict[int, np.ndarray]
    homes: dict[int, list[list[tuple[int, int, int]]]]
    filters: dict[int, np.ndarray]

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        words = [(i, plain(t or "").split()) for i, t in items]
        words = [(i, w) for i, w in words if w]
        weights = [shingles(w) for _, w in words]
        sizes = [min(SHINGLE, len(w)) for _, w in words]
        places: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
        for number, (_, w) in enumerate(words):
            own = Counter(runs(word_hashes(np.frombuffer(b" ".join(w), np.uint8))[2], sizes[number]).tolist())
            for k, (h, times) in enumerate(own.items()):
                places.setdefault(sizes[number], {}).setdefault(h, []).append((number, k, times))
        hashes = {size: np.array(sorted(p), np.uint64) for size, p in places.items()}
        filters = {}
        for size, h in hashes.items():
            filters[size] = np.zeros(1 << 20, bool)
            filters[size][h >> np.uint64(44)] = True
        homes = {size: [places[size][h] for h in hashes[size].tolist()] for size in hashes}
        return cls([i for i, _ in words], [len(w) for _, w in words], sizes, weights, hashes, homes, filters)

    def best(self, item: int, hits: list[tuple[int, int, int]], last: int, length: int) -> tuple[float, int, int] | None:
        """The best (similarity, begin, end) of the windows of ``length`` words, or up to ``last``, that share a shingle.

        ``hits`` are the places of the item's shingles in order, with number and times in the item.
        Moved on to the next hit a window loses no shared shingle, so only windows that begin at a
        hit are looked at; of equal ones the first counts.
        """
        size, whole = self.sizes[item], self.weights[item].total()
        if min(SHINGLE, length) != size:
            return None
        inside: Counter = Counter()
        shared = upto = 0
        top, found = 0.0, None
        for place, number, times in hits:
            end = min(place + length, last)
            while upto < len(hits) and hits[upto][0] + size <= end:
                _, k, most = hits[upto]
                inside[k] += 1
                shared += inside[k] <= most
                upto += 1
            value = shared / (end - place - size + 1 + whole - shared)
            if value > top:
                top, found = value, (place, end)
            shared -= inside[number] <= times
            inside[number] -= 1
        return (top, *found) if found and top >= SIMILARITY else None

    def scan(self, texts: list[str | None]) -> list[dict[int, tuple[float, int, int]]]:
        """Per text: for each item that a window of its size matches, the best (similarity, first word, words)."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        pieces = [plain(t or "") for t in texts]
        data = b" \x01 ".join(pieces)  # a word that plain text cannot hold keeps texts apart
        if not self.ids or not data:
            return out
        array = np.frombuffer(data, np.uint8)
        begins, ends, words = word_hashes(array)
        marks = np.flatnonzero(array[begins] == 1) if len(begins) else np.zeros(0, np.int64)
        firsts = np.concatenate([[0], marks + 1])
        lasts = np.concatenate([marks, [len(begins)]])
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for size, wanted in self.hashes.items():
            seen = runs(words, size)
            maybe = np.flatnonzero(self.filters[size][seen >> np.uint64(44)])
            at = np.searchsorted(wanted, seen[maybe])
            hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == seen[maybe])
            for place, h in zip(maybe[hit].tolist(), at[hit].tolist(), strict=True):
                text = int(np.searchsorted(firsts, place, side="right")) - 1
                for item, number, times in self.homes[size][h]:
                    hits.setdefault((text, item), []).append((place, number, times))
        for (text, item), places in hits.items():
            first, last, whole = int(firsts[text]), int(lasts[text]), self.weights[item].total()
            # No window shares more than the text does, and it must share SIMILARITY of the item.
            times = {number: most for _, number, most in places}
            if sum(min(n, times[k]) for k, n in Counter(k for _, k, _ in places).items()) < SIMILARITY * whole:
                continue
            length = self.lengths[item]
            window = self.best(item, places, last, length)
            if window is None:
                continue
            value, begin, end = window
            like = lambda a: similarity(shingles(data[begins[a] : ends[min(a + length, last) - 1]].split()), self.weights[item])  # noqa: B023, E731
            value = like(begin)
            while begin > first and value and like(begin - 1) == value:
                begin -= 1
            if value >= SIMILARITY:
                best = (value, -(begin - first), min(begin + length, last) - begin)
                out[text][self.ids[item]] = max(best, out[text].get(self.ids[item], best))
        return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in indexes of at most ITEMS items, so that what is broadcast is bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    held: list[tuple[int, str]] = []
    for r in items.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == ITEMS:
            yield Index.build(held)
            held = []
    if held:
        yield Index.build(held)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: documents with a window like an item.

    Words are lower-cased runs of letters and digits. For every item, all windows of its own number
    of words (fewer at the end of the text) that share a shingle of five words with it are compared,
    wherever they begin; a window without one has similarity zero. What other items there are plays no part. Those with a weighted shingle similarity of 0.8 or more are
    matches. One row per document and item, its best window, the first of equal ones.
    Documents without a match, null and empty texts give no row. Items of fewer than five words
    are one shingle; items that are null or have no word match nothing; a repeated item id keeps
    its best match per broadcast of ``ITEMS``.
    """
    return _matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, pa.int64())


def _matches(rows: DataFrame, benchmark: DataFrame, kind: pa.DataType) -> DataFrame:
    """:func:`leaks` of ``rows(doc_id, text)``, whose ids are of the given kind."""
    spark = rows.sparkSession
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, first_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, PORTION):
                found = []
                ids = batch.column("doc_id").to_pylist()
                for doc, matches in zip(ids, held.value.scan(batch.column("text").to_pylist()), strict=True):
                    found += [(doc, item, v, -first, n) for item, (v, first, n) in sorted(matches.items())]
                if found:
                    kinds = [kind, pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

        out = out.union(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, columns as they are. Rows are judged by their texts, whatever their ids."""
    # Only digests and texts go to Python, and digests of texts with a match come back.
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = _matches(docs.select(digest.alias("doc_id"), "text"), benchmark, pa.binary())
    found = written(found.select(F.col("doc_id").alias("_digest")).distinct(), "leaks")
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], digest.alias("_digest"))
    return own.join(found, "_digest", "left_anti").select(*names).toDF(*docs.columns)
