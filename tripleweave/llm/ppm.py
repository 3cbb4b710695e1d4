"""Language-model scores by prediction by partial matching over bytes, beside a word unigram base."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.decontamination import _mix
from tripleweave.llm.exchange import DOCUMENTS, Documents, answer, ask, buckets_for, by_value, gathered, pack, per_block, spread, unpack
from tripleweave.llm.repeats import Prints

ORDER = 4  # bytes of context
BLOCK = 4 << 20
PART = 1 << 20  # bytes of a block that are read at a time: their steps take some 50 bytes of memory each
PIECE = 1 << 18  # steps that are scored at a time
END = 256  # the symbol after a document's last byte
SYMBOLS = 257
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# A step in the trie: up to four context bytes, the nearest lowest, then nine bits of symbol.
_LOW = {k: np.uint64((1 << (8 * k + 9)) - 1) for k in range(ORDER + 1)}

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(doc_id: int | None) -> int:
    """The fold of a document: crc32 of its id as text, modulo 5. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


class Symbols:
    """Words and trie steps of some documents, all at once."""

    def __init__(self, part: Documents):
        self.ids = part.ids
        data, begins, ends = part.joined(ORDER + 1)
        data = _LOWER[data]
        self.n = len(begins)
        self.train = np.array([remainder(i) != 1 for i in part.ids], bool)
        # Words: a text's gap counts as white space, so that no word crosses it.
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begins] += 1
        np.subtract.at(inside, ends, 1)
        text = np.cumsum(inside[:-1], dtype=np.int8) > 0
        letters = np.concatenate([[False], text & ~_SPACE[data], [False]])
        edges = np.flatnonzero(letters[1:] != letters[:-1])
        starts, stops = edges[::2], edges[1::2]
        self.words = Prints(data).of(starts, stops)
        self.word_of = np.searchsorted(begins, starts, side="right") - 1
        # Steps: each byte of a text and its end, after the four bytes before it.
        spots = np.concatenate([np.flatnonzero(text).astype(np.int32), ends.astype(np.int32)])
        self.steps = data[spots].astype(np.uint64)
        self.steps[len(spots) - self.n :] = END
        for k in range(1, ORDER + 1):
            context = data[spots - k].astype(np.uint64)
            context <<= np.uint64(9 + 8 * (k - 1))
            self.steps |= context
        sizes = ends - begins
        self.step_of = np.concatenate([np.repeat(np.arange(self.n, dtype=np.int32), sizes), np.arange(self.n, dtype=np.int32)])


def parts(block: Documents) -> Iterator[Symbols]:
    """A block's symbols, PART bytes of documents at a time."""
    ends = np.cumsum([len(c) for c in block.contents])
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + PART, side="right")))
        yield Symbols(Documents(block.ids[begin:end], block.contents[begin:end]))
        begin = end


class Reading:
    """A part's symbols as numbers into its distinct words and steps, for when their values are known."""

    def __init__(self, symbols: Symbols):
        self.n, self.ids, self.train = symbols.n, symbols.ids, symbols.train
        self.words, where = np.unique(symbols.words, return_inverse=True)
        self.word, self.word_of = where.astype(np.int32), symbols.word_of.astype(np.int32)
        self.steps, where = np.unique(symbols.steps, return_inverse=True)
        self.step, self.step_of = where.astype(np.int32), symbols.step_of


def _distinct(keys: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs in training documents."""
    known, n = np.unique(keys[train], return_counts=True)
    every = np.union1d(known, keys[~train])
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, known)] = n
    return every, out


def _least(n: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold the largest."""
    return n.astype(np.min_scalar_type(int(n.max()))) if len(n) else n.astype(np.uint8)


def _merged(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts in order and the sums of their counts.

    Parts are added up whenever they outgrow what is known already, so memory goes by the distinct keys.
    """
    known, total = np.zeros(0, np.uint64), np.zeros(0)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([known, *[k for k, _ in waiting]]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([total, *[n for _, n in waiting]]), len(keys))

    held = 0
    for keys, n in parts:
        waiting.append((keys, n))
        held += len(keys)
        if held > max(PIECE, len(known)):
            known, total = merge()
            waiting, held = [], 0
    return merge() if waiting else (known, total)


def _context_bucket(steps: np.ndarray, buckets: int) -> np.ndarray:
    """All steps whose two nearest context bytes agree meet, so the contexts of order 2 to 4 do too."""
    near = (steps >> np.uint64(9)) & np.uint64(0xFFFF)
    return by_value(_mix(near), buckets)


class Level:
    """Contexts of one order: their symbols' counts, and per context their total and number."""

    def __init__(self, steps: np.ndarray, counts: np.ndarray):
        self.steps, where = np.unique(steps, return_inverse=True)
        self.counts = np.bincount(where, counts, len(self.steps)) if len(steps) else np.zeros(0)
        self.contexts, at, self.kinds = np.unique(self.steps >> np.uint64(9), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, at) if len(at) else np.zeros(0)
        self.begins = at

    def symbol(self, steps: np.ndarray) -> np.ndarray:
        return _found(self.steps, steps, self.counts)

    def held_by(self, higher: Level, mask: np.uint64) -> np.ndarray:
        """Per context of the next order, what its symbols count here: the symbols an escape excludes."""
        return np.add.reduceat(self.symbol(higher.steps & mask), higher.begins) if len(higher.begins) else np.zeros(0)


def _found(known: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0.0)


def log_probabilities(levels: list[Level], steps: np.ndarray) -> np.ndarray:
    """log10 of the probability of each step, given the levels of order 0 to ORDER.

    From the longest context down: a context that was never seen is passed over; one that knows
    the symbol gives it its count's share; else the escape takes the share of the number of kinds
    of symbols (method C). Symbols that the longer context knows are excluded: every one of them
    is known to the shorter context as well. Below order 0 all symbols left are alike.
    """
    held = [levels[k - 1].held_by(levels[k], _LOW[k - 1]) if k else None for k in range(ORDER + 1)]
    pieces = [_scored(levels, held, steps[i : i + PIECE]) for i in range(0, len(steps), PIECE)]
    return np.concatenate(pieces) if pieces else np.zeros(0)


def _scored(levels: list[Level], held: list[np.ndarray | None], steps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(steps))
    open_ = np.ones(len(steps), bool)
    less_total, less_kinds = np.zeros(len(steps)), np.zeros(len(steps))
    for k in range(ORDER, -1, -1):
        level = levels[k]
        own = steps & _LOW[k]
        contexts = own >> np.uint64(9)
        total = _found(level.contexts, contexts, level.totals)
        kinds = _found(level.contexts, contexts, level.kinds.astype(float))
        left, left_kinds = total - less_total, kinds - less_kinds
        live = open_ & (left + left_kinds > 0)
        count = level.symbol(own)
        hit = live & (count > 0)
        out[hit] += np.log10(count[hit] / (left + left_kinds)[hit])
        miss = live & ~hit
        out[miss] += np.log10(left_kinds[miss] / (left + left_kinds)[miss])
        open_ &= ~hit
        if k:
            less_total, less_kinds = _found(level.contexts, contexts, held[k]), kinds
    rest = SYMBOLS - (len(levels[0].steps))
    if rest > 0:
        out[open_] -= math.log10(rest)
    return out


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per document.

    Training documents are those whose crc32 of the id modulo 5 is not 1. Texts are lower-cased
    (A-Z). ``base_score`` is the unigram score of words and one end, ``score`` the log10
    probability of the text's bytes and its end under the trie of the training documents.
    Steps are counted per block first; the trie lies spread over the buckets, its orders 2 to 4
    each whole in one of them. Only orders 0 and 1 (at most 256 * 257 counts) and four totals go
    through the driver. Null and empty texts are scored for their end alone.
    """
    spark = docs.sparkSession
    buckets = buckets_for(docs)

    def questions(part: Documents, block: int) -> list[tuple]:
        counted = [(_counted(s.words, s.train[s.word_of]), _counted(s.steps, s.train[s.step_of])) for s in parts(part)]
        words, n = _merged(c for c, _ in counted)
        steps, m = _merged(c for _, c in counted)
        near, where = np.unique(steps & _LOW[1], return_inverse=True)
        first = ("near", 0, block, pack(near), pack(np.bincount(where, m, len(near)).astype(np.int64)))
        return [
            *spread("word", block, words, _least(n), by_value(words, buckets), buckets),
            *spread("step", block, steps, _least(m), _context_bucket(steps, buckets), buckets),
            first,
        ]

    asked = ask(docs, questions, "symbols", BLOCK)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 17, np.int64)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                table[unpack(a).astype(np.int64)] += unpack(b)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at])], ["step", "n"])

    partial = asked.where("kind = 'near'").select("a", "b").mapInArrow(add, "step long, n long")
    near = partial.groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toPandas()  # at most 256 * 257 rows
    low = (near["step"].to_numpy(np.uint64), near["n"].to_numpy(float))
    shared = spark.sparkContext.broadcast(low)

    def reply(kind: str, found: list[tuple]) -> list[tuple]:
        every, total = _merged((unpack(r[3]), unpack(r[4])) for r in found)
        if kind == "word":
            values, more = total.astype(np.int64), pack(np.array([total.sum(), np.count_nonzero(total)], np.int64))
        else:
            steps, n = every[total > 0], total[total > 0]
            levels = [Level(shared.value[0] & _LOW[0], shared.value[1]), Level(*shared.value)]
            levels += [Level(steps & _LOW[k], n) for k in range(2, ORDER + 1)]
            values, more = log_probabilities(levels, every), None
        # The bucket's totals go with the answer to its first asker.
        return [
            (kind, r[1], r[2], pack(values[np.searchsorted(every, unpack(r[3]))]), more if i == 0 else None)
            for i, r in enumerate(found)
        ]

    answered = answer(asked, ["word", "step"], reply, "answers")
    blocks = asked.where(asked["kind"] == DOCUMENTS)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpack(b) for b in batch.column("b").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1)], ["n", "v"])

    sums = answered.where("kind = 'word' and b is not null").select("b").mapInArrow(totals, "n long, v long")
    n_words, kinds = (x or 0 for x in sums.agg(F.sum("n"), F.sum("v")).first())
    ends = int(near.loc[(near["step"] & 511) == END, "n"].sum())  # one end for each training document
    n, v = int(n_words) + ends, int(kinds) + (ends > 0)

    def results(part: Documents, answers: list[tuple]) -> pa.Table:
        read = [Reading(s) for s in parts(part)]
        words, steps = _distinct([r.words for r in read]), _distinct([r.steps for r in read])
        counts = gathered("word", answers, by_value(words, buckets), np.int64)
        values = gathered("step", answers, _context_bucket(steps, buckets), float)
        bottom = math.log10(n + 0.5 * (v + 1))
        out = []
        for r in read:
            known = counts[np.searchsorted(words, r.words)][r.word]
            value = values[np.searchsorted(steps, r.steps)][r.step]
            base = np.bincount(r.word_of, np.log10(known + 0.5) - bottom, r.n) + (math.log10(ends + 0.5) - bottom)
            out.append(pa.table({
                "doc_id": pa.array(r.ids, pa.int64()), "held_out": pa.array(~r.train),
                "n_tokens": pa.array(np.bincount(r.word_of, minlength=r.n) + 1, pa.int64()),
                "n_known": pa.array(np.bincount(r.word_of, known > 0, r.n).astype(np.int64) + (ends > 0), pa.int64()),
                "train_tokens": pa.array(np.full(r.n, n), pa.int64()),
                "base_score": pa.array(base), "score": pa.array(np.bincount(r.step_of, value, r.n)),
            }))
        return pa.concat_tables(out).combine_chunks()

    return per_block([blocks, answered], SCHEMA, results)
