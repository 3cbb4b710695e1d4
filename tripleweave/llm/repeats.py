"""Repeated byte strings, by sorting suffixes bucket by bucket with the ranks of a cover sample.

A suffix counts up to LENGTH bytes: two suffixes tie if their first LENGTH bytes are equal, and a
byte is removed if a tied suffix covers it. Sorting every suffix of a corpus is out of reach, so

* a cover sample is ranked first. The sample is content-defined: of each LENGTH-byte string the
  64 bytes with the least hash. Like a difference cover it holds, for any two equal strings of
  LENGTH bytes, a position at the same place in both; unlike residues of the position it needs
  one position in about 69 instead of one in 13;
* suffixes whose sample has a rank of its own have no tie and are never sorted. A run of suffixes
  with the same sample whose whole text has an equal elsewhere is a long tie, settled by the rank
  of that text as a whole;
* what is left (the edges of repeated passages) is sorted, one bucket of suffixes at a time.

Ranks are 64-bit fingerprints of the bytes, compared within a bucket, so buckets can be dealt by
fingerprint: no passage, however common, makes a large bucket.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripleweave.llm.decontamination import _mix, _powers
from tripleweave.llm.exchange import DOCUMENTS, ROW, Documents, answer, ask, buckets_for, by_value, count_seen, gathered, per_block, rows, spread

LENGTH = 200
SAMPLE = 64

_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64))

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Prints:
    """Fingerprints of any stretch of an array of bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] * _powers(len(data), _BASE), out=self.sums[1:])
            self.back = _powers(len(data) + 1, _BACK)

    def of(self, begins: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[ends] - self.sums[begins]) * self.back[begins])


class Cover:
    """The suffixes of a block's documents in runs that share their sample position.

    Run r holds the suffixes ``first[r] .. last[r]``; ``rank`` is the fingerprint of its sample,
    ``whole`` that of all its text and of where the sample lies in it.
    """

    def __init__(self, part: Documents):
        # A gap keeps a string from crossing documents: suffixes that reach it are not valid.
        data, begins, ends = part.joined(1)
        self.begins, self.ends, self.data = begins, ends, data
        n = len(data)
        self.prints = Prints(data)
        self.first = self.last = np.zeros(0, np.int64)
        self.rank = self.whole = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        samples = self.prints.of(slice(0, n - SAMPLE + 1), slice(SAMPLE, n + 1))
        # The least of the top 32 bits, then the leftmost: one number per position.
        least = (samples >> np.uint64(32) << np.uint64(32)) | np.arange(len(samples), dtype=np.uint64)
        width, reach = 1, LENGTH - SAMPLE + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        at = (least & np.uint64((1 << 32) - 1)).astype(np.int64)
        # Valid suffixes: LENGTH bytes within one document.
        long = ends - begins >= LENGTH
        edge = np.zeros(len(at) + 1, np.int8)
        edge[begins[long]] += 1
        edge[ends[long] - LENGTH + 1] -= 1
        valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        edges = np.flatnonzero(new)
        stops = np.append(edges[1:], len(at)) - 1
        own = valid[edges]
        self.first, self.last = edges[own], stops[own]
        sample = at[self.first]
        self.rank = samples[sample]
        with np.errstate(over="ignore"):
            shape = ((sample - self.first) * 512 + (self.last - self.first)).astype(np.uint64)
            self.whole = _mix(self.prints.of(self.first, self.last + LENGTH) + shape * np.uint64(_BASE))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the first place of each, for each key its number, and how often (2: or more)."""
    every, first, where, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return every, first, where, np.minimum(n, 2).astype(np.uint8)


def _ties(cover: Cover, answers: list[tuple], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that repeat as a whole, and runs whose suffixes must be sorted.

    A run that repeats as a whole is sorted too where it is the first of its equals: its suffixes
    may tie with those of other runs.
    """
    ranks, _, rank_of, n = distinct(cover.rank)
    shared = (gathered("rank", answers, by_value(ranks, buckets), np.uint8) > 0)[rank_of]
    wholes, first, whole_of, n = distinct(cover.whole)
    found = gathered("whole", answers, by_value(wholes, buckets), np.uint8)
    repeated = (found > 0)[whole_of]
    witness = np.zeros(len(repeated), bool)
    witness[first[found == 2]] = True
    return repeated, shared & (~repeated | witness)


def _suffixes(cover: Cover, runs: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of the given runs, in order."""
    first, n = cover.first[runs], (cover.last - cover.first + 1)[runs]
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row per document.

    Every byte within a string of LENGTH bytes that starts at another place too, in any document,
    is removed; strings are judged on the input and never cross documents. A null text is empty;
    repeated rows are copies of each other and removed as such.
    """
    buckets = buckets_for(docs)

    def sample(part: Documents, block: int) -> list[tuple]:
        cover, out = Cover(part), []
        for kind, keys in (("rank", cover.rank), ("whole", cover.whole)):
            every, _, _, n = distinct(keys)
            out += spread(kind, block, every, n, by_value(every, buckets), buckets)
        return out

    asked = ask(docs, sample, "cover")
    ranked = answer(asked, ["rank", "whole"], count_seen, "ranks")
    blocks = asked.where(asked["kind"] == DOCUMENTS)

    def sort(part: Documents, answers: list[tuple]) -> pa.Table:
        cover = Cover(part)
        _, runs = _ties(cover, answers, buckets)
        at = _suffixes(cover, runs)
        every, _, _, n = distinct(cover.prints.of(at, at + LENGTH))
        block = answers[0][2] if answers else 0
        return pa.Table.from_batches([rows(spread("suffix", block, every, n, by_value(every, buckets), buckets))])

    sorted_ = answer(per_block([blocks, ranked], ROW, sort), ["suffix"], count_seen, "ties")

    def cut(part: Documents, answers: list[tuple]) -> pa.Table:
        cover = Cover(part)
        repeated, runs = _ties(cover, answers, buckets)
        at = _suffixes(cover, runs)
        every, _, where, _ = distinct(cover.prints.of(at, at + LENGTH))
        tied = gathered("suffix", answers, by_value(every, buckets), np.uint8)[where] > 0
        starts = np.concatenate([at[tied], _suffixes(cover, repeated)])
        edge = np.zeros(len(cover.data), np.int32)
        edge[starts] = 1
        before = np.cumsum(edge, dtype=np.int32)
        gone = before > 0  # a byte goes if a tied suffix starts at it or less than LENGTH before
        gone[LENGTH:] = before[LENGTH:] > before[:-LENGTH]
        removed, spans, sums = [], [], []
        for content, begin, end in zip(part.contents, cover.begins.tolist(), cover.ends.tolist(), strict=True):
            mine = gone[begin:end]
            n = int(np.count_nonzero(mine))
            removed.append(n)
            spans.append(int(np.count_nonzero(mine[1:] & ~mine[:-1])) + int(mine[:1].sum()))
            sums.append(hashlib.sha256(cover.data[begin:end][~mine].tobytes() if n else content).hexdigest())
        sizes = [len(c) for c in part.contents]
        return pa.table({
            "doc_id": pa.array(part.ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string()),
        })

    return per_block([blocks, ranked, sorted_], SCHEMA, cut)
