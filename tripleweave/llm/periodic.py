"""Periodic runs of words within a text, by seeds on diagonals that are extended once.

A run is a stretch of words with smallest period q and at least max(SHORTEST, TIMES * q) words
that neither neighbour continues. On the diagonal of lag q (words q apart) it is a stretch of at
least max(SHORTEST, TIMES * q) - q equal pairs, so

* lags are taken in classes ``low .. high`` with ``high`` at most 1.5 times ``low``, and for each
  class the k-grams are indexed whose length every run of the class is sure to cover on its
  diagonal: 5 words for lags 1 and 2, else 3 * low;
* such a k-gram is at least twice as long as any lag of the class, so within a run of period q its
  next occurrence in the text is q words on and never nearer (by two periods of one k-gram, the
  theorem of Fine and Wilf). Pairs of successive occurrences are therefore all the seeds there
  are: one per position, however often a k-gram repeats;
* a seed is extended along its diagonal unless the table of the furthest position covered per lag
  already holds it. A stretch found this way has the lag for its smallest period.

k-grams are named exactly, from the names of two shorter ones that cover them; only positions
whose k-gram repeats in its text go on to the next class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tripleweave.llm.tables import portions, texts
from tripleweave.llm.words import Words

SHORTEST = 6
TIMES = 4

SCHEMA = (
    "doc_id long, n_words long, start long, length long, period long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)

Order = Callable[[int, int], np.ndarray | None]


def classes() -> Iterator[tuple[int, int, int]]:
    """Lags ``low .. high`` and the length of the k-grams that find them."""
    yield 1, 2, 5
    low = 3
    while True:
        yield low, low * 3 // 2, 3 * low
        low = low * 3 // 2 + 1


class Grams:
    """Positions whose k-gram occurs more than once in its text, with names equal for equal k-grams."""

    def __init__(self, word: np.ndarray, text: np.ndarray):
        self.word, self.text, self.k = word, text, 1
        self.at, self.name = np.arange(len(word)), word
        self.pairs = np.zeros((0, 2), np.int64)

    def grow(self, k: int) -> None:
        """Go on to length ``k``, at most twice the present one; ``pairs`` are successive occurrences."""
        names = np.full(len(self.word), -1, np.int64)
        names[self.at] = self.name
        shift = k - self.k
        at = self.at[: np.searchsorted(self.at, len(self.word) - k, side="right")]
        left, right = names[at], names[at + shift]
        whole = (right >= 0) & (self.text[at] == self.text[at + k - 1])
        at, left, right = at[whole], left[whole], right[whole]
        self.k, self.at, self.name, self.pairs = k, at, left, np.zeros((0, 2), np.int64)
        if not len(at):
            return
        key = left * (names.max() + 1) + right
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        same = key[1:] == key[:-1]
        self.pairs = np.stack([at[:-1][same], at[1:][same]], axis=1)
        repeated = np.append(same, False) | np.append(False, same)
        name = np.cumsum(np.append(True, ~same))
        at, name = at[repeated], name[repeated]
        order = np.argsort(at)
        self.at, self.name = at[order], name[order]


def _extent(word: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch of equal pairs ``(x, x + lag)`` around ``at``, looked through in growing steps."""
    low, step = at, 16
    while low > 0:
        begin = max(0, low - step)
        unlike = np.flatnonzero(word[begin:low] != word[begin + lag : low + lag])
        if len(unlike):
            low = begin + int(unlike[-1]) + 1
            break
        low, step = begin, 2 * step
    high, end, step = at, len(word) - lag, 16
    while high < end:
        stop = min(end, high + step)
        unlike = np.flatnonzero(word[high:stop] != word[high + lag : stop + lag])
        if len(unlike):
            high += int(unlike[0])
            break
        high, step = stop, 2 * step
    return low, high


def find_runs(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows ``(start, length, period)`` by start, then period.

    ``word`` holds numbers that differ for different words and for equal words of different texts;
    ``text`` is the text of each word, ascending.
    """
    found: list[tuple[int, int, int]] = []
    grams = Grams(word, text)
    for low, high, k in classes():
        while grams.k < k and len(grams.at):
            grams.grow(min(k, 2 * grams.k))
        if not len(grams.at):
            break
        seeds, lags = grams.pairs[:, 0], grams.pairs[:, 1] - grams.pairs[:, 0]
        mine = (lags >= low) & (lags <= high)
        seeds, lags = seeds[mine], lags[mine]
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        # A seed right after one of its own lag is covered by the extension of that one.
        first = np.ones(len(seeds), bool)
        first[1:] = (seeds[1:] != seeds[:-1] + 1) | (lags[1:] != lags[:-1])
        furthest: dict[int, int] = {}
        for at, lag in zip(seeds[first].tolist(), lags[first].tolist(), strict=True):
            if at < furthest.get(lag, 0):
                continue
            begin, end = _extent(word, at, lag)
            furthest[lag] = end
            if end + lag - begin >= max(SHORTEST, TIMES * lag):
                found.append((begin, end + lag - begin, lag))
    runs = np.array(found, np.int64).reshape(-1, 3)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def strongest(runs: list[list[int]]) -> list[int] | None:
    """The run of the greatest length / period, compared exactly; of equals the first in order."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _portion(batch: pa.RecordBatch, order: Order | None) -> pa.RecordBatch:
    words = Words(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    held = words.arrow()
    counts = np.diff(words.first)
    place = np.arange(len(words))
    if order is not None:
        for doc, begin, n in zip(ids, words.first.tolist(), counts.tolist(), strict=False):
            own = order(doc, n) if n else None
            if own is not None:
                place[begin : begin + n] = begin + own
    text = words.text_of()
    code = held.dictionary_encode().indices.to_numpy().astype(np.int64)[place]
    _, word = np.unique(text * (code.max(initial=0) + 1) + code, return_inverse=True)
    runs = find_runs(word, text)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(edge[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stays)])[words.first]
    kept = pa.LargeListArray.from_arrays(pa.array(ends), held.take(pa.array(place[stays])))
    collapsed = pc.binary_join(kept, pa.scalar(b" ", pa.large_binary()))
    cuts = np.searchsorted(runs[:, 0], words.first)
    relative = runs.copy()
    relative[:, 0] -= words.first[np.searchsorted(words.first, runs[:, 0], side="right") - 1]
    best = [strongest(relative[a:b].tolist()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    part = lambda i: pa.array([b and b[i] for b in best], pa.int64())
    names = ["start", "length", "period"]
    rows = pa.StructArray.from_arrays([pa.array(relative[:, i]) for i in range(3)], names)
    listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts), part(0), part(1), part(2), listed, collapsed.cast(pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", *names, "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """All runs of every text, the strongest one, and the text without what the runs repeat.

    ``start, length, period`` is the run of the greatest length / period, the one that starts
    first of equals; null without a run. ``collapsed`` joins by one space the words that no run
    contains after its first period. ``order(doc_id, n)`` may give the numbers of the words to
    read instead of a text's own n words, or None.

    A row per document: repeated rows give repeated results. Null and empty texts have no words,
    an empty table no rows; a null id stays null (and ``order`` sees None); other columns are
    ignored. A text is searched whole by one task, in some 60 bytes of memory a byte; nothing is
    shuffled, and texts of a portion of 4 MB are searched together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield _portion(batch, order)

    return texts(docs).mapInArrow(run, SCHEMA)
