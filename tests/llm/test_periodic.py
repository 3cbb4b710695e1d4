"""Periodic runs against a program that looks at every lag of every text."""

import hashlib
import re

import numpy as np
import pytest

from tripleweave.llm import periodic, queries
from tripleweave.llm.ship import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All runs by start, then period."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - begin + q
            run = words[begin : begin + length]
            smaller = any(run[p:] == run[:-p] for p in range(1, q)) if length >= max(6, 4 * q) else True
            if not smaller:
                found.append((begin, length, q))
            i += i == begin
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc, text):
    words = WORD.findall(text or "")
    order = queries.planted_order(doc, len(words)) if words else None
    if order is not None:
        words = [words[i] for i in order]
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    out = []
    for doc in range(300):
        kinds, words = int(rng.integers(1, 5)), []
        while len(words) < rng.integers(5, 150):
            piece = [f"w{x}" for x in rng.integers(0, kinds, int(rng.integers(1, 16)))]
            words += piece * int(rng.integers(1, 7))
            words += [f"x{x}" for x in rng.integers(0, 9, int(rng.integers(0, 4)))]
        out.append((doc, rng.choice([" ", "\t", " \n"]).join(words)))
    repeated = " ".join(f"r{i}" for i in range(40))
    out += [(500, " ".join([repeated] * 5)), (501, "a " * 3000), (501, "a " * 3000), (502, None), (503, ""), (504, " \x0b\n "), (None, "é é é é é é é")]
    return out


def test_runs_as_every_lag_tells(spark, texts, tmp_path):
    # Clashing and extra columns, and ids that repeat.
    path = str(tmp_path)
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], "doc_id long, text string, length int, runs string")
    frame.write.parquet(f"{path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, path).collect()]
    key = repr
    assert sorted(got, key=key) == sorted((plain(*t) for t in texts), key=key)
    assert sum(r[1] for r in got) > 300


def test_periods_beyond_any_class_of_small_lags(spark):
    ship(spark)
    words = [f"w{i}" for i in range(1000)]
    text = " ".join(["before", *words * 4, *words[:7], "after"])
    rows = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows[0].runs] == [(1, 4007, 1000)]
    assert rows[0].collapsed == " ".join(["before", *words, "after"])


def test_a_very_long_text_and_an_empty_table(spark):
    ship(spark)
    text = " ".join(f"u{i}" for i in range(1_500_000)) + " tail" * 1_500_000
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic.periodic_runs(frame).first()
    assert (row.n_words, row.start, row.length, row.period) == (3_000_000, 1_500_000, 1_500_000, 1)
    assert periodic.periodic_runs(frame.limit(0)).count() == 0


def test_strongest_is_exact():
    # 4 + 1/3 against 4 + 1/3 in other terms, and a larger one that floats can't tell apart.
    assert periodic.strongest([[5, 13, 3], [0, 26, 6]]) == [5, 13, 3]
    big = 1 << 60
    assert periodic.strongest([[0, 4 * big + 1, big], [1, 4 * big + 2, big]]) == [1, 4 * big + 2, big]
