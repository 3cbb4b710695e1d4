"""Collocations against counts of every phrase, and their SQL on awkward rows."""

from collections import Counter

import duckdb
import pytest

from tripleweave.llm import phrases
from tripleweave.llm.ship import ship

LEAST = 3


def plain(texts, least=LEAST, longest=4, most=2000):
    import re

    counts, totals = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {p: n for p, n in counts.items() if n >= least}
    held = Counter()
    for (lang, words), n in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                held[lang, words[i : i + k]] = max(held[lang, words[i : i + k]], n)
    out = []
    for lang in totals:
        rows = []
        for (other, words), a in often.items():
            if other != lang or len(words) < 2 or 100 * held[lang, words] >= 80 * a:
                continue
            cuts = [(2000000 * a // (often[lang, words[:k]] + often[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(words).encode(), often[lang, words[:k]], often[lang, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def texts():
    base = [
        ("en", "The cat sat on the mat. The cat sat on the rug; the CAT sat"),
        ("en", "a a a a a a, a a a"),
        ("en", "no\x0bpiece\x0ccrosses\rlines\nno piece crosses lines"),
        ("de", "die katze saß auf der matte, die katze saß"),
        (None, "x y z x y z x y z x y z"),
        ("", "x y z x y z x y z x y z"),
        ("l\ng", "x y x y x y x y"),
        ("fr", None),
        ("fr", ""),
        ("fr", " \t ..;; "),
        ("es", "é é é é é é é é é é \x00 \x00 \x00 \x00"),
    ]
    return base * 3


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_collocations_as_plain_counts(spark, texts):
    ship(spark)
    frame = spark.createDataFrame([(*t, 1, "q") for t in texts], "lang string, text string, n int, phrase string")
    for most in (2000, 2):
        assert rows_of(phrases.collocations(frame, least=LEAST, most=most)) == sorted(plain(texts, most=most))
    assert rows_of(phrases.collocations(frame, longest=2, least=LEAST)) == sorted(plain(texts, longest=2))
    assert rows_of(phrases.collocations(frame.limit(0), least=LEAST)) == []


def test_blocks_and_long_texts_change_nothing(spark, texts, monkeypatch):
    ship(spark)
    more = [*texts, ("en", "long texts are cut. between pieces only, " * 400)]
    frame = spark.createDataFrame(more, "lang string, text string")
    monkeypatch.setattr(phrases, "BLOCK", 200)
    monkeypatch.setattr(phrases, "PER_BUCKET", 100)
    assert rows_of(phrases.collocations(frame, least=LEAST)) == sorted(plain(more))


def test_a_long_text_is_cut_between_pieces():
    import pyarrow as pa

    text = "one two. " * 1000
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    parts = [b.column("text")[0].as_buffer().to_pybytes() for b in phrases._cut_long(iter([batch]), 100)]
    assert len(parts) > 50 and b"".join(parts).decode() == text
    assert all(p.endswith(b".") for p in parts[:-1])


def test_sql_agrees_on_awkward_rows(spark, texts):
    ship(spark)
    many = texts * 4
    frame = spark.createDataFrame(many, "lang string, text string")
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", many)
    expected = sorted(con.execute(phrases.SQL).fetchall())
    assert rows_of(phrases.collocations(frame)) == expected == sorted(plain(many, least=30))


def test_numbers_that_do_not_fit_are_refused():
    import numpy as np

    with pytest.raises(OverflowError):
        phrases._numbers(np.ones(3, bool), 0, 1 << 31)
