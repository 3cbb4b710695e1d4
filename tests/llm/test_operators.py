"""The corpus operators against brute force on small tables with nulls, empty and repeated rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tripleweave.llm import decontamination, mixing, ppm, quality, repeats, sharding, simhash, tokencounts, tokenfiles, urlrules
from tripleweave.llm.ship import ship

SCHEMA = "doc_id long, text string, n_words string, block int"
PASSAGE = " ".join(f"passage{i} word" for i in range(30))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(80) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20, base[0]), (21, base[0]), (21, base[0]), (22, base[1] + " extra"), (23, f"{text(40)} {PASSAGE} {text(40)}")]
    out += [(24, f"{text(10)}\n{PASSAGE}\n{text(5)}"), (25, ""), (26, None), (27, " \t\n"), (28, "Été 漢字 <|endoftext|> it's  two"), (29, "a " * 300)]
    return [(i, t, "clash", 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def test_repeated_bytes(docs, empty, rows):
    seen = Counter(b[i : i + 200] for _, t, *_ in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    want = []
    for doc, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, repeats.remove_repeats(docs).collect())) == sorted(want)
    assert repeats.remove_repeats(empty).count() == 0


def test_url_rules(spark):
    ship(spark)
    urls = ["http://a.example.net/en/x", "https://example.net/de/", "http://NET/", "http://x.org/fr/1?q", "http://org?x", "no url", None, "http://example.com/de/a#b", "http://notnet.de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("net/", "block"), ("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "block")], "rule string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2] == ("net", "/", "net/", "block")
    assert got[3][2:] == ("org/fr/", "block") and got[4] == ("org", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[8][2] is None
    assert urlrules.judge(pages.limit(0), rules).count() == 0


def test_quality_ledger(docs, empty, rows):
    got = quality.ledger(docs)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[26].n_words == 0 and by_id[26].failed & 1 and by_id[29].n_repeat_words == 300
    assert by_id[0].failed == 0
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({25, 26, 27, 29})
    report = {r["rule"]: r for r in quality.ablations(got, quality.BASE).collect()}
    assert report["few_words"].rejected == sum(r.failed & 1 for r in got.collect())
    assert quality.kept(empty).count() == 0


def test_leaks(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (3, "unheard of text with seven words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == {(23, 1), (24, 1)}
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert decontamination.leaks(empty, items).count() == decontamination.leaks(docs, items.limit(0)).count() == 0


def test_shards(docs, empty, rows):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty, 3).count() == 0


def test_token_files(docs, empty, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for doc, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    index = tokenfiles.write_sequences(docs, path, 2, length=16)
    assert sorted(map(tuple, tokenfiles.read_documents(index).collect())) == sorted(want)
    assert tokenfiles.read_documents(tokenfiles.write_sequences(empty, path, 2)).count() == 0


def test_token_counts(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    got = sorted((r.doc_id, r.n_tokens) for r in tokencounts.token_counts(docs, path, 512).collect())
    assert got == sorted((d, size(t or "")) for d, t, *_ in rows)
    table = tokencounts.counter(path)
    for t in ["they're  two\n\nlines ", "Été 漢字 x", "a   b", "it's we'll"]:
        assert table.prefix_counts(t) == [size(t[:i]) for i in range(len(t) + 1)]


def test_scores(docs, empty):
    got = ppm.score(docs).collect()
    assert len(got) == docs.count() and all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert ppm.score(empty).count() == 0


def test_simhash(docs, empty, rows):
    prints = {}
    for doc, t, *_ in rows:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
    group = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= 2:
                    group[a] = min(group[a], group[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{p:016x}", group[d]) for d, p in prints.items()}
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(group.values())
    assert simhash.near_duplicates(empty).count() == simhash.representatives(empty).count() == 0


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    weights = {"clean": 0.7, "poor": 0.2, "toxic": 0.1}
    got = mixing.mix(docs, labels, weights).collect()
    assert len(got) == docs.count() and all(r.rate >= 0 for r in got)
    assert mixing.mix(empty, labels, weights).count() == 0
    assert mixing.mixed(docs, labels, {"clean": 1.0, "poor": 1.0, "toxic": 1.0}).columns == docs.columns


def test_word_encoder(monkeypatch):
    """Ids equal the library's for words that hold the mark or special strings, and after words were forgotten."""
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = tokenfiles.WordEncoder(path)
    chance = random.Random(3)
    texts = ["a\x01b \x01 c", "", " \t ", "\x01", "x y é ΣΣ é", "\x01\x01 hello", "<|endoftext|> foo<|startoftext|>bar", "a b"]
    texts += [" ".join("".join(chance.choices("abcXYZ.,'ß9", k=chance.randint(1, 4))) for _ in range(200)) for _ in range(40)]
    monkeypatch.setattr(tokenfiles, "CACHED", 300)
    monkeypatch.setattr(tokenfiles, "JOINED", 7)
    for begin in range(0, len(texts), 4):
        part = texts[begin : begin + 4]
        want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, encode.dtype).tobytes() for t in part]
        assert encode.encode([t.encode() for t in part]) == want
    assert len(encode.numbers) < 300 + 800
