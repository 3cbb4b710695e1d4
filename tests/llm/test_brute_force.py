"""Scores, leaks, mixtures, shards and the pipeline against plain programs over all rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from test_nearcopies import kept_by_all_pairs
from tripleweave.llm import decontamination, exchange, mixing, ppm, quality, sharding
from tripleweave.llm.ship import ship

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choice(words, n))
    out = [(i, pick(int(rng.integers(25, 60)))) for i in range(40)]
    out += [(50, out[3][1]), (50, out[3][1]), (51, None), (52, ""), (53, "ÉTÉ Abc  漢字\n"), (54, "aaaa " * 60), (None, pick(30))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship(spark)
    return spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, copies int")


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def unigram(texts):
    """Counts of words and ends in training documents, and the base score of each text."""
    tokens = [[*WORD.findall(lower(t)), None] for _, t in texts]
    counts = Counter(x for (i, _), ts in zip(texts, tokens, strict=True) if ppm.remainder(i) != 1 for x in ts)
    n, v = counts.total(), len(counts)
    for ts in tokens:
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        yield len(ts), sum(counts[x] > 0 for x in ts), n, base


def partial_matching(texts):
    """Method C with exclusion, one symbol at a time over a dictionary of contexts."""
    trie = defaultdict(Counter)
    symbols = lambda t: [(b"\0" * ppm.ORDER + b, i) for b in [lower(t)] for i in range(len(b) + 1)]
    at = lambda b, i, k: (b[i + ppm.ORDER - k : i + ppm.ORDER], b[i + ppm.ORDER] if i + ppm.ORDER < len(b) else ppm.END)
    for i, t in texts:
        if ppm.remainder(i) != 1:
            for b, place in symbols(t):
                for k in range(ppm.ORDER + 1):
                    context, symbol = at(b, place, k)
                    trie[context][symbol] += 1
    for _, t in texts:
        score = 0.0
        for b, place in symbols(t):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                context, symbol = at(b, place, k)
                left = {s: n for s, n in trie[context].items() if s not in excluded} if context in trie else {}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    score += math.log10(left[symbol] / whole)
                    break
                score += math.log10(len(left) / whole)
                excluded |= set(left)
            else:
                score -= math.log10(ppm.SYMBOLS - len(excluded))
        yield score


@pytest.mark.parametrize("part", [ppm.PART, 300])
def test_scores(docs, texts, monkeypatch, part):
    monkeypatch.setattr(ppm, "PART", part)
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    want = sorted(
        ((i, ppm.remainder(i) == 1, *u, s) for (i, _), u, s in zip(texts, unigram(texts), partial_matching(texts), strict=True)), key=key
    )
    got = sorted((tuple(r) for r in ppm.score(docs).collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_merged_counts(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ppm, "PIECE", 50)
    parts = [(np.unique(rng.integers(0, 200, 40)).astype(np.uint64),) for _ in range(12)]
    parts = [(k, rng.integers(0, 5, len(k))) for (k,) in parts]
    want = Counter()
    for k, n in parts:
        want.update({int(x): 0 for x in k})
        want.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    keys, total = ppm._merged(iter(parts))
    assert dict(zip(keys.tolist(), total.tolist(), strict=True)) == want
    assert [len(x) for x in ppm._merged(iter([]))] == [0, 0]


def test_packed_numbers():
    for values in (np.arange(5), np.zeros(0, np.uint8), np.array([1, 2**63], np.uint64), np.array([0.5, -1e300])):
        back = exchange.unpack(exchange.pack(values))
        assert back.dtype == values.dtype and back.tolist() == values.tolist()


def leaking(text, items):
    """Items some window of which, of their own number of words, is as similar as asked for."""
    words, found = decontamination.plain(text or "").split(), set()
    for item, content in items:
        own = decontamination.plain(content or "").split()
        weights = decontamination.shingles(own)
        for i in range(max(1, len(words) - len(own) + 1) if own else 0):
            if decontamination.similarity(decontamination.shingles(words[i : i + len(own)]), weights) >= decontamination.SIMILARITY:
                found.add(item)
    return found


def leaky(texts):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"item{i}x{j}" for j in range(40))) for i in range(6)] + [(7, "One, short item here"), (8, None), (9, "")]
    out = list(texts)
    for i in range(6):
        words = items[i][1].split()
        near = list(words)
        near[int(rng.integers(1, 39))] = "other"  # an inner word changes five shingles of 36
        out.append((100 + i, f"before {' '.join(words).upper()} after"))
        out.append((110 + i, f"{' '.join(near[:20])}; {' '.join(near[20:])}"))
        out.append((120 + i, " ".join(words[:20])))
    out.append((130, "it is: one short ITEM here, indeed"))
    return out, items


def test_leaks(spark, texts):
    ship(spark)
    all_, items = leaky(texts)
    docs = spark.createDataFrame(all_, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got == {(i, item) for i, t in all_ for item in leaking(t, items)}
    assert {i for i, _ in got} >= {100, 105, 130} and not {i for i, _ in got} & {120, 125}


def test_mixture_meets_its_targets(spark):
    ship(spark)
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(400):
        kind = ("clean", "poor", "toxic")[i % 3]
        rows.append((i, " ".join([*rng.choice([f"{kind}{j}" for j in range(6)], 8), *rng.choice(["a", "b", "c"], 8)])))
        if i % 2:
            labels.append((i, int(kind == "clean"), int(kind == "toxic")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights = {"clean": 0.6, "poor": 0.3, "toxic": 0.1}
    got = mixing.mix(docs, frame, weights).collect()
    expected = {d: sum(r.n_tokens * r[f"p_{d}"] * r.rate for r in got) for d in weights}
    whole = sum(r.n_tokens for r in got)
    for d, w in weights.items():
        assert expected[d] == pytest.approx(w * whole, rel=0.01)
    # Rows beyond the labelled ones are told apart as well.
    unseen = [r for r in got if r.doc_id % 2 == 0]
    right = sum(max(weights, key=lambda d: r[f"p_{d}"]) == ("clean", "poor", "toxic")[r.doc_id % 3] for r in unseen)
    assert right > 0.95 * len(unseen)
    left = mixing.mixed(docs, frame, {"clean": 1.0, "poor": 1.0, "toxic": 0.0})
    kinds = Counter(r.doc_id % 3 for r in left.collect())
    assert kinds[2] == 0 and kinds[0] + kinds[1] > 0.95 * 267


def test_shards_by_size(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(900)] + [(1000 + i, "the same") for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    texts = dict(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        assert r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.grown_shard is None
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(7)) and max(loads.values()) < 1.02 * min(loads.values())


def test_pipeline(spark, tmp_path, texts):
    """Each stage on what its predecessor kept, by plain programs; the mixture by the rates it reports."""
    ship(spark)
    all_, items = leaky([(i, t) for i, t in texts if i is not None])
    all_ += [(200, "damned slur " * 3 + " ".join(f"bad{j}" for j in range(30)))]
    # Copies at a similarity of about 0.9, which share few fingerprint bits, and at 0.6.
    rng = np.random.default_rng(8)
    for first, edits in ((310, 2), (320, 12)):
        words = [f"near{x}" for x in rng.integers(0, 5000, 200)]
        near = list(words)
        for p in range(edits):
            near[p * 200 // edits + 3] = "changed"
        all_ += [(first, " ".join(words)), (first + 1, " ".join(near))]
    folder = str(tmp_path)
    before = spark.conf.get(corpus_pipeline.BATCH[0], None)
    source = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in all_], "doc_id long, text string, lang string, source string, n_chars long")
    source.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")

    passed = {r.doc_id for r in quality.ledger(source).collect() if r.failed == 0}
    left = sorted({(i, t) for i, t in all_ if i in passed})
    alone = kept_by_all_pairs(left)
    assert {310, 311} & alone == {310} and {320, 321} <= alone
    left = [(i, t) for i, t in left if i in alone]
    left = [(i, t) for i, t in left if not leaking(t, items)]
    mixed = mixing.mix(spark.createDataFrame(left, "doc_id long, text string"), labels, corpus_pipeline.WEIGHTS, as_found=True)
    copies = {r.doc_id: r.kept for r in mixed.collect()}
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), 0, []
    for i, t in [x for x in left for _ in range(copies[x[0]])]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want and 20 < len(want) < len(all_)
    assert spark.conf.get(corpus_pipeline.BATCH[0], None) == before


def plain_mixture(rows, labels, weights, as_found):
    """Posteriors and rates one document at a time."""
    tokens = {i: regex.findall(r"\p{L}+|[^\p{L}\s]+", (t or "").lower()) for i, t in rows}
    known = {}
    for i, q, t in labels:
        if i in tokens:
            known[i] = min(known.get(i, (q, t)), (q, t))
    domain = {i: "toxic" if t == 1 else "clean" if q == 1 else "poor" for i, (q, t) in known.items()}
    n = Counter(domain.values())
    total = len(domain)
    seen = defaultdict(Counter)
    for i, d in domain.items():
        for x in set(tokens[i]):
            seen[x][d] += 1
    model = {}
    for x, by in seen.items():
        all_, gain = by.total(), 0.0
        for d in mixing.DOMAINS:
            if n[d]:
                for observed, expected in ((by[d], all_ * n[d] / total), (n[d] - by[d], (total - all_) * n[d] / total)):
                    gain += observed * math.log(observed / expected) if observed else 0.0
        if all_ >= mixing.SUPPORT and gain >= mixing.GAIN:
            model[x] = [(by[d] + 0.5) / (n[d] + 1) for d in mixing.DOMAINS]
    p, size = {}, {}
    for i, ts in tokens.items():
        size[i] = len(ts)
        score = [math.log((n[d] + 1) / (total + 3)) for d in mixing.DOMAINS]
        for x, share in model.items():
            for k in range(3):
                score[k] += math.log(share[k] if x in ts else 1 - share[k])
        top = [math.exp(v - max(score)) for v in score]
        p[i] = [v / sum(top) for v in top]
    natural = [sum(size[i] * p[i][k] for i in p) for k in range(3)]
    targets = [weights[d] * (natural[k] if as_found else sum(natural) / sum(weights.values())) for k, d in enumerate(mixing.DOMAINS)]
    now, ahead, pace, last = dict.fromkeys(p, 1.0), dict.fromkeys(p, 1.0), 1.0, [math.inf] * 3
    while True:
        miss = [(sum(size[i] * p[i][k] * ahead[i] for i in p) - targets[k]) / max(natural[k], 1.0) for k in range(3)]
        if max(map(abs, miss)) < 1e-3 or max(abs(a - b) for a, b in zip(miss, last, strict=True)) < 1e-4:
            return p, now, miss
        last, later = miss, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        for i in p:
            moved = max(0.0, ahead[i] - sum(a * b for a, b in zip(p[i], miss, strict=True)))
            ahead[i], now[i] = moved + (pace - 1) / later * (moved - now[i]), moved
        pace = later


@pytest.mark.parametrize("as_found", [False, True])
def test_posteriors_and_rates(spark, as_found):
    ship(spark)
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(150):
        kind = ("clean", "poor", "toxic")[i % 3]
        own = rng.choice([f"{kind}{chr(97 + j)}" for j in range(8)], int(rng.integers(0, 9)))
        rows.append((i, " ".join([*own, *rng.choice(["a", "b!", "clean", "7"], 6)])))
        if i % 2:
            labels.append((i, int(kind == "clean"), int(kind == "toxic")))
    rows += [(200, None), (201, ""), (202, rows[0][1]), (203, "É ß 漢字 ... 1a2b")]
    labels += [(1, 0, 0), (900, 1, 1)]
    weights = {"clean": 0.7, "poor": 0.5, "toxic": 0.1}
    p, now, miss = plain_mixture(rows, labels, weights, as_found)
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, rate double, _n string")
    frame = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in mixing.mix(docs, frame, weights, as_found).collect()}
    assert got.keys() == p.keys()
    for i, r in got.items():
        assert [r.p_clean, r.p_poor, r.p_toxic] == pytest.approx(p[i], abs=1e-9) and r.rate == pytest.approx(now[i], abs=1e-6)
        assert r.kept == math.floor(r.rate + 0.5) and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    fitted = mixing.rates(docs.select("doc_id", "text"), frame, weights, F.col("doc_id"), as_found)
    assert fitted.converged and list(fitted.misses.values()) == pytest.approx(miss, abs=1e-9)
    assert mixing.mix(docs.limit(0), frame, weights).count() == 0


def test_a_descent_that_does_not_settle_is_reported(spark):
    rows = spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0]), (2, 10, [0.4, 0.3, 0.3])], "_id long, _n long, _p array<double>")
    with pytest.warns(UserWarning, match="not settled"):
        fitted = mixing.fit(rows, {"clean": 100.0, "poor": 0.5, "toxic": 0.2}, most=3)
    assert fitted.steps == 3 and not fitted.converged


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i])
def test_shards_stay_level_with_ids_that_tell_nothing(spark, ids):
    ship(spark)
    rows = [(i, f"text {i} " + "y" * (i % 50)) for i in range(2000)] + [(ids(5000 + i), "one text for all of these rows") for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    loads, slots = Counter(), defaultdict(list)
    for r in got:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert max(loads.values()) < 1.02 * min(loads.values()) and len(loads) == 10
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 4000


def test_other_items_change_nothing(spark, monkeypatch):
    ship(spark)
    words = [f"i{j}" for j in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[:34]) + " c d"), (2, " ".join(words))], "doc_id long, text string")
    item, other = (1, " ".join(words)), (2, " ".join([*words[10:16], *[f"o{j}" for j in range(28)]]))
    find = lambda items: {tuple(r) for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    alone = find([item])
    assert {r[0] for r in alone} == {i for i, t in docs.collect() if leaking(t, [item])}
    assert {r for r in find([item, other]) if r[1] == 1} == alone
    monkeypatch.setattr(decontamination, "ITEMS", 1)
    assert {r for r in find([item, other]) if r[1] == 1} == alone
