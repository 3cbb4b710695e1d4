"""Bounds on what one task holds, and tokenizers that an encoder was not made for."""

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tripleweave.llm import exchange, ppm, repeats, tokencounts, tokenfiles

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def changed(path, tmp_path, **parts):
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    for key, value in parts.items():
        spec[key] = value(spec[key])
    out = tmp_path / "tokenizer.json"
    out.write_text(json.dumps(spec), encoding="utf-8")
    return str(out)


@pytest.fixture(scope="module")
def passages(spark):
    """Texts that share passages, copies of one text and of one id, null and empty texts."""
    chance = np.random.default_rng(5)
    words = [f"w{n}" for n in chance.integers(0, 400, 4000)]
    shared = " ".join(words[:60])
    rows = [(i, " ".join(words[20 * i : 20 * i + 50]) + (shared if i % 3 == 0 else "")) for i in range(60)]
    rows += [(7, shared)] * 3 + [(None, shared), (None, None), (100, ""), (101, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("operator", [repeats.remove_repeats, ppm.score])
def test_more_buckets_change_nothing(spark, passages, monkeypatch, operator):
    def rounded():
        found = (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in operator(passages).collect())
        return sorted(found, key=repr)

    before = rounded()
    monkeypatch.setattr(exchange, "PER_BUCKET", 300)
    size = sum(len(r.text or "") for r in passages.collect())
    assert exchange.buckets_for(passages) == -(-size // 300) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rounded() == before


def test_buckets_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exchange.buckets_for(empty) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7])
@pytest.mark.parametrize("text", [lambda i: "one text", lambda i: f"{'same start ' * 8}{i}"])
def test_equal_ids_spread_over_files(spark, ids, text):
    rows = [(ids(i), text(i)) for i in range(2000)] + [(9, "last"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = tokenfiles.write_sequences(docs, WORDS, 2, length=16)
    files = [r["count"] for r in index.groupBy("file").count().collect()]
    assert sum(files) == 2002 and max(files) < 1000
    tokenizer = Tokenizer.from_file(WORDS)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    got = sorted(tokenfiles.read_documents(index).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc(t)) for i, t in rows)
    assert [r.doc_id or 0 for r in got] == sorted(i or 0 for i, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_ids_point_into_the_mapped_file(tmp_path):
    ids = np.arange(1000, dtype="<u2")
    with pa.OSFile(str(tmp_path / "a.arrow"), "wb") as sink:
        writer = tokenfiles.SequenceWriter(sink, ids.dtype, 16)
        writer.add(ids.tobytes())
        writer.close()
    source = tokenfiles.open_file(f"file://{tmp_path}", "a.arrow")
    reader = tokenfiles.SequenceReader(source)
    source.seek(0)
    file = source.read_buffer(source.size())
    found = [next(reader.ids(100, 30)), reader.sequence(5)[0]]
    assert found[0].tolist() == list(range(100, 130)) and found[1].tolist() == list(range(80, 96))
    for a in found:
        assert file.address <= a.__array_interface__["data"][0] < file.address + file.size


def test_words_are_refused_by_tokenizers_that_keep_blanks(tmp_path):
    with pytest.raises(ValueError, match="between blanks"):
        tokenfiles.WordEncoder(BYTES)

    def spanning(step):
        step["pretokenizers"][0]["pattern"] = {"Regex": r"[\p{L}]+ ?[\p{N}]*|[^\s\p{L}]"}
        return step

    with pytest.raises(ValueError, match="between blanks"):
        tokenfiles.WordEncoder(changed(WORDS, tmp_path, pre_tokenizer=spanning))


@pytest.mark.parametrize(
    "parts, names",
    [
        ({"normalizer": lambda _: {"type": "Lowercase"}}, "normalizer"),
        ({"pre_tokenizer": lambda step: step | {"add_prefix_space": True}}, "pre_tokenizer"),
        ({"model": lambda model: model | {"ignore_merges": True}}, "ignore_merges"),
    ],
)
def test_prefix_tables_are_refused_by_other_tokenizers(tmp_path, parts, names):
    with pytest.raises(ValueError, match=names):
        tokencounts.PrefixCounter(changed(BYTES, tmp_path, **parts))
    with pytest.raises(ValueError, match="pre_tokenizer, normalizer"):
        tokencounts.PrefixCounter(WORDS)


def test_truncation_set_in_the_file_is_left_out(tmp_path):
    cut = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = changed(WORDS, tmp_path, truncation=lambda _: cut)
    encode = tokenfiles.WordEncoder(path)
    text = "a text of some more words than three"
    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encode.encode([text.encode()])[0], encode.dtype).tolist() == want
