"""Phrase mining by sorted occurrence relations, one phrase length after the other.

The occurrence relation of length k holds a row (piece, position, phrase) per occurrence. It is
kept sorted by piece and position, packed by block of some MB of text, in a written table. Each
round

* merge-joins the relation with itself on the piece and the adjacent position: two neighbouring
  phrases of length k that are both frequent make an occurrence of length k + 1;
* counts groups: a block sends each distinct phrase with its count to the phrase's bucket, the
  bucket adds the counts of all blocks and numbers the frequent phrases;
* semi-joins: the block keeps the occurrences whose phrase has a number.

Nothing is hashed away: a word is told from others by its bytes, a longer phrase by the numbers of
its first and last k words, so counts are exact. A word that a third of all texts hold costs an
entry per block. Pieces never cross blocks, so long texts are cut between pieces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tripleweave.llm.exchange import NAMES, ROW, answer, pack, rows, unpack
from tripleweave.llm.tables import portions, shuffle_tasks, written
from tripleweave.llm.words import Words

BLOCK = 4 << 20
PER_BUCKET = 32 << 20

# Fixed values of the text model: what ends a piece, and what separates the words of a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
UNKNOWN = "und"

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in PIECE_ENDS]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CUT = re.compile(b"[" + re.escape(PIECE_ENDS).encode() + b"]")

FOUND = "id long, lang string, word string, first long, last long, f long, n long"
TOP_BITS = 32


def _langs_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def _cut_long(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches in which a text longer than ``size`` is cut behind ends of pieces."""
    for batch in portions(batches, size):
        if batch.num_rows > 1 or len(batch.column("text")[0].as_buffer()) <= size:
            yield batch
            continue
        data, begin = batch.column("text")[0].as_buffer().to_pybytes(), 0
        while begin < len(data):
            behind = _CUT.search(data, begin + size)
            end = behind.end() if behind else len(data)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([data[begin:end]])], ["lang", "text"])
            begin = end


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where a phrase is counted, from the numbers of its two parts."""
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _by_bucket(place: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The new number of each key, counted bucket by bucket, and the keys of each bucket."""
    order = np.argsort(place, kind="stable")
    number = np.empty(len(place), np.int64)
    number[order] = np.arange(len(place))
    cuts = np.searchsorted(place[order], np.arange(buckets + 1))
    return number, [(b, order[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]


def _relation(length: int, block: int, slots: np.ndarray, local: np.ndarray) -> tuple:
    return f"rows{length}", 0, block, pack(np.diff(slots, prepend=0).astype(np.uint32)), pack(local.astype(np.uint32))


def _occurrences(batch: pa.RecordBatch, buckets: int) -> list[tuple]:
    """The relation of words of a block, and its distinct words with counts by bucket."""
    words = Words(batch.column("text"), _BETWEEN, _LOWER)
    # One number per piece and position: neighbours differ by one, words of different pieces never.
    ends = _ENDS[words.data]
    ends[words.offsets[1:][words.offsets[1:] > 0] - 1] = True
    pieces = np.append(0, np.cumsum(ends))[words.begin] if len(words) else np.zeros(0, np.int64)
    text = words.text_of()
    slots = np.arange(len(words)) + pieces
    langs = batch.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy().astype(np.int64)[text]
    coded = words.arrow().dictionary_encode()
    every, local, counts = np.unique(coded.indices.to_numpy() * len(langs.dictionary) + lang, return_inverse=True, return_counts=True)
    names = langs.dictionary.to_pylist()
    spelled = coded.dictionary.to_pylist()
    keys = [names[i % len(names)].encode() + b"\n" + spelled[i // len(names)] for i in every.tolist()]
    place = np.array([zlib.crc32(k) % buckets for k in keys], np.int64)
    number, each = _by_bucket(place, buckets)
    block = zlib.crc32(b"".join(keys[:50])) << 31 | int(np.random.default_rng().integers(1 << 31))
    out = [_relation(1, block, slots, number[local])]
    for b, mine in each:
        own = [keys[i] for i in mine.tolist()]
        sizes = np.array([len(k) for k in own], np.int64)
        out.append(("asked1", b, block, pack(np.concatenate([counts[mine], sizes])), zlib.compress(b"".join(own), 1)))
    return out


def _numbers(frequent: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """A number from 1 for each frequent phrase, unlike those of other buckets; 0 for the others."""
    number = np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket + 1, 0)
    if len(number) and number.max() >> TOP_BITS:
        raise OverflowError("more than four billion frequent phrases of one length")
    return number


def _count_words(asked: list[tuple], least: int, buckets: int) -> list[tuple]:
    """Answers to the blocks, and the frequent words of a bucket with the counts of all words by language."""
    parts, counts, cuts = [], [], [0]
    for row in asked:
        both = unpack(row[3])
        n = len(both) // 2
        offsets = np.append(0, np.cumsum(both[n:]))
        held = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(zlib.decompress(row[4]))]
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, held))
        counts.append(both[:n])
        cuts.append(cuts[-1] + n)
    coded = pa.concat_arrays(parts).dictionary_encode()
    where = coded.indices.to_numpy()
    total = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    number = _numbers(total >= least, asked[0][1], buckets)
    answers = [("number1", r[1], r[2], pack(number[where[a:b]].astype(np.uint32)), None) for r, a, b in zip(asked, cuts, cuts[1:], strict=False)]
    spelled = coded.dictionary.to_pylist()
    sums: dict[bytes, int] = {}
    for key, n in zip(spelled, total.tolist(), strict=True):
        lang = key.rpartition(b"\n")[0]
        sums[lang] = sums.get(lang, 0) + n
    some = np.flatnonzero(number)
    own = [spelled[i] for i in some.tolist()] + list(sums)
    sizes = np.array([len(k) for k in own], np.int64)
    figures = np.concatenate([[len(some)], number[some], total[some], list(sums.values()), sizes]).astype(np.int64)
    return [*answers, ("found1", asked[0][1], 0, pack(figures), b"".join(own))]


def _count_phrases(length: int, asked: list[tuple], least: int, buckets: int) -> list[tuple]:
    keys = [unpack(r[3]) for r in asked]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, where, np.concatenate([unpack(r[4]) for r in asked]).astype(np.int64))
    number = _numbers(total >= least, asked[0][1], buckets)
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    answers = [
        (f"number{length}", r[1], r[2], pack(number[where[a:b]].astype(np.uint32)), None) for r, a, b in zip(asked, cuts, cuts[1:], strict=False)
    ]
    some = np.flatnonzero(number)
    return [*answers, (f"found{length}", asked[0][1], 0, pack(every[some]), pack(np.concatenate([number[some], total[some]])))]


def _extended(length: int, table: pa.Table, buckets: int, last: bool) -> pa.Table:
    """From a block's relation of ``length`` words and the numbers of its phrases to those one word longer."""
    kinds, places, blocks, first, second = (table.column(c).to_pylist() for c in NAMES)
    own = kinds.index(f"rows{length}")
    slots = np.cumsum(unpack(first[own]).astype(np.int64))
    replies = sorted((places[i], i) for i, k in enumerate(kinds) if k == f"number{length}")
    lookup = np.concatenate([np.zeros(0, np.uint32), *(unpack(first[i]) for _, i in replies)]).astype(np.uint64)
    number = lookup[unpack(second[own])]
    frequent = number > 0
    slots, number = slots[frequent], number[frequent]
    joined = np.flatnonzero(slots[1:] == slots[:-1] + 1)
    keys = number[joined] << np.uint64(TOP_BITS) | number[joined + 1]
    every, local, counts = np.unique(keys, return_inverse=True, return_counts=True)
    renumbered, each = _by_bucket(_bucket(every, buckets), buckets)
    out = [] if last else [_relation(length + 1, blocks[own], slots[joined], renumbered[local])]
    for b, mine in each:
        out.append((f"asked{length + 1}", b, blocks[own], pack(every[mine]), pack(counts[mine].astype(np.uint32))))
    return pa.Table.from_batches([rows(out)])


def _found(table: DataFrame, length: int) -> DataFrame:
    """Frequent phrases as rows: number, numbers of the first and last parts, count; words spelled out, totals by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield _spelled(unpack(a), b) if length == 1 else _parts(unpack(a), unpack(b))

    return table.where(F.col("kind") == f"found{length}").select("a", "b").mapInArrow(run, FOUND)


def _spelled(figures: np.ndarray, data: bytes) -> pa.RecordBatch:
    n = int(figures[0])
    langs = (len(figures) - 1 - 3 * n) // 2
    number, counts, totals, sizes = np.split(figures[1:], [n, 2 * n, 2 * n + langs])
    ends = np.cumsum(sizes).tolist()
    own = [data[e - s : e] for e, s in zip(ends, sizes.tolist(), strict=True)]
    pairs = [k.rpartition(b"\n")[::2] for k in own[:n]]
    none = [None] * langs
    return _batch(
        [*number.tolist(), *none], [*(k.decode() for k, _ in pairs), *(k.decode() for k in own[n:])], [*(w.decode() for _, w in pairs), *none],
        [None] * len(own), [None] * len(own), [*counts.tolist(), *none], [None] * n + totals.tolist(),
    )


def _parts(keys: np.ndarray, figures: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    none = [None] * n
    return _batch(figures[:n], none, none, (keys >> np.uint64(TOP_BITS)).astype(np.int64), (keys & np.uint64((1 << TOP_BITS) - 1)).astype(np.int64), figures[n:], none)


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "lang", "word", "first", "last", "f", "n"]
    )


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30) -> tuple[list[DataFrame], DataFrame]:
    """For each length a table of phrases that occur ``least`` times or more in their language; words by language.

    A phrase has ``id, lang, words array<string>, f, heads array<long>, tails array<long>``, where
    ``heads[i]`` counts its first i + 1 words, ``tails[i]`` its last. The second result is ``lang, n``.
    """
    spark = docs.sparkSession
    texts = _langs_and_texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_tasks(spark), math.ceil(size / PER_BUCKET))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_long(batches, BLOCK):
            yield rows(_occurrences(batch, buckets))

    asked = written(texts.mapInArrow(ask, ROW), "phrases1")
    tables: list[DataFrame] = []
    totals = None
    for length in range(1, longest + 1):
        counted = answer(asked, [f"asked{length}"], _counter(length, least, buckets), f"counts{length}")
        found = _found(counted, length)
        if length == 1:
            totals = found.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
            tables.append(_words(found))
        else:
            tables.append(_longer(found, tables[-1], length))
        if length < longest:
            both = asked.where(F.col("kind") == f"rows{length}").union(counted.where(F.col("kind") == f"number{length}"))
            asked = written(both.groupBy("block").applyInArrow(_extender(length, longest, buckets), ROW), f"phrases{length + 1}")
    return tables, totals


def _counter(length: int, least: int, buckets: int):
    if length == 1:
        return lambda _, asked: _count_words(asked, least, buckets)
    return lambda _, asked: _count_phrases(length, asked, least, buckets)


def _extender(length: int, longest: int, buckets: int):
    return lambda table: _extended(length, table, buckets, length + 1 == longest)


def _words(found: DataFrame) -> DataFrame:
    one = F.array("f")
    own = found.where("n is null").select("id", "lang", F.array("word").alias("words"), "f", one.alias("heads"), one.alias("tails"))
    return written(own, "frequent1")


def _longer(found: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """Spell phrases out by their first and last parts, both one word shorter."""
    head = shorter.select(F.col("id").alias("first"), "lang", F.col("words").alias("_words"), F.col("heads").alias("_heads"))
    tail = shorter.select(F.col("id").alias("last"), F.element_at("words", -1).alias("_word"), F.col("tails").alias("_tails"))
    own = found.select("id", "first", "last", "f").join(head, "first").join(tail, "last")
    more = lambda c, v: F.concat(c, F.array(v))
    return written(
        own.select(
            "id", "lang", more("_words", "_word").alias("words"), "f", more("_heads", "f").alias("heads"), more("_tails", "f").alias("tails"),
            "first", "last",
        ),
        f"frequent{length}",
    )


def _scored(table: DataFrame, length: int) -> DataFrame:
    """The cut with the lowest ``floor(2000000 * a / (l + r))``, of equals the first; exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, length):
        left, right = F.col("heads")[k - 1], F.col("tails")[length - k - 1]
        both = (wide(left) + wide(right)).alias("both")
        product = (wide(F.col("f")) * F.lit(2000000).cast("decimal(7,0)")).alias("product")
        cuts.append(F.struct(product, both, F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    # ``div`` on decimals is exact; there is no Column operator for it.
    scores = F.transform(
        F.array(*cuts),
        lambda c: F.struct(F.call_function("div", c["product"], c["both"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")),
    )
    return table.withColumn("_cut", F.array_min(scores))


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, most: int | None = 2000, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of two words or more, the tightest of each language first.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two parts of its lowest-scoring
    cut do, ``n`` how many words the language has. A phrase inside a longer frequent one that has
    at least ``share`` of its occurrences is left out. ``most`` is the length of the report per
    language, None for all.

    A null language is ``und``, a null text empty; ids play no part and repeated rows count as
    often as they stand there; ties go by count, then by the bytes of the phrase; an empty table
    gives no rows; other columns are ignored. A text longer than a block is cut between pieces;
    only a single piece is never cut.
    """
    tables, totals = frequent_phrases(docs, longest, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    ranked = None
    for i in range(1, longest):
        own = _scored(tables[i], i + 1)
        if i + 1 < longest:
            # The longer phrases that hold this one all hold one that is a word longer; so does the largest count.
            grown = tables[i + 1].select(F.col("first").alias("id"), F.col("f").alias("_more"))
            grown = grown.union(tables[i + 1].select("last", "f")).groupBy("id").agg(F.max("_more").alias("_more"))
            held = F.coalesce(F.lit(share[1]) * wide("_more") >= F.lit(share[0]) * wide("f"), F.lit(False))
            own = own.join(grown, "id", "left").where(~held)
        own = own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")
        ranked = own if ranked is None else ranked.union(own)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if most is not None:
        # First the best of each of many parts of a language, so that no task sorts all of them.
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        ranked = ranked.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= most).drop("_rank")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        ranked = ranked.where(F.col("rank") <= most)
    else:
        ranked = ranked.withColumn("rank", F.lit(None).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
t as (select lang, sum(len(words))::bigint as n from w group by lang),
o as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
k as (select lang, words, i, unnest([1, 2, 3, 4]) as k from o),
f as (select lang, array_to_string(list_slice(words, i, i + k - 1), ' ') as phrase, k, count(*)::bigint as f,
             any_value(list_slice(words, i, i + k - 1)) as words
      from k where i + k - 1 <= len(words) group by lang, phrase, k having count(*) >= 30),
c as (select f.lang, f.phrase, f.k, f.f as a, f.words, unnest(range(1, f.k)) as j from f where f.k > 1),
s as (select c.lang, c.phrase, c.k, c.a, c.j, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f + r.f))::bigint as score
      from c join f l on l.lang = c.lang and l.k = c.j and l.phrase = array_to_string(list_slice(c.words, 1, c.j), ' ')
             join f r on r.lang = c.lang and r.k = c.k - c.j and r.phrase = array_to_string(list_slice(c.words, c.j + 1, c.k), ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
x as (select lang, k, f, words, unnest(range(2, k)) as m from f where k > 2),
y as (select lang, f, m, words, k, unnest(range(1, k - m + 2)) as i from x),
z as (select lang, array_to_string(list_slice(words, i, i + m - 1), ' ') as phrase, max(f) as f from y group by all),
e as (select b.* from b left join z on z.lang = b.lang and z.phrase = b.phrase where z.f is null or 100::hugeint * z.f < 80::hugeint * b.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score from r join t on t.lang = r.lang where r.rank <= 2000"""
