"""Token ids in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import portions, shuffle_tasks, texts, written
from tripleweave.sources.scratch import new_path

LENGTH = 1024  # ids in a sequence
SEQUENCES = 256  # sequences in a record batch
CACHED = 600_000  # words whose ids a Python worker keeps, and those of one portion more
JOINED = 2_000  # new words in one call of the tokenizer
MARK = "\x01"  # between them; words may hold it too
BLANKS = " \t\n\r\x0b\x0c"  # what words are cut at
HEAD = 64  # characters of a text that order documents of one id

_ENCODERS: dict[str, WordEncoder] = {}


def drops_blanks(step: dict | None) -> bool:
    """Whether a pre-tokenizer, as its file describes it, leaves no blank in any piece."""
    match step:
        case {"type": "Sequence", "pretokenizers": steps}:
            return any(map(drops_blanks, steps))
        case {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {"Regex": pattern}}:
            beside = ("", "a", "1", "'")
            tried = (a + blank + b for blank in BLANKS for a in beside for b in beside)
            return not any(set(BLANKS) & set(found.group()) for t in tried for found in regex.finditer(pattern, t))
        case {"type": "Whitespace" | "WhitespaceSplit" | "BertPreTokenizer"}:
            return True
    return False


class WordEncoder:
    """Ids of words, for tokenizers whose pre-tokenizer drops white space and never joins across it.

    Such a tokenizer gives a text the ids of its words one after the other, so each word is
    encoded by the library once and kept under a number; a full store keeps its more used half.
    New words go to the library many at a time, as one text with a mark between them.
    Any other tokenizer is refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            kept = not drops_blanks(json.load(file)["pre_tokenizer"])
        probe = ["ab", "cd", "'s", "1", ".", "e"]
        if kept or self._ids(f" {probe[0]}  " + "\n\t".join(probe[1:]) + "\r\n") != [i for w in probe for i in self._ids(w)]:
            raise ValueError(f"{path}: its tokens are not those of the words between blanks, one word after the other")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.numbers = _Numbers()
        self.ids = np.zeros(0, self.dtype)  # of all known words, one word after the other
        self.words = np.zeros((3, 0), np.int64)  # of each word: where its ids begin, how many, uses

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and how many each has, from one call; word by word if a word holds the mark."""
        text = [w.decode() for w in words]
        if self.mark is not None:
            ids = np.array(self._ids(f" {MARK} ".join(text)), self.dtype)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words) - 1:
                return ids[ids != self.mark], np.diff(marks, prepend=-1, append=len(ids)) - 1
        each = [np.array(self._ids(t), self.dtype) for t in text]
        return np.concatenate(each), np.array([len(e) for e in each])

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        found = [self._joined(new[begin : begin + JOINED]) for begin in range(0, len(new), JOINED)]
        if found:
            counts = np.concatenate([c for _, c in found])
            begins = len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, *(i for i, _ in found)])
            self.words = np.concatenate([self.words, np.stack([begins, counts, np.zeros_like(counts)])], axis=1)

    def _forget(self) -> None:
        """Keep the more used half of the store, numbered anew; uses count half from then on."""
        stay = np.sort(np.argsort(-self.words[2], kind="stable")[: CACHED // 2])
        names = list(self.numbers)  # in the order of their numbers
        self.numbers = _Numbers((names[n], i) for i, n in enumerate(stay.tolist()))
        begins, counts, uses = self.words[:, stay]
        stops = np.cumsum(counts)
        self.ids = self.ids[np.arange(counts.sum()) + np.repeat(begins - stops + counts, counts)]
        self.words = np.stack([stops - counts, counts, uses // 2])

    def encode(self, documents: list[bytes]) -> list[bytes]:
        if len(self.numbers) > CACHED:
            self._forget()
        number = self.numbers.__getitem__
        words = [np.fromiter(map(number, d.split()), np.int64) for d in documents]
        self._learn()
        every = np.concatenate([np.zeros(0, np.int64), *words])
        self.words[2] += np.bincount(every, minlength=self.words.shape[1])
        begins, counts = self.words[0][every], self.words[1][every]
        stops = np.cumsum(counts)
        ids = self.ids[np.arange(counts.sum()) + np.repeat(begins - stops + counts, counts)]
        cuts = np.concatenate([[0], stops])[np.cumsum([0, *map(len, words)])].tolist()
        return [ids[b:e].tobytes() for b, e in zip(cuts, cuts[1:])]


class _Numbers(dict):
    """Numbers for words, given out as words are first looked up; ``new`` lists those."""

    def __init__(self, known: Iterable[tuple[bytes, int]] = ()):
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema(
        [("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))],
        metadata={"length": str(length)},
    )


class SequenceWriter:
    """Cuts a stream of ids into sequences of equal length; the mask tells ids from padding."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.schema, self.dtype, self.length = file_schema(dtype, length), dtype, length
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest, self.held, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        if self.held >= self.length * SEQUENCES * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.dtype)
        step = self.length * SEQUENCES
        whole = len(ids) // step * step
        keep = ids[whole:]
        for begin in range(0, whole, step):
            self._write(ids[begin : begin + step], np.ones(step, bool))
        if last and len(keep):
            padded = np.zeros(-(-len(keep) // self.length) * self.length, self.dtype)
            padded[: len(keep)] = keep
            self._write(padded, np.arange(len(padded)) < len(keep))
            keep = keep[:0]
        self.rest, self.held = [keep.tobytes()], len(keep) * self.dtype.itemsize

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write the ids of all texts, documents in ascending ``doc_id``; returns the index of the files.

    One Arrow file per range of ``doc_id``, in the shared folder: record batches of
    ``fixed_size_list`` ids and masks, so sequence k of a file is found by arithmetic and, where
    the folder is mounted, read without a copy. A task writes under a name of its own and lists it only when done, so a
    retried task leaves at most an unlisted file. Index rows: ``file``, ``part`` (its place in
    the order), ``doc_id``, ``first`` (place of the document's first id in the file),
    ``n_tokens`` (with the end id), ``ids_in_file``.
    Null ids sort first; equal ids and repeated rows keep a row each; an empty text has its end
    id alone; an empty table gives no files; other columns are ignored. Documents of one id stand in
    the order of the first HEAD characters, then of a digest; ranges end anywhere among them, also among
    repeated rows, so no id makes a large file. A text longer than a batch is encoded as one.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    if ":" not in folder:
        folder = f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        part = TaskContext.get().partitionId()
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
        writer, index, sink = None, [], None
        for batch in portions(batches):
            if writer is None:
                sink = fs.open_output_stream(f"{root}/{name}")
                writer = SequenceWriter(sink, encode.dtype, length)
            firsts, counts = [], []
            for ids in encode.encode([t.as_buffer().to_pybytes() for t in batch.column("text")]):
                firsts.append(writer.total)
                writer.add(ids + end)
                counts.append(writer.total - firsts[-1])
            # A copy: a column of the batch would keep its texts in memory.
            index.append((pa.array(batch.column("doc_id").to_pylist(), pa.int64()), firsts, counts))
        if writer is None:
            return
        writer.close()
        sink.close()
        for ids, firsts, counts in index:
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([part] * n, pa.int32()), ids, pa.array(firsts, pa.int64()), pa.array(counts, pa.int64()), pa.array([writer.total] * n, pa.int64())],
                ["file", "part", "doc_id", "first", "n_tokens", "ids_in_file"],
            )

    placed = texts(docs).select(
        "doc_id", "text", F.left("text", F.lit(HEAD)).alias("head"), F.xxhash64("text").alias("digest"),
        # Only tells apart rows that are alike, so it does not matter which of them has which.
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "head", "digest", "row"]
    ordered = placed.repartitionByRange(shuffle_tasks(spark), *order).sortWithinPartitions(*order)
    index = ordered.select("doc_id", "text").mapInArrow(run, "file string, part int, doc_id long, first long, n_tokens long, ids_in_file long")
    return written(index.withColumn("folder", F.lit(folder)), "token-index")


def read_documents(index: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files that ``index`` lists."""
    files = index.groupBy("folder", "file", "part").agg(F.first("ids_in_file").alias("n"))
    # One row per file; where each begins in the whole stream is a running sum over those rows.
    listed = sorted(files.collect(), key=lambda r: r["part"])
    begins = np.concatenate([[0], np.cumsum([r["n"] for r in listed])[:-1]]).tolist() if listed else []
    spark = index.sparkSession
    offsets = spark.createDataFrame(
        [(r["file"], int(b)) for r, b in zip(listed, begins, strict=True)], "file string, begin long"
    )
    placed = index.join(F.broadcast(offsets), "file").select("folder", "file", "doc_id", "first", "n_tokens", "begin")
    # The rows of a file stay together and in order: the index was written by the task that wrote the file.
    spread = placed.repartition(max(1, len(listed)), "file").sortWithinPartitions("file", "first")
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, reader = None, None
    for batch in batches:
        rows = batch.to_pydict()
        sums = []
        for folder, file, first, n in zip(rows["folder"], rows["file"], rows["first"], rows["n_tokens"], strict=True):
            if file != name:
                name, reader = file, SequenceReader(open_file(folder, file))
            crc = 0
            for ids in reader.ids(first, n):
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            sums.append(crc)
        start = np.array(rows["begin"], np.int64) + np.array(rows["first"], np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(start), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def open_file(folder: str, file: str) -> pa.NativeFile:
    """A file of sequences: mapped into memory where the folder is mounted, else opened for random reads."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return pa.memory_map(f"{root}/{file}")
    return fs.open_input_file(f"{root}/{file}")


class SequenceReader:
    """Random access to one file: ids by their place in the stream, whole sequences by number.

    Arrays of ids point into the file where it is mapped; elsewhere a batch is read at a time.
    """

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _load(self, number: int) -> pa.RecordBatch:
        if number != self.at:
            self.at, self.batch = number, self.file.get_batch(number)
        return self.batch

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = self._load(number // SEQUENCES), number % SEQUENCES
        mask = batch.column("mask")[row].values
        return batch.column("ids")[row].values.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> Iterator[np.ndarray]:
        size = self.length * SEQUENCES
        while n > 0:
            values = self._load(first // size).column("ids").flatten().to_numpy()
            part = values[first % size : first % size + n]
            yield part
            first, n = first + len(part), n - len(part)
