"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.tables import portions, texts

CACHED = 600_000  # pieces whose prefix counts a Python worker keeps

# How byte-level tokenizers of this kind cut a text into pieces, and the
# characters that stand for bytes in their vocabulary files.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

_COUNTERS: dict[str, PrefixCounter] = {}


def _byte_of() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _differences(spec: dict) -> list[str]:
    """What of a tokenizer's file is not as the prefix tables take it: plain merges over bytes, pieces as PIECES cuts them."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wanted = {
        "pre_tokenizer": cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"),
        "normalizer": not spec.get("normalizer"),
        "model": model.get("type", "BPE") == "BPE" and "merges" in model,
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")),
    }
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    return [k for k, fits in wanted.items() if not fits] + [k for k in options if model.get(k)]


class PrefixCounter:
    """Prefix tables of the pieces of a byte-level byte-pair tokenizer.

    A sequence of tokens is what the tokenizer gives for its bytes if and only if every two
    neighbours are what it gives for theirs. So the last token of each prefix is the one token
    that ends there and fits the last token of the prefix before it, and
    ``count[i] = count[i - len(last)] + 1``. A tokenizer of another kind is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if found := _differences(spec):
            raise ValueError(f"{path}: prefix tables do not fit its {', '.join(found)}")
        to_byte = _byte_of()
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        added = set(self.special)
        self.tokens = {as_bytes(t) for t in spec["model"]["vocab"] if t not in added}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.tokens))
        self.special_or_not = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.tables: dict[str, bytes | tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a short piece: the merge of the lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(p, len(self.ranks)) for p in zip(parts, parts[1:])))
            if best == len(self.ranks):
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.ranks.get((parts[i], parts[i + 1])) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fit(self, a: bytes, b: bytes) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2 * CACHED:
                self.fits.clear()
            found = self.fits[a, b] = self.merge(a + b) == [a, b]
        return found

    def table(self, piece: str) -> bytes | tuple[int, ...]:
        """Tokens of every byte prefix of a piece; entry i counts those of its first i bytes."""
        data = piece.encode()
        tokens, longest, fits = self.tokens, self.longest, self.fits
        counts, last = [0], [b""]
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in tokens and (not begin or self._fit(last[begin], token)):
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return bytes(counts) if counts[-1] < 256 else tuple(counts)

    def look_up(self, pieces: list[str]) -> list[bytes | tuple[int, ...]]:
        tables = self.tables
        new = [p for p in set(pieces) if p not in tables]
        if len(tables) + len(new) > CACHED and tables:
            tables.clear()
            new = list(set(pieces))
        for piece in new:
            tables[piece] = self.table(piece)
        return list(map(tables.__getitem__, pieces))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text in order; a special string is a piece of its own."""
        if self.special_or_not is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special_or_not.split(text)):
            out += [part] if i % 2 else self.pieces.findall(part)
        return out

    def count(self, text: str) -> int:
        pieces = self.cut(text)
        special = sum(map(pieces.count, self.special)) if any(s in text for s in self.special) else 0
        if special:
            pieces = [p for p in pieces if p not in self.special]
        return sum(t[-1] for t in self.look_up(pieces)) + special

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for i = 0 .. len(text), as the tokenizer counts each prefix alone.

        A prefix ends inside one piece: the pieces before it count in full, its own part by the
        piece's table. Two kinds of piece change when cut: white space before a word is one
        piece when it ends the prefix, and half a contraction or special string is ordinary text.
        """
        pieces = self.cut(text)
        out, done, i = [0], 0, 0
        while i < len(pieces):
            piece = pieces[i]
            if piece in self.special:
                inner = self.prefix_counts(piece[:-1]) if len(piece) > 1 else [0]
                if i and pieces[i - 1] not in self.special:  # the cut special joins the text before it
                    before = self._tail(pieces, i)
                    base = done - self.count(before)
                    inner = [base + self.count(before + piece[:k]) for k in range(len(piece))]
                else:
                    inner = [done + c for c in inner]
                out += inner[1:]
                done += 1
                out.append(done)
            elif piece.isspace() and i + 1 < len(pieces) and pieces[i + 1] not in self.special:
                # The run's last character went to, or stands before, the next piece.
                rest = pieces[i + 1]
                run = piece + (rest[0] if rest[0].isspace() else "")
                steps = self._by_character(run)
                out += [done + c for c in steps[1 : len(piece) + 1]]
                done += self.look_up([piece])[0][-1]
                if len(run) > len(piece):
                    inner = self._by_character(rest)
                    out += [out[-1] - steps[len(piece)] + steps[-1]]
                    out += [done + c for c in inner[2:]]
                    done += inner[-1]
                    i += 1
            else:
                steps = self._by_character(piece)
                if piece in ("'re", "'ve", "'ll"):
                    steps[2] = steps[1] + self.look_up([piece[1]])[0][-1]
                out += [done + c for c in steps[1:]]
                done += steps[-1]
            i += 1
        return out

    @staticmethod
    def _tail(pieces: list[str], i: int) -> str:
        return "".join(pieces[max(0, i - 2) : i])

    def _by_character(self, piece: str) -> list[int]:
        table, out, at = self.look_up([piece])[0], [0], 0
        for c in piece:
            at += len(c.encode())
            out.append(table[at])
        return out

    def within(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the length in characters of its longest prefix of at most ``budget`` tokens."""
        if self.count(text) <= budget:
            return self.count(text), len(text)
        counts = self.prefix_counts(text)
        return counts[-1], max(i for i, c in enumerate(counts) if c <= budget)


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, a row per document; null and empty texts have no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer)
        for batch in portions(batches):
            n = pa.array([table.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncations(docs: DataFrame, tokenizer: str, budget: int) -> DataFrame:
    """``(doc_id, n_tokens, kept_chars)``: how much of each text fits ``budget`` tokens, nothing encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer)
        for batch in portions(batches):
            found = [table.within(t, budget) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                ["doc_id", "n_tokens", "kept_chars"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, kept_chars long")
