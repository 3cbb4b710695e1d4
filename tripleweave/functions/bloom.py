"""Split-block Bloom filters as plain aggregates.

A filter is a table ``(block, w0..w7)``: 256 bits a row, eight 32-bit words, one bit set per
word and value. Building one is ``groupBy(block)`` with ``bit_or`` (partial aggregation, so a
hot value costs one row per task); probing is an equi-join on ``block`` plus eight bit tests.
No filter ever has to fit one row, one task or the driver: Spark broadcasts it when its
measured size allows and shuffles it otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the layout.
BLOCK_BITS = 256
WORDS = [f"w{i}" for i in range(8)]


def false_positive_rate(bits_per_value: float) -> float:
    """Expected rate: the load of a block is Poisson, and all eight words have to hit."""
    load = BLOCK_BITS / bits_per_value
    total, p = 0.0, math.exp(-load)
    for i in range(int(load * 4) + 64):
        total += p * (1 - (1 - 1 / 32) ** i) ** 8
        p *= load / (i + 1)
    return total


def bits_per_value(fpp: float) -> float:
    low, high = 1.0, 256.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if false_positive_rate(mid) > fpp else (low, mid)
    return high


def blocks_for(n: int, fpp: float) -> int:
    return max(1, math.ceil(n * bits_per_value(fpp) / BLOCK_BITS))


def block(value: Column, n_blocks: Column | int) -> Column:
    n = n_blocks if isinstance(n_blocks, Column) else F.lit(n_blocks)
    return F.pmod(F.xxhash64(value), n.cast("bigint"))


def masks(value: Column) -> list[Column]:
    """The bit to set in each word: eight five-bit slices of a second hash."""
    h = F.xxhash64(value, F.lit("bits"))
    return [
        F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)).cast("int"))
        for i in range(8)
    ]


def contains(value: Column, words: list[Column]) -> Column:
    """True when every word has the value's bit."""
    hit = None
    for mask, word in zip(masks(value), words):
        one = mask.bitwiseAND(word) != 0
        hit = one if hit is None else hit & one
    return hit
