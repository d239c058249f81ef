"""Column functions on words, bits and bytes; all but the byte prefix stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_len(v: Column) -> Column:
    """Bits to write a non-negative integer; 1 for 0."""
    return F.length(F.bin(v)).cast("long")


def floor_log2(v: Column) -> Column:
    """Floor of the binary logarithm of a positive integer."""
    return bit_len(v) - 1


def mask(width: Column | int) -> Column:
    """The lowest ``width`` bits set, 0 <= width <= 64."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.when(w <= 0, F.lit(0)).when(w >= 64, F.lit(-1)).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), w.cast("int")))).cast("long")


def low_bits(v: Column, width: Column | int) -> Column:
    return v.bitwiseAND(mask(width))


def shift_right(v: Column, n: Column) -> Column:
    """Logical shift of a word; 0 from 64 on."""
    return F.when(n >= 64, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", v, n.cast("int"))).cast("long")


def shift_left(v: Column, n: Column) -> Column:
    return F.when(n >= 64, F.lit(0)).otherwise(F.call_function("shiftleft", v.cast("long"), n.cast("int"))).cast("long")


def ones_in_word(word: Column) -> Column:
    """Ascending positions of the set bits."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word, i) == 1)


def select_in_word(word: Column, rank: Column) -> Column:
    """Position of the rank-th set bit, from 0; null if there are fewer."""
    return F.get(ones_in_word(word), rank.cast("int")).cast("long")


def select_zero_in_word(word: Column, rank: Column) -> Column:
    return select_in_word(F.bitwise_not(word), rank)


def rank_in_word(word: Column, pos: Column) -> Column:
    """Set bits strictly below ``pos``, 0 <= pos <= 64."""
    return F.bit_count(low_bits(word, pos)).cast("long")


def vbyte_len(v: Column) -> Column:
    """Bytes of the bijective base-128 code of a non-negative integer below 2**56."""
    out, limit = F.lit(1), 128
    bounds = [limit]
    for k in range(2, 8):
        limit += 128**k
        bounds.append(limit)
    for i, b in enumerate(bounds[:7]):
        out = F.when(v >= b, F.lit(i + 2)).otherwise(out)
    return out.cast("long")


def shared_bytes(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Bytes that the rows of two string or binary arrays share at their beginnings, compared all at once."""
    x, y = (a.cast(pa.large_binary()).fill_null(b"") for a in (x, y))
    sides = [(np.frombuffer(a.buffers()[2] or b"", np.uint8), np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]) for a in (x, y)]
    n = np.minimum(*(np.diff(o) for _, o in sides))
    if not n.sum():
        return n
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    place = np.arange(len(row)) - first[row]
    (a, i), (b, j) = sides
    differs = a[i[:-1][row] + place] != b[j[:-1][row] + place]
    out = n.copy()
    np.minimum.at(out, row[differs], place[differs])
    return out


def byte_lcp(a: Column | str, b: Column | str) -> Column:
    """Bytes that two strings or byte strings share at their beginnings; 0 with null."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(shared_bytes(x, y), pa.int64())

    return F.arrow_udf(run, "long")(a, b)


def bit_lcp(a: Column, b: Column) -> Column:
    """Leading bits that two 64-bit integers share; 64 if equal."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(64)).otherwise(64 - F.length(F.bin(x))).cast("long")


def fingerprint(key: Column, bits: int, seed: int = 0) -> Column:
    """The lowest ``bits`` bits of a seeded hash."""
    return low_bits(F.xxhash64(F.lit(seed), key), bits)
